from collections import Counter

import numpy as np
import pytest

from paperloom.llm import catalog
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.queries()[name](spark, SMALL).collect()


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], SMALL)


def test_neighbours_against_brute_force(spark):
    vectors = {}
    for r in table(spark, "unit_embeddings").where("vector IS NOT NULL AND size(vector) = dim").collect():
        v = np.array(r.vector, dtype=np.float64)
        if np.isfinite(v).all() and v.any():
            vectors.setdefault((r.model, r.dim), []).append((r.vec_id, v / np.linalg.norm(v)))
    want = {}
    for own in vectors.values():
        ids, x = np.array([i for i, _ in own]), np.array([v for _, v in own])
        near = x @ x.T
        np.fill_diagonal(near, -2)
        for k, i in enumerate(ids):
            want[i] = set(ids[np.argsort(-near[k])[:5]])
    got = {}
    for r in rows(spark, "p1_neighbours"):
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    assert sum(len(got[i] & want[i]) for i in want) >= 0.95 * sum(map(len, want.values()))


def test_pieces_are_within_the_limit(spark):
    own = rows(spark, "p2_pieces")
    assert own and all(len(r.text.encode()) <= 4096 and r.overlap_chars <= 300 and r.piece_no >= 1 for r in own)


def test_masks_are_the_mentions(spark):
    texts = {("entries", r.entry_id, "text"): r.text for r in table(spark, "entries").collect()}
    for r in table(spark, "emails").collect():
        texts["emails", r.email_id, "body"], texts["emails", r.email_id, "from_addrs"] = r.body, ", ".join(r.from_addrs or [])
    found = Counter((r.src_table, r.row_id, r.field) for r in rows(spark, "p3_found"))
    for r in rows(spark, "p3_masked"):
        key, whole = (r.src_table, r.row_id, r.field), texts[r.src_table, r.row_id, r.field]
        marks = sum((r.masked_text or "").count(f"[{k}]") - (whole or "").count(f"[{k}]") for k in ("NAME", "EMAIL", "PHONE", "IDENTITY", "ADDRESS"))
        assert marks == found[key] and (found[key] or r.masked_text == whole)


def test_lines_of_emails_are_new_or_found(spark):
    found = {}
    for r in rows(spark, "p5_found"):
        found.setdefault(r.email_id, set()).add(r.line_no)
    new = {r.email_id: r.new_text for r in rows(spark, "p5_texts")}
    layout = {}
    for r in rows(spark, "p5_nodes"):
        layout.setdefault(r.email_id, []).append(r)
    for r in table(spark, "emails").where("body <> ''").collect():
        kept = [x.rstrip() for k, x in enumerate(r.body.split("\n"), 1) if x.strip() and k not in found.get(r.email_id, set())]
        assert [x for x in new[r.email_id].split("\n") if x.strip()] == kept
        assert min(n.first_line for n in layout[r.email_id]) >= 1 and any(n.depth == 0 for n in layout[r.email_id])


def test_noise_of_pages(spark):
    texts = {r.entry_id: r.text.split("\n") for r in table(spark, "entries").where("kind = 'ocr' AND text <> ''").collect()}
    found, clean = rows(spark, "p6_found"), {r.entry_id: r.clean_text for r in rows(spark, "p6_texts")}
    assert {r.noise_kind for r in found} == {"hyphenation", "misread", "header", "page_number"}
    for r in found:
        line = texts[r.entry_id][r.line_no - 1]
        assert (r.token == "") == (r.noise_kind in ("header", "page_number"))
        if r.noise_kind == "hyphenation":
            assert line.rstrip()[-1] in "-\u00ad\u2010¬" and r.token.lower() in clean[r.entry_id].lower()
    assert set(clean) >= set(texts)


def test_renamed_questions_have_a_class(spark):
    classes = {r.class_id for r in rows(spark, "p7_classes")}
    exact = {(r.doc_id) for r in rows(spark, "p7_found")}
    assert classes and exact and all(r.class_id in classes and r.n_windows > 0 for r in rows(spark, "p7_renamed"))


def test_mix_keeps_caps_and_shares(spark):
    targets = {r.doc_source: r for r in table(spark, "mix_targets").collect()}
    source = {r.doc_id: r.source for r in table(spark, "documents").collect()}
    mix = rows(spark, "p8_mix")
    assert mix and all(source[r.doc_id] == r.doc_source and 1 <= r.n_uses <= targets[r.doc_source].max_repeats for r in mix)
    used = Counter()
    for r in mix:
        used[r.doc_source] += r.n_tokens * r.n_uses
    shares = {r.doc_source: r for r in rows(spark, "p8_shares")}
    assert set(shares) == set(targets) and abs(sum(r.reached_share for r in shares.values()) - 1) < 1e-9
    assert all(shares[s].n_tokens_used == used[s] for s in targets)


def test_residue_and_the_rest_are_all_documents(spark):
    found = {r.doc_id for r in rows(spark, "p9_found")}
    assert found and {r.doc_id for r in rows(spark, "p9_kinds")} == found
    assert {r.doc_id for r in rows(spark, "p9_kept")} | found == {r.doc_id for r in table(spark, "documents").collect()}
    assert {r.evidence_kind for r in rows(spark, "p9_kinds")} <= {"error", "placeholder", "filler", "script"}


def test_every_query_without_sql_is_tested_here():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"p1_neighbours", "p2_pieces", "p3_found", "p3_masked", "p5_found", "p5_nodes", "p5_texts", "p6_found", "p6_texts", "p7_classes", "p7_renamed", "p8_mix", "p8_shares", "p9_found", "p9_kept", "p9_kinds"}
