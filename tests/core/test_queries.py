import pytest

from paperloom.plans import catalog
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], SMALL)


def test_face_boxes_overlap_no_better_one(spark):
    kept = catalog.queries()["face_boxes"](spark, SMALL).toPandas()
    faces = spark.read.parquet(f"{SMALL}/entries.parquet").where("kind = 'face' AND x IS NOT NULL AND width IS NOT NULL AND unit_id IS NOT NULL").toPandas()
    faces["score"] = faces["confidence"].fillna(0.0)

    def overlap(a, b):
        w, h = max(0.0, min(a.x + a.width, b.x + b.width) - max(a.x, b.x)), max(0.0, min(a.y + a.height, b.y + b.height) - max(a.y, b.y))
        union = a.width * a.height + b.width * b.height - w * h
        return w * h / union if union > 0 else 0.0

    want = set()
    for _, group in faces.sort_values(["score", "entry_id"], ascending=[False, True]).groupby(["document_id", "unit_id"], sort=False):
        own = []
        for face in group.itertuples():
            if all(overlap(face, other) <= 0.5 for other in own):
                own.append(face)
        want |= {f.entry_id for f in own}
    assert set(kept["entry_id"]) == want and 0 < len(want) <= len(faces)


def test_kept_frames_differ_from_those_before(spark):
    rows = spark.read.parquet(f"{SMALL}/sightings.parquet").where("source_path IS NOT NULL AND vector IS NOT NULL").select("source_path", "sighting_id", "vector").collect()
    want, kept = set(), {}
    for r in sorted(rows, key=lambda r: r.sighting_id):
        bits = sum((x > 0) << i for i, x in enumerate(r.vector))
        own = kept.setdefault(r.source_path, [])
        if all((bits ^ b).bit_count() > 2 for b in own[-12:]):
            own.append(bits)
            want.add(r.sighting_id)
    assert {r.sighting_id for r in catalog.queries()["kept_frames"](spark, SMALL).collect()} == want and 0 < len(want) < len(rows)


def test_snippets_hold_their_phrase(spark):
    rows = catalog.queries()["search_snippets"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 10 and all("[map]" in r.snippet and "[cabinet]" in r.snippet and len(r.snippet.split()) <= 17 for r in rows)


def test_every_query_without_sql_is_tested_here():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"face_boxes", "kept_frames", "search_snippets"}
