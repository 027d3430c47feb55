"""Evaluation items that stand, whole or in part, in corpus documents.

Words are canonicalised to typed slots: runs of digits become the slot of numbers,
units of measure the slot of units, and every word that is not part of the frame
vocabulary of the evaluation set (words used by at least `FRAME_ITEMS` items) the
slot of names. Every window of `WINDOW` canonical words has a hash, its template; the
windows of documents and items are joined on it. Windows that meet are told apart by
their slot fillers: equal fillers mean the passage itself; fillers that repeat in the
same places (a one-to-one renaming) mean the same question with other values.

A batch of documents is one array of word numbers: each word is canonicalised and hashed
once, and the hashes of all windows are rolled over the whole array. Only windows whose
template is one of the items' leave the scan; the documents' texts are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import words
from paperloom.session import cut_lineage

#: Words of a window; a passage must have at least as many in a row.
WINDOW = 12
#: A word used by this many items or more belongs to the frame of the questions.
FRAME_ITEMS = 3
#: Frame words that a window must hold, else its template says nothing and its own words stand for it.
LEAST_FRAME = 3
#: Frame words of a window that tells a question with other values: half of it.
RENAMED_FRAME = WINDOW // 2
#: Item windows up to this many rows are broadcast for the join (of about 100 bytes each).
BROADCAST_ROWS = 200_000
#: Templates up to this many (8 bytes each) go to the scan of the documents; beyond it all windows are joined.
SCAN_TEMPLATES = 4_000_000
#: Words of a batch that are hashed at once.
_WORDS_AT_ONCE = 500_000
#: Units of measure, in the four languages of the tables.
UNITS = frozenset(
    "mm cm m km g kg mg l ml s min h minute minutes second seconds hour hours day days year years "
    "metre metres meter meters millimetre millimetres kilometre kilometres gram grams kilogram kilograms litre litres "
    "minuten sekunden stunden tage jahre meter gramm liter minutos segundos horas dias anos metros gramos litros "
    "secondes heures jours ans metres grammes euro euros dollar dollars percent prozent".split()
)
_WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def folded_words(text: str) -> list[str]:
    """Runs of letters or digits in lower case without accents."""
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")
    return _WORD.findall(low)


class _Words(dict):
    """Word numbers from 0, given on first sight; `own` and `canon` hold the hashes of the word and of its slot, `frame` whether it keeps itself."""

    def __init__(self, frame: frozenset[str]) -> None:
        super().__init__()
        self.known, self.own, self.canon, self.frame = frame, [], [], []

    def __missing__(self, word: str) -> int:
        slot = "0" if word.isnumeric() else "1" if word in UNITS else word if word in self.known else "2"
        self.own.append(xxhash.xxh64_intdigest(word))
        self.canon.append(xxhash.xxh64_intdigest(slot))
        self.frame.append(len(slot) > 1)
        self[word] = number = len(self)
        return number


def _pattern(window: list[str], vocabulary: frozenset[str]) -> str:
    """Where a window's slot fillers repeat: each by the number of its first place."""
    first: dict[str, int] = {}
    return ".".join(str(first.setdefault(w, k)) for k, w in enumerate(window) if w.isnumeric() or w in UNITS or w not in vocabulary)


def _windows(vocabulary: frozenset[str], size: int, id_type: pa.DataType, wanted: np.ndarray | None):
    """Rows of (`_id`, `_text`) to their windows; with `wanted` (ascending), only those of its templates."""
    schema = pa.schema([("_id", id_type), ("template", pa.int64()), ("frame", pa.int32()), ("pattern", pa.string()), ("words", pa.string())])
    near = None
    if wanted is not None:
        near = np.zeros(1 << 22, dtype=bool)
        near[(wanted.view(np.uint64) >> np.uint64(42)).astype(np.int64)] = True

    def emit(ids: pa.Array, texts: list[list[str]], rows: list[int], numbers: _Words) -> pa.RecordBatch | None:
        flat = [w for tokens in texts for w in tokens]
        own_number = np.fromiter(map(numbers.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = len(flat) - size + 1
        if n < 1:
            return None
        own, canon, frame = np.array(numbers.own, dtype=np.uint64)[own_number], np.array(numbers.canon, dtype=np.uint64)[own_number], np.array(numbers.frame)[own_number]
        of_row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        held = np.concatenate([[0], np.cumsum(frame)])
        held = held[size:] - held[:-size]
        roll = lambda h: [acc := np.zeros(n, dtype=np.uint64), *(acc := acc * _FACTOR + h[j : n + j] for j in range(size))][-1]
        with np.errstate(over="ignore"):
            template = np.where(held >= LEAST_FRAME, roll(canon), ~roll(own)).view(np.int64)
        good = of_row[:n] == of_row[size - 1 :]
        if near is not None:
            good &= near[(template.view(np.uint64) >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(good)
        if wanted is not None and len(at):
            place = np.minimum(np.searchsorted(wanted, template[at]), len(wanted) - 1)
            at = at[wanted[place] == template[at]]
        if not len(at):
            return None
        spans = [flat[i : i + size] for i in at]
        columns = [ids.take(pa.array(np.array(rows)[of_row[at]])), pa.array(template[at]), pa.array(held[at].astype(np.int32)), pa.array([_pattern(s, vocabulary) for s in spans]), pa.array([" ".join(s) for s in spans])]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Words(vocabulary)
        for batch in batches:
            ids, texts, rows, count = batch.column("_id"), [], [], 0
            column = batch.column("_text")
            for row in range(len(column)):
                tokens = folded_words(column[row].as_py() or "")
                if len(tokens) < size:
                    continue
                texts.append(tokens)
                rows.append(row)
                count += len(tokens)
                if count >= _WORDS_AT_ONCE:
                    if (out := emit(ids, texts, rows, numbers)) is not None:
                        yield out
                    texts, rows, count = [], [], 0
            if texts and (out := emit(ids, texts, rows, numbers)) is not None:
                yield out
            if len(numbers) > 1_000_000:
                numbers = _Words(vocabulary)

    return run


def _scanned(df: DataFrame, vocabulary: frozenset[str], size: int, wanted: np.ndarray | None) -> DataFrame:
    kind = df.schema["_id"].dataType.simpleString()
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if kind not in types:
        raise TypeError(f"an id of type {kind} isn't supported")
    return df.where("_text IS NOT NULL").mapInArrow(_windows(vocabulary, size, types[kind], wanted), f"_id {kind}, template long, frame int, pattern string, words string")


def _item_windows(items: DataFrame, item_id: str, item_text: str, size: int) -> tuple[DataFrame, frozenset[str]]:
    """The items' windows, once per item and words, and the frame vocabulary."""
    own_items = items.select(F.col(f"`{item_id}`").alias("_id"), F.col(f"`{item_text}`").alias("_text"))
    # The frame vocabulary: words of many items, of the evaluation set alone; at most a third of its words.
    used = own_items.dropDuplicates(["_id"]).select("_id", F.explode(F.array_distinct(words(F.col("_text")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    frame = used.where((F.col("n") >= FRAME_ITEMS) & ~F.col("w").rlike(r"^\p{N}+$"))
    vocabulary = frozenset(r.w for r in frame.select("w").toLocalIterator())
    return cut_lineage(_scanned(own_items, vocabulary, size, None).distinct()), vocabulary


def meetings(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The windows of documents and of items that share a template: (`_id`, `template`, `frame`, `pattern`, `words`) each, once per id and words."""
    item_windows, vocabulary = _item_windows(items, item_id, item_text, size)
    own_docs = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{doc_text}`").alias("_text"))
    templates = item_windows.select("template").distinct()
    wanted = None
    if templates.count() <= SCAN_TEMPLATES:
        wanted = np.sort(templates.toArrow().column("template").to_numpy())
    if wanted is not None and not len(wanted):
        own_docs = own_docs.where(F.lit(False))
    return _scanned(own_docs, vocabulary, size, wanted).distinct(), item_windows


def _small(item_windows: DataFrame) -> DataFrame:
    return F.broadcast(item_windows) if item_windows.count() <= BROADCAST_ROWS else item_windows


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, size: int = WINDOW) -> DataFrame:
    """Documents that hold a passage of `size` words of an item.

    Result: `doc_id`, `item_id`, `n_exact` (different windows of the same words). Null and
    empty texts share nothing; texts below `size` words neither; repeated rows of a document or
    an item under other ids count by themselves, and the same id twice counts once. Extra
    columns are dropped first.
    """
    seen, asked = meetings(docs, items, doc_id, doc_text, item_id, item_text, size)
    wanted = _small(asked.select(F.col("_id").alias("_item"), F.col("template").alias("_t"), F.col("words").alias("_w")))
    met = seen.join(wanted, (F.col("template") == F.col("_t")) & (F.col("words") == F.col("_w")))
    return met.groupBy("_id", "_item").agg(F.count("*").alias("n_exact")).toDF(doc_id, item_id, "n_exact")


def _class_id(df: DataFrame) -> DataFrame:
    """Adds `class_id`: equal for windows that are renamings of each other."""
    return df.withColumn("class_id", F.xxhash64("template", "pattern"))


def question_classes(items: DataFrame, item_id: str, item_text: str, size: int = WINDOW, least: int = RENAMED_FRAME) -> DataFrame:
    """`class_id`, `item_id`: the members of each class of windows of at least `least` frame words."""
    asked, _ = _item_windows(items, item_id, item_text, size)
    return _class_id(asked.where(F.col("frame") >= least)).select("class_id", F.col("_id").alias(item_id)).distinct()


def renamed(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, size: int = WINDOW, least: int = RENAMED_FRAME) -> DataFrame:
    """Documents that ask an item's question with other names or numbers.

    Result: `doc_id`, `class_id`, `n_windows`, for each class of windows (the same template,
    and fillers that repeat in the same places, of at least `least` frame words) that a
    document has in common with the items without having the words of any of them. A document
    and an item are linked where they share a class (`question_classes`); links are not
    expanded to pairs. Nulls, short and repeated texts as in `leaks`.
    """
    seen, asked = meetings(docs, items, doc_id, doc_text, item_id, item_text, size)
    asked = _class_id(asked.where(F.col("frame") >= least))
    classes = _small(asked.select("class_id").distinct())
    texts = _small(asked.select("class_id", F.col("words").alias("_w")).distinct())
    own = cut_lineage(_class_id(seen.where(F.col("frame") >= least)).join(classes, "class_id", "left_semi"))
    exact = own.join(texts.withColumnRenamed("class_id", "_c"), (F.col("class_id") == F.col("_c")) & (F.col("words") == F.col("_w")), "left_semi").select("_id", "class_id").distinct()
    other = own.join(exact, ["_id", "class_id"], "left_anti")
    return other.groupBy("_id", "class_id").agg(F.count("*").alias("n_windows")).withColumnRenamed("_id", doc_id)


def leaked_items(found: DataFrame, item_id: str) -> DataFrame:
    """Per item: in how many documents a passage of it stands."""
    return found.groupBy(item_id).agg(F.count("*").alias("n_docs"))
