"""Files as rows: discovery, content types, decoding, members of archives, the choice of an importer."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of certainty that an importer can give.
FALLBACK, EXTENSION, MIME, MAGIC, CERTAIN = 1, 300, 600, 800, 1000
MEMBER_BYTES, ARCHIVE_BYTES, MEMBERS, RATIO, DEPTH = 512 << 20, 1 << 30, 10_000, 200, 4

#: First bytes, in hexadecimal, and what they tell.
MAGICS = (
    ("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"),
    ("424D", "image/bmp"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("4F676753", "audio/ogg"), ("664C6143", "audio/flac"), ("494433", "audio/mpeg"), ("1A45DFA3", "video/webm"),
)


def discover(spark: SparkSession, path: str, hidden: bool = False, pattern: str | None = None) -> DataFrame:
    """Files below a folder, each once: `path`, `size`, `modified`, `content`. Hidden ones, and those whose path doesn't match, aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if not hidden:
        files = files.where(~F.col("path").rlike(r"/\.[^/]"))
    if pattern:
        files = files.where(F.col("path").rlike(pattern))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def input_order(files: DataFrame, roots: list[str]) -> DataFrame:
    """The paths of the files below `roots`, each once, as `path` and `root` (from 1), by the first root that holds it and then by path."""
    which = F.array_position(F.array(*(F.startswith("path", F.lit(r.rstrip("/") + "/")) | (F.col("path") == r) for r in roots)), True).cast("int")
    paths = files.select("path", which.alias("root")).where("root > 0").groupBy("path").agg(F.min("root").alias("root"))
    return paths.select("path", "root").orderBy("root", "path")


def content_type(content: Column) -> Column:
    """A MIME type from the first bytes; null where they tell nothing."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.substring(head, 1, 8).eqNullSafe("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("image/webp"))
    out = out.when(F.substring(head, 1, 8).eqNullSafe("52494646") & (F.substring(head, 17, 8) == "57415645"), F.lit("audio/wav"))
    out = out.when(F.substring(head, 9, 8) == "66747970", F.lit("video/mp4"))
    for magic, mime in MAGICS:
        out = out.when(F.startswith(head, F.lit(magic)), F.lit(mime))
    return out


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark, bytes that are none replaced."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else bytes(b).decode("utf-8-sig", "replace"))

    return run(content)


def sniffed_as_text(content: Column, size: int = 8192) -> Column:
    """Whether the first bytes are text: no zero byte, and UTF-8 or nineteen twentieths printable."""

    @F.pandas_udf("boolean")
    def run(batch: pd.Series) -> pd.Series:
        def one(b) -> bool:
            head = bytes(b or b"")[:size]
            if b"\0" in head:
                return False
            try:
                head.decode("utf-8")
                return True
            except UnicodeDecodeError as e:
                if e.start >= len(head) - 3 and len(head) == size:
                    return True
            return sum(32 <= c < 127 or c in (9, 10, 13) or c >= 160 for c in head) >= 0.95 * max(1, len(head))

        return batch.map(one)

    return run(content)


def best_importer(candidates: DataFrame, source: str = "source") -> DataFrame:
    """Of `source`, `importer`, `score`, `priority`, `position`: the best per source; ties go to the higher priority, then to the first registered."""
    best = F.max_by("importer", F.struct("score", "priority", (-F.col("position")).alias("p")))
    return candidates.where("score > 0").groupBy(source).agg(best.alias("importer"), F.max("score").alias("score"))


def _members(name: str, data: bytes, depth: int, left: list[int]) -> Iterator[tuple[str, int, bytes, str | None]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                if info.is_dir():
                    continue
                if left[0] <= 0 or left[1] <= 0:
                    yield info.filename, depth, b"", "archive budget is used up"
                    return
                if info.file_size > MEMBER_BYTES or (info.file_size > 1 << 20 and info.file_size > RATIO * max(1, info.compress_size)):
                    yield info.filename, depth, b"", "member is too large"
                    continue
                body = archive.read(info)
                left[0] -= 1
                left[1] -= len(body)
                yield info.filename, depth, body, None
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as archive:
            for info in archive:
                if not info.isfile():
                    continue
                if left[0] <= 0 or left[1] <= 0:
                    yield info.name, depth, b"", "archive budget is used up"
                    return
                if info.size > MEMBER_BYTES:
                    yield info.name, depth, b"", "member is too large"
                    continue
                body = archive.extractfile(info).read()
                left[0] -= 1
                left[1] -= len(body)
                yield info.name, depth, body, None
    except tarfile.TarError:
        return


def archive_members(files: DataFrame) -> DataFrame:
    """Members of zip and tar files (`path`, `content`), nested ones too: `path`, `member`, `depth`, `content`, `warning`.

    One archive is read in one task, within the budgets above; what exceeds them comes out with a warning and no bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                left, rows = [MEMBERS, ARCHIVE_BYTES], []
                todo = [("", bytes(data or b""), 1)]
                while todo:
                    prefix, body, depth = todo.pop(0)
                    for name, d, inner, warning in _members(path, body, depth, left):
                        rows.append((path, prefix + name, d, inner, warning))
                        if depth < DEPTH and name.lower().endswith((".zip", ".tar", ".tgz", ".tar.gz")) and inner:
                            todo.append((prefix + name + "/", inner, depth + 1))
                yield pd.DataFrame(rows, columns=["path", "member", "depth", "content", "warning"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, depth int, content binary, warning string")


def member_path(name: str, position: int, size: int = 96) -> str:
    """A safe file name for a member: its last component with a running number."""
    last = re.sub(r"[^\w. -]", "_", re.split(r"[/\\]", name)[-1]).strip().lstrip(".") or "file"
    return f"{position:04d}-{last[:size]}"
