"""Privacy profiles, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import base_name, key_suffix

#: Suffixes of keys that change with each run.
VOLATILE = ("FileAccessDate", "FileModifyDate", "FileInodeChangeDate", "FileCreateDate", "FilePermissions", "Directory")
#: What may be shared, by whole key and by suffix.
SHARED_KEYS = ("source.filename", "fs.size-bytes", "outline.title", "outline.folders")
SHARED_SUFFIXES = (
    "FileType", "FileTypeExtension", "MIMEType", "ImageWidth", "ImageHeight", "ImageSize", "Megapixels", "Duration", "duration", "width", "height", "codec_name", "codec_type", "format_name", "nb_frames", "FrameCount", "PageCount", "Orientation", "dpi",
)


def archive_metadata(meta: Column) -> Column:
    """Without the keys that change with each run."""
    return F.map_filter(meta, lambda k, v: ~key_suffix(k).isin(*VOLATILE))


def share_metadata(meta: Column) -> Column:
    """Only what may be shared."""
    return F.map_filter(meta, lambda k, v: ~key_suffix(k).isin(*VOLATILE) & (k.isin(*SHARED_KEYS) | key_suffix(k).isin(*SHARED_SUFFIXES)))


def shared_entries(entries: DataFrame) -> DataFrame:
    """Entries as the share profile shows them.

    Places stay only where they were read from the text; the name of a recognised person
    becomes 'face'; attributes keep what may be shared; the units of summaries of people go.
    `attributes` is a JSON object of strings, and null where it can't be read.
    """
    attributes = F.from_json("attributes", "map<string,string>")
    has = lambda key: F.coalesce(F.map_contains_key(attributes, F.lit(key)), F.lit(False))
    value = lambda key: F.try_element_at(attributes, F.lit(key))
    kept = entries.where((F.col("kind") != "location") | value("source").eqNullSafe(F.lit("text")))
    kept = kept.where(~value("summary").eqNullSafe(F.lit("people")))
    masked = F.when((F.col("kind") == "face") & has("person"), F.lit("face")).otherwise(F.col("text"))
    return kept.withColumn("text", masked).withColumn("attributes", F.to_json(share_metadata(attributes)))


def manifest(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """One JSON manifest per document: its sources with their units and pages, in order."""
    units = entries.groupBy("document_id", "source_id", "unit_id").agg(F.min("page_first").alias("page_first"), F.max("page_last").alias("page_last"), F.min("entry_id").alias("at"))
    sources = units.groupBy("document_id", "source_id").agg(F.min("at").alias("at"), F.min("page_first").alias("page_first"), F.max("page_last").alias("page_last"), F.transform(F.array_sort(F.collect_list(F.struct("at", "unit_id", "page_first", "page_last"))), lambda u: u.dropFields("at")).alias("units"))
    docs = sources.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_id", "page_first", "page_last", "units"))), lambda s: s.dropFields("at")).alias("sources"))
    named = docs.join(documents.select("document_id", base_name(F.col("pdf")).alias("file"), "profile"), "document_id")
    return named.select("document_id", F.to_json(F.struct("file", "profile", "sources")).alias("manifest"))


MANIFEST = "file string, profile string, sources array<struct<source_id string, page_first int, page_last int, units array<struct<unit_id string, page_first int, page_last int>>>>"


def read_manifest(text: Column) -> Column:
    """A manifest as columns; null where the text isn't one."""
    return F.from_json(text, MANIFEST)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key; a null key replaces nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """File names made unique: the second of a name gets '-2' before its extension, and so on."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("published_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), n.cast("string"), ext)))
