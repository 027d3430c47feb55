"""Joins and filters over sources, units and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import base_name
from paperloom.operators.runs import near


def stem(path: Column) -> Column:
    """The file name of a path without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def sidecars(media: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts (`text_path`) to media (`media_path`) of the same stem, and the transcripts that are left over.

    A single medium takes all transcripts; a stem that several media share takes none.
    """
    only = media.select("media_path").distinct().limit(2).collect()
    if len(only) == 1:
        pairs = texts.select("text_path").distinct().withColumn("media_path", F.lit(only[0][0]))
    else:
        named = media.select("media_path").distinct().withColumn("_stem", stem(F.col("media_path")))
        unique = named.groupBy("_stem").agg(F.count("*").alias("_n"), F.first("media_path").alias("media_path")).where("_n = 1")
        pairs = texts.select("text_path").distinct().withColumn("_stem", stem(F.col("text_path"))).join(unique, "_stem").select("text_path", "media_path")
    return pairs, texts.select("text_path").distinct().join(pairs, "text_path", "left_anti")


def overlapping(a: DataFrame, b: DataFrame, key: str, a_start: str, a_end: str, b_start: str, b_end: str) -> DataFrame:
    """Spans of `a` with the spans of `b` of the same key that they overlap or touch: one starts within the other."""
    first = near(a, b, key, a_start, b_start, b_end, 0.0)
    second = near(b, a, key, b_start, a_start, a_end, 0.0).where(F.col(b_start) > F.col(a_start))
    return first.where(F.col(a_end) >= F.col(a_start)).unionByName(second.where(F.col(b_end) >= F.col(b_start)))


def chapters_of(units: DataFrame, chapters: DataFrame, source: str, unit: str, at: str) -> DataFrame:
    """Each unit with the first chapter (`start`, `end`, `position`, `title`) of its source that holds its time; the end isn't held."""
    held = near(units, chapters, source, at, "start", "end", 0.0, open_end=True)
    return held.groupBy(unit).agg(F.min_by("title", "position").alias("chapter"))


def resolved_files(references: DataFrame, files: DataFrame) -> DataFrame:
    """References (`reference`) with the file (`path`) that they mean: the path itself, else the only file of that name; null where none is, or several are."""
    direct = files.select(F.col("path").alias("_direct")).distinct()
    by_name = files.select("path").distinct().groupBy(base_name(F.col("path")).alias("_name")).agg(F.count("*").alias("_n"), F.first("path").alias("_only")).where("_n = 1")
    own = references.join(direct, F.col("reference") == F.col("_direct"), "left").join(by_name, base_name(F.col("reference")) == F.col("_name"), "left")
    return own.withColumn("path", F.coalesce("_direct", "_only")).drop("_direct", "_name", "_n", "_only")


def without_inline(sources: DataFrame, attachments: DataFrame) -> DataFrame:
    """Sources (`path`) that no message has shown inline already."""
    return sources.join(attachments.select("path").where("path IS NOT NULL").distinct(), "path", "left_anti")


def to_be_annotated(units: DataFrame, annotations: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Units without an annotation of a kind yet; null keys are equal."""
    done = annotations.where(F.col("kind") == kind).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return units.join(done, same, "left_anti")


def permitted(kind: Column, allow: list[str] | None, deny: list[str]) -> Column:
    """Whether a kind of capability is registered: none that is denied, and only those on the list where there is one."""
    listed = F.lit(True) if allow is None else kind.isin(*allow) if allow else F.lit(False)
    return listed & ~(kind.isin(*deny) if deny else F.lit(False))


def searchable(kind: Column, attributes: Column) -> Column:
    """Whether an annotation belongs to the hidden text of its page; `attributes` is a map."""
    value = lambda key: F.try_element_at(attributes, F.lit(key))
    plain = kind.isin("ocr", "caption", "transcript", "object", "face", "barcode")
    entity = kind.isin("custom", "timestamp") & value("entity").isNotNull()
    return plain | entity | ((kind == "scene") & value("entity").eqNullSafe(F.lit("scene-tag"))) | ((kind == "location") & value("source").eqNullSafe(F.lit("text")))


def annotation_line(kind: Column, provider: Column, text: Column, iso: Column) -> Column:
    """`[Kind][provider] text`, with the date in brackets where it is known."""
    line = F.concat(F.lit("["), F.initcap(kind), F.lit("]["), F.coalesce(provider, F.lit("")), F.lit("] "), F.coalesce(text, F.lit("")))
    return F.when(iso.isNotNull(), F.concat(line, F.lit(" ("), iso, F.lit(")"))).otherwise(line)


def folders_outline(links: DataFrame, key: str) -> DataFrame:
    """The tree of folders (`folders`, outermost first) of a document: `key`, `depth` (from 1), `folder` (the path), `page_first`."""
    levels = links.where(F.size("folders") > 0).select(key, "page_first", F.posexplode("folders").alias("_p", "_name"), "folders")
    return levels.groupBy(key, (F.col("_p") + 1).alias("depth"), F.array_join(F.expr("slice(folders, 1, _p + 1)"), "/").alias("folder")).agg(F.min("page_first").alias("page_first"))


def first_only(annotations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each source's annotations the first alone, as for the position that belongs to a whole source."""
    return annotations.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def reparented(members: DataFrame, containers: DataFrame) -> DataFrame:
    """Units of members (`unit_id`, `source_id`, `metadata`) under their container (`source_id`, `container_id`, `member`): the innermost name of a member stays."""
    own = members.join(containers, "source_id", "left")
    name = F.when(F.col("member").isNotNull(), F.create_map(F.lit("container.member"), F.col("member"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(name, lambda k, v: ~F.map_contains_key("metadata", k))
    return own.select("unit_id", F.coalesce("container_id", "source_id").alias("source_id"), F.map_concat("metadata", kept).alias("metadata"))


def pooled(scores: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """A model's scores (`label`, `score`) as events: labels that mean the same event (`label`, `event`) count by their highest score; others are dropped."""
    return scores.join(F.broadcast(names), "label").groupBy(*keys, "event").agg(F.max("score").alias("score"))  # names: a model's own labels


def backoff(failures: Column, first: float = 5.0, most: float = 300.0) -> Column:
    """Seconds before a connection is tried again: doubled with each failure, up to a bound."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(30)).cast("double")))
