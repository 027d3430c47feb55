"""Queries of full-text search, and what is done with its hits."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import STOPWORDS


@dataclass(frozen=True)
class Term:
    """Consecutive tokens; the last one may be a prefix."""

    tokens: tuple[str, ...]
    prefix: bool = False


def _fold(text: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def parse_query(text: str) -> list[Term]:
    """Words and quoted phrases, all required; a word that ends in * is a prefix; what has no letter or digit is dropped."""
    terms = []
    for k, part in enumerate(text.split('"')):
        for word in [part] if k % 2 else part.split():
            tokens = _fold(word)
            if tokens:
                terms.append(Term(tuple(tokens), k % 2 == 0 and word.endswith("*")))
    return terms


def without_chunk_echo(hits: DataFrame) -> DataFrame:
    """Drop a unit's `chunk` hit where an entry of another kind of the same unit is a hit too."""
    other = hits.where("kind <> 'chunk'").select(F.col("document_id").alias("_d"), F.col("unit_id").alias("_u")).distinct()
    echo = (F.col("kind") == "chunk") & F.col("document_id").eqNullSafe(F.col("_d")) & F.col("unit_id").eqNullSafe(F.col("_u"))
    return hits.join(other, echo, "left_anti")


def question_terms(question: str) -> list[str]:
    """The words of a question that are searched for, each once."""
    return [w for w in dict.fromkeys(re.findall(r"[^\W_]+", question.lower())) if w not in STOPWORDS]
