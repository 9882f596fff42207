"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing, over `documents`.

What holds for all stages: null, empty and wordless texts, very long ones, ties, repeated rows and ids that repeat or are null
never fail; every row is judged by its own text (and language and source where the stage uses them), so rows that are equal
in these fare alike, and no row goes because another one with its id does. An empty table gives an empty one. Columns
beyond those of documents are kept by all stages but the last, whatever their names; but __tidemark_key and __tidemark_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, langid, line_dedup, near_join, packing
from tidemark.llm.common import cut, drop_since, mark
from tidemark.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay. Texts without a letter (null and empty ones, too) have none and go; a null language
    or source is no evidence; ties go to the language named first."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents' texts; a document that held nothing else goes with them. Null texts
    and those without lines have nothing to lose and stay; documents without a source share one; copies of a page count once."""
    found = line_dedup.dedup_lines(docs, long_ratio=line_dedup.LONG_RATIO, spare=False)
    return found.where("n_dropped = 0 or n_dropped < n_lines").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the least id, null ids last, then the least key of a text. Texts without
    words are near to nothing and stay; a text of fewer than five words is one shingle."""
    return near_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Texts without words stay; without items, all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, by sequence. A null text is packed as an empty one: its end mark alone. Ids may
    repeat or be null; each row is packed. Other columns are not read."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("pack", pack)]

#: Packing has no SQL form; tests/llm hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep. A stage's result is written, then all tables that led to it are deleted."""
    docs, point = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop_since(spark, point)
    return STAGES[-1][1](spark, docs, sf_dir)
