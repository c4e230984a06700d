"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its
predecessor kept; all but the last return the columns of `documents`. Between
stages the rows are written as Parquet in the shared folder and read again.
Every stage gives an empty table for an empty one, and further columns of docs,
whatever their names, are carried along by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatarium.llm import bpe, common, jaccard_join, line_dedup, quality_rules, source_mix


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject. Documents without 20 words go, so
    null and empty texts do; a null language is a language of its own; repeated rows are
    judged alike and stay apart."""
    return quality_rules.apply_rules(docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are frequent in their source, however few pages it has;
    n_chars follows the text. No document goes; a null text stays null, with a null
    n_chars; a null source is a source; copies of a text count as one page."""
    cleaned = line_dedup.drop_boilerplate(docs, host="source", copies_once=True)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at 0.8 on five-word shingles, one of each group stays: the
    one with the smallest doc_id. Documents without words, and rows without doc_id,
    link with nothing and stay; of rows that share a doc_id one stays."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not, once or twice.
    Documents without words are never taken; a null source is the last one."""
    return source_mix.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix: doc_id, lang, source, n_tokens and
    ids as little-endian unsigned 32-bit integers. A null or empty text has no ids."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_text=False)
    return coded.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids")


class _Stage:
    """A stage that gives back the disk of the one before. A stage gets its docs from a table, so
    what its predecessor wrote on the way there is read by nothing any more."""

    before: tuple[int, list[str]] = (-1, [])

    def __init__(self, place: int, work):
        self.place, self.work = place, work
        self.__name__, self.__doc__ = work.__name__, work.__doc__

    def __call__(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _Stage.before[0] == self.place - 1:
            common.release_paths(spark, _Stage.before[1])
        with common.recorded() as made:
            out = self.work(spark, docs, sf_dir)
        _Stage.before = self.place, made
        return out


STAGES = [(f.__name__, _Stage(k, f)) for k, f in enumerate((quality, site_lines, near_copies, mixing, encoding))]

#: Component search and BPE are beyond SQL; tests/llm/test_pipeline.py holds run(), and each
#: stage, against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
