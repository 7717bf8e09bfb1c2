"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from tidewater.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a field fitted to the labels of docs finds toxic go.

    Null and empty texts have the score of a text without tokens and stay; rows with a null id are scored too;
    repeated rows share one fate; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated within a source go, by a ratio that falls with their length; every document stays.

    n_chars follows a text that lost lines. Null sources are one source, null texts stay null, repeated rows are one
    page and lose the same lines; an empty table stays empty.
    """
    out = line_dedup.drop_repeats(docs)
    length = F.when(F.col(out.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word shingle similarity of 0.8 or more stays, the least doc_id.

    Texts without words (null, empty) have no copies and stay, as do rows with a null id; of rows with one doc_id
    one stays; an empty table stays empty.
    """
    return near_dup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, in whatever case or with other numbers, names and units, go.

    Null and empty texts hold none; rows with a null id stay; rows with one doc_id go together; an empty table stays empty.
    """
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws by temperature, no source more than twice; columns of documents, then epoch and position (0 to 1).

    A null source is the empty one; texts without words are drawn with their source's whole epochs; rows with one
    doc_id are drawn together; sources without any word, and an empty table, give no rows.
    """
    out = mixing.mix(docs, repeats=2.0)
    epoch, position = out.columns[-3:-1]
    return out.select(*docs.columns, F.col(epoch).alias("epoch"), F.col(position).alias("position"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dup", drop_copies), ("decontamination", drop_leaks), ("mixing", mix_sources)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the table of a stage goes when the next is written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.free(docs)
    return docs
