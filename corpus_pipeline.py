"""A corpus pipeline over ``documents``: quality, line dedup, near-duplicate texts, contamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but
the last return the columns of ``documents``; the last one returns a row per remaining document
with its token count and the digests of its ids and of the text decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import codec, decontaminate, line_dedup, quality_gam, simhash
from panelwright.llm.runtime import new_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _by_place(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns named by their place, which no name that an operator adds can clash with; its id and text."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labels, doesn't reject.

    Null and empty texts are scored as texts without words; a row's fate depends on its text alone,
    so repeated rows stay or go together; long texts are read whole; no rows give no rows.
    """
    model = quality_gam.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    placed, _, text = _by_place(docs)
    return quality_gam.score_quality(placed, model, text).where("predicted = 1").drop("score", "predicted").toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat or nearly repeat one that stays elsewhere; ``n_chars`` follows the text.

    Null texts stay null, empty ones empty; of ties the document with the smallest id keeps the
    line; rows that repeat id and text keep the same lines; no rows give no rows.
    """
    placed, doc_id, text = _by_place(docs)
    left = line_dedup.dedup_lines(placed, doc_id, text).drop("n_lines", "n_dropped").toDF(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts the document with the smallest id, null ids after all others.

    Null and empty texts are one group; of rows that repeat id and text one stays; no rows give no rows.
    """
    return simhash.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items.

    Null and empty texts stay; repeated rows stay or go together; long texts are scanned whole; no
    rows, or no benchmark, change nothing.
    """
    placed, _, text = _by_place(docs)
    found = decontaminate.contamination(placed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text)
    return found.where("not contaminated").select(placed.columns).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, and digests of its ids and of what they decode to; a null text counts as empty."""
    return codec.digests(codec.round_trip(docs, TOKENIZER, keep=["doc_id"]))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("contamination", contamination), ("tokens", tokens)]

#: SQL can't express the learned model; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
