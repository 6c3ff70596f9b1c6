"""A training-data pipeline over the table `documents`: five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Prediction and sampling cannot be said in SQL, so ORACLE_SQL is None and the
tests hold the stages against brute force on a small corpus.

Defined cases are those of the operators: null and empty texts go in the first stage (no language can be read from them),
null ids, repeated rows and extra columns pass through every stage, empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import stored, table
from gleanery.llm.language import UNKNOWN, identify, train
from gleanery.llm.mixing import mix
from gleanery.llm.near_dedup import keep_one
from gleanery.llm.packing import pack, token_pieces
from gleanery.llm.suffix_dedup import without_repeats

#: Least mean probability of the predicted language, in multiples of an even guess among all learned ones.
LEAST_SCORE = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without letters, null or empty go, and hardly told ones."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    net = train(docs)
    classes = len(net.labels) if net else 0
    least = LEAST_SCORE / classes if classes > 1 else 0.0
    found = identify(rows, net, keep=("doc",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 of their five-word shingles."""
    return keep_one(docs, words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes that occur elsewhere too; n_chars is counted anew."""
    kept = without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; sources weigh 1, 2, 3 by turns."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "source")
    taken = mix(rows, keep=("doc",)).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 2048 tokens."""
    return pack(token_pieces(docs, ids=False))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
