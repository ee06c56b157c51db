"""From raw documents to packed training bins.

Every stage works on all that the one before kept. Between stages the
documents are written as a Parquet table in the shared checkpoint folder and
read again, so a lost executor costs at most the running stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tox
from tidemark.llm.common import learnable, table
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.near_duplicates import near_duplicates
from tidemark.llm.packing import best_fit
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.session import checkpointed, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not call toxic, trained on the labelled ones it may learn from."""
    labels = table(spark, sf_dir, "labels").filter(learnable()).select("doc_id", F.col("toxic").alias("label"))
    sample = tox.labelled_sample(docs, labels)
    model = tox.train(sample)
    release(sample)
    # Under names of our own: documents may have columns called score or predicted.
    scored = tox.score(docs, model, score_col="__score", predicted_col="__toxic")
    return scored.filter(F.col("__toxic") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles, that with the smallest id."""
    found = checkpointed(near_duplicates(docs, words=5, percent=80, with_texts=True))
    # By id and text: ids may be null or come more than once.
    kept = found.filter("kept").select(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__text"))
    ids = kept.distinct()
    out = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("__kept")) & (F.xxhash64(docs["text"]) == F.col("__text")), "left_semi")
    # Rows that come more than once are one document.
    return out if kept.count() == ids.count() else out.dropDuplicates(["doc_id", "text"])


#: Where passages that were cut have words of the benchmark: the text with these left in, for the next stage; else null.
WITH_ITEMS = "__with_items"


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages of 400 bytes that occur elsewhere, or of 50 words
    in another document; words of the benchmark go like others."""
    done = remove_repeats(docs, length=400, words=50, spare=table(spark, sf_dir, "benchmark").select("text"), spared_col=WITH_ITEMS)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*(c for c in docs.columns if c != WITH_ITEMS), WITH_ITEMS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is cut, with words of the benchmark left in: texts as the next stage looks at them."""
    seen = cut_passages(spark, docs, sf_dir).withColumn("text", F.coalesce(WITH_ITEMS, "text"))
    return seen.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; one that lost it with a passage of words had it."""
    benchmark = table(spark, sf_dir, "benchmark")
    if WITH_ITEMS not in docs.columns:
        return drop_contaminated(docs, benchmark)
    seen = docs.withColumn("__seen", F.coalesce(WITH_ITEMS, "text"))
    return drop_contaminated(seen, benchmark, text_col="__seen").drop("__seen", WITH_ITEMS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents in bins."""
    return best_fit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_passages),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: Sketches, suffix sorting and packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
