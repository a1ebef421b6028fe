"""From raw documents to an encoded training mix, in five stages.

Each stage takes the documents that the one before kept. The stages carry a document's
columns as one value, so columns may be called like an operator's own. Rows that their
id does not tell apart (a null id, or one id with several texts) are never dropped as
near copies. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import jaccard_join, mixing, quality
from stallwise.llm.queries import encoded_digests, toxicity_scores
from stallwise.session import cut_lineage


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator needs, and the whole row as ``_doc``."""
    return docs.select(*needed, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field does not call toxic."""
    return toxicity_scores(spark, carried(docs, "doc_id", "text"), sf_dir).filter("predicted = 0").select("_doc.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's reference."""
    return quality.judge(carried(docs, "lang", "text")).filter("kept").select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that five-word shingles at 0.8 connect.

    Of rows with one id and one text one stays. Rows of an id with several texts all stay,
    one a text, and so do rows without an id.
    """
    groups = jaccard_join.join(docs.select("doc_id", "text"), k=5, percent=80)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    print_ = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_print")
    several = docs.filter("doc_id IS NOT NULL").select("doc_id", print_).groupBy("doc_id").agg(F.min("_print").alias("_a"), F.max("_print").alias("_b"))
    stay = first.unionByName(several.filter("_a <> _b").select("doc_id")).distinct()
    rows = carried(docs, "doc_id", print_)
    kept = rows.join(stay.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "_print"])
    return kept.unionByName(rows.filter("doc_id IS NULL")).select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words over its size, rounded (0, 1 or 2 times)."""
    sizes = cut_lineage(mixing.sized(docs.select("doc_id", "source", "text")).drop("text"))
    mixed = mixing.mix(sizes, weights=[5, 2, 1], share=1.5).groupBy(F.col("doc_id").alias("_id"))
    times = mixed.agg(F.coalesce(F.round(F.try_divide(F.sum("taken"), F.sum("size"))), F.lit(1)).cast("int").alias("_times"))
    rows = carried(docs, "doc_id")
    joined = rows.join(times.filter("_times > 0").hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("_id")))
    return joined.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, their number, and the digests of ids and decoded text."""
    return encoded_digests(docs, ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: A trained random field and the tokenizer's merges are beyond SQL; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is cut before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
