"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import oracles
from stallwise.session import cut_lineage


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def encoded_digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``ids``, and the digests of the ids and of the text decoded from them."""
    import public_tokenizers as tokenizers

    from stallwise.llm import byte_bpe

    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs, ranks, tokenizers.PATTERN, keep=keep, decoded=True).select(
        *keep,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir), ["doc_id"]).drop("ids")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import order_minhash

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return order_minhash.against_next(documents(spark, sf_dir), parts)


#: op9's rules; the longest that fits decides.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import mixing

    sizes = cut_lineage(mixing.sized(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text"))
    return mixing.mix(sizes, weights=[5, 2, 1], share=1.5).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import quality

    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return quality.judge(docs).drop("lang", "text", "class_distance", "word_distance")


def fold(column: str, parts: int) -> Column:
    """Part of a row by the checksum of its id's text (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, learnt from the labels outside the held-out fold."""
    from stallwise.llm import toxicity
    from stallwise.llm.memory import give_back

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = toxicity.training_rows(docs, labels, fold("doc_id", 4) == 2) or [("", 0)]
    model = toxicity.fit(*zip(*sample))
    del sample
    give_back()
    return toxicity.score(docs, model, spans=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity_scores(spark, docs, sf_dir).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import pitman_yor

    held_out = fold("doc_id", 7) == 2
    return pitman_yor.score(documents(spark, sf_dir), held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` by the pieces and scores of ``piece_bpe_32k.model``, taken as a unigram vocabulary."""
    import public_tokenizers as tokenizers

    from stallwise.llm import token_counts

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count(docs, token_counts.load_pieces(tokenizers.path("piece_bpe_32k.model"))).drop("text")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import jaccard_join

    return jaccard_join.join(documents(spark, sf_dir), k=5, percent=80)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import url_filter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import sharding

    docs = documents(spark, sf_dir).select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = cut_lineage(sharding.with_keys(docs).withColumn("text_crc32", crc).drop("text"))
    return sharding.assign(keyed, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversation c as the first h turns of conversation c - c % 5 and its own turns after its first h; h = crc32(c) % 9."""
    heads = turns.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 8).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    joined = turns.withColumn("_base", F.expr("conv_id - conv_id % 5")).join(heads, "_base", "left")
    return joined.select("conv_id", F.when(F.col("_head").isNull(), own).otherwise(F.concat(F.slice("_head", F.lit(1), h), own)).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import prefix_trie

    turns = cut_lineage(prefix_trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie.trie(rebuilt(turns)).withColumnRenamed("saved", "saved_tokens")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id's checksum is a multiple of 7, the proof is tried with a leaf of one character more."""
    from stallwise.llm import merkle

    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = merkle.leaf_of(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    out = merkle.manifest(documents(spark, sf_dir), keep=(F.col("doc_id"), F.when(changed, other).alias("_other")))
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("_other", "leaf"), F.col("steps")))
    proof = merkle.digest(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stallwise.llm import private_spans

    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = private_spans.mark(docs, private_spans.fit(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in private_spans.KINDS]
    return out.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_order_minhash": op2_order_minhash,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_private_spans": op13_private_spans,
}
ORACLE_SQL: dict[str, str] = {"op3_mixing": oracles.OP3, "op4_quality": oracles.OP4, "op10_sharding": oracles.OP10, "op8_jaccard_join": oracles.OP8, "op9_url_filter": oracles.op9(URL_RULES), "op11_prefix_trie": oracles.OP11}
