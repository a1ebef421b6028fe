"""The stages one by one against what they promise, and run() against the stages."""

import base64
import hashlib
import math

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stallwise.llm import jaccard_join, oracles
from stallwise.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF)))
    return out


def test_stages_keep_columns_and_rows_come_from_the_stage_before(staged):
    for before, after in zip(staged, staged[1:-1]):
        assert after.columns == staged[0].columns
        assert after.distinct().join(before.distinct(), after.columns, "left_anti").count() == 0
    assert staged[0].count() > staged[3].count() > 0


def in_sql(rows, sql):
    """DuckDB's result of ``sql`` over ``rows`` as the table documents."""
    c = duckdb.connect()
    documents = pa.Table.from_pylist([r.asDict() for r in rows.drop("extra").collect()])
    c.register("documents", documents)
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def test_quality_stage(staged):
    """Against the rules in SQL."""
    kept = {r["doc_id"] for r in in_sql(staged[1], oracles.OP4) if r["kept"]}
    assert {r["doc_id"] for r in staged[2].collect()} == kept


def test_one_document_of_each_group_stays(staged):
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(staged[2]).collect()}
    assert sorted(r["doc_id"] for r in staged[3].collect()) == sorted(set(groups.values()))


def test_no_text_of_a_shared_id_is_lost(spark):
    """One id with two unlike texts, a copy of one of them, rows without an id, and columns called like the operators'."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank string, score int, n_words string, predicted string, template string"
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(f"x{i}" for i in range(60)), " ".join([*words[:59], "y"])
    more = ("r", 7, "n", "p", "t")
    rows = [(1, a, "en", "s", 1, *more), (5, c, "en", "s", 1, *more), (5, b, "en", "s", 1, *more), (5, b, "en", "s", 1, *more), (6, c, "en", "s", 1, *more), (None, a, "en", "s", 1, *more)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(0, a), (1, a), (5, b), (5, c)])
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.schema == out.schema
        assert {tuple(r[5:]) for r in docs.collect()} <= {more}


def test_toxicity_stage_drops_what_the_field_calls_toxic(spark, staged):
    """Against the tagger run text by text, with the model of the same sample."""
    from stallwise.llm import toxicity
    from stallwise.llm.queries import fold

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = toxicity.training_rows(staged[0], labels, fold("doc_id", 4) == 2)
    model = toxicity.fit(*zip(*sample))
    want = {r["doc_id"] for r in staged[0].collect() if toxicity.tag(model, [r["text"]])[0][0] < 0.3}
    assert {r["doc_id"] for r in staged[1].collect()} == want


def test_near_copies_against_all_pairs(staged):
    """The documents that stay are the smallest ids of the groups that all pairs of sets give."""
    rows = [(r["doc_id"], set(zip(*[(r["text"] or "").encode().lower().split()[i:] for i in range(5)]))) for r in staged[2].collect()]
    group = {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, (i, x) in enumerate(rows):
        for j, y in rows[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert {r["doc_id"] for r in staged[3].collect()} == {root(i) for i, _ in rows}


def test_mixing_stage(staged):
    """Each document as often as the mix in SQL takes it, rounded."""
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in in_sql(staged[3], oracles.OP3)}
    want = {i: 1 if not size else math.floor(t / size + 0.5) for i, (t, size) in taken.items()}
    got = {r["doc_id"]: r["count"] for r in staged[4].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_encoding(staged):
    import public_tokenizers as tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in staged[4].collect()}
    out = staged[5].collect()
    assert len(out) == staged[4].count()
    for r in out:
        assert r["ids"] == own.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages(spark, staged):
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], r["ids_sha256"]) for r in staged[5].collect())


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
