"""Facts of hot keys: the same rows as a plain join, dealt evenly."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stallwise.llm import joins, url_filter


@pytest.fixture
def shuffled(spark):
    """No side is broadcast for its size and no partitions are put together."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_facts_of_hot_keys(shuffled, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS", 8)
    keys = [("h", "s")] * 1000 + [(None, "s")] * 600 + [("h", None)] * 200 + [(f"h{i}", "s") for i in range(200)] + [("absent", "s")] * 5
    rows = [(*k, i) for i, k in enumerate(keys)]
    counts = Counter(keys)
    facts = [(*k, n, f"fact {k}", n if n > 1 else None) for k, n in counts.items() if None not in k and k[0] != "absent"]
    table = shuffled.createDataFrame(rows, "host string, shape string, i long").repartition(5)
    known = shuffled.createDataFrame(facts, "host string, shape string, _rows long, fact string, more long")
    out = joins.with_facts(table, known, ["host", "shape"], len(rows), ["i"])
    assert out.columns == ["host", "shape", "i", "fact", "more"]
    plain = {f[:2]: f[3:] for f in facts}
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((*r, *plain.get(r[:2], (None, None)))) for r in rows)
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 16 and max(tasks) < 3 * len(rows) / 16
    assert joins.with_facts(table.limit(0), known.limit(0), ["host", "shape"], 0, ["i"]).count() == 0


def test_verdicts_do_not_depend_on_what_is_hot(shuffled, monkeypatch):
    rules = [("block", "a.org/x/"), ("allow", "a.org/y/")]
    urls = ["http://a.org/x/1"] * 300 + [f"http://a.org/x/{'abc'[i % 3]}/{i}" for i in range(60)] + [f"http://b.org/{'xy'[i % 2]}/{i}" for i in range(40)]
    urls += [f"http://h{i}.org/x/{i}" for i in range(50)] + [f"http://a.org/y/p{i % 4}/q/{i}/r/s" for i in range(40)] + [None, None, "", "no scheme"]
    table = shuffled.createDataFrame([(i % 400, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"_key": F.lit(1), "n": F.create_map(F.lit("a"), F.lit(2))})
    got = []
    for most in (1, 8, 1024):
        monkeypatch.setattr(joins, "HOT_KEYS", most)
        got.append(sorted(map(repr, url_filter.judge(table, rules).select("page_id", "url", "template", "purity", "verdict", "_key").collect())))
    assert len(got[0]) == len(urls) and got[0] == got[1] == got[2] and {"'block'", "'allow'"} <= {r.split("verdict=")[1].split(",")[0] for r in got[0]}
