"""Findings of the fourth review: no task gets a group."""

import random
from decimal import Decimal

from stallwise.operators import rollup

PRICED = "category_code string, platform_code string, price_kes {}, title string, seller_name string, source_url string, at int"


def nearest(rows, limit):
    """Each group's rows nearest its upper middle price, by sorting the group."""
    groups = {}
    for r in rows:
        if None not in (r[0], r[1], r[2], r[5]) and r[2] > 0:
            groups.setdefault(r[:2], []).append(r)
    out = []
    for key, own in groups.items():
        middle = sorted(r[2] for r in own)[len(own) // 2]
        out += [(*key, i + 1, r[2], r[5]) for i, r in enumerate(sorted(own, key=lambda r: (abs(r[2] - middle), r[6]))[:limit])]
    return sorted(out)


def test_examples_meet_their_group_by_price(spark):
    """all rows of a group were sorted by one task; they meet the middle only by price or cell, with the same examples."""
    rng = random.Random(1)
    cents = {
        "wide": lambda: int(10 ** rng.uniform(0, 11.9)), "dense": lambda: rng.randint(4_000_000, 4_000_900), "two": lambda: rng.choice([100, 10**9]), "one": lambda: 777,
        "sides": lambda: 5_000 + 700 * rng.randint(-2, 2), "odd": lambda: rng.choice([None, 0, -5, 1, 2, 99_999]), None: lambda: 5,
    }
    rows = [(c, p, None if (v := cents[c]()) is None else Decimal(v) / 100, "t", "s", None if c == "odd" and i % 7 == 0 else f"u{i}") for c in cents for p in ("a", "b", None) for i in range(rng.choice([1, 2, 60, 301]))]
    rows += [("few", "a", Decimal(9), "t", "s", "x"), ("few", "a", Decimal("0.01"), "t", "s", "y")]
    rows = [(*r, i) for i, r in enumerate(rng.sample(rows, len(rows)))]
    listings = spark.createDataFrame(rows, PRICED.format("decimal(12,2)")).repartition(5)
    for limit in (1, 3, 8):
        out = rollup.example_listings(listings, ["at"], limit)
        assert sorted((r["category_code"], r["platform_code"], r["rank"], r["price_kes"], r["url"]) for r in out.collect()) == nearest(rows, limit)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("price_kes" in j or "_cell" in j for j in joins), joins


def test_examples_of_other_numbers(spark):
    rng = random.Random(2)
    for kind, price in (("int", lambda: rng.randint(-3, 40)), ("double", lambda: rng.choice([rng.uniform(0, 1e-3), rng.uniform(1, 2), 1e12, 0.0]))):
        rows = [(rng.choice("cd"), "p", price(), "t", "s", f"u{i}", i) for i in range(400)]
        out = rollup.example_listings(spark.createDataFrame(rows, PRICED.format(kind)), ["at"])
        assert sorted((r["category_code"], "p", r["rank"], r["price_kes"], r["url"]) for r in out.collect()) == nearest(rows, 3)
