from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stallwise.functions import text as X


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


PRICES = {
    "KSh 1,299": 1299, "Ksh1299": 1299, "1,299/=": 1299, "1.5k": 1500, "2500 bob": 2500, "KSh 1,299 - KSh 2,400": 1299, "KES 12 to 90": 12,
    "5 kg": 5000, "1,299.50": 1299, "1.299": None, "12,34": 12, "4.5": None, "KSh 5": None, "999,999,999": None, "Contact seller": None, "": None, None: None,
}


def test_parse_price(spark):
    assert apply(spark, X.parse_price, PRICES) == [None if v is None else D(v) for v in PRICES.values()]


def test_parse_price_range(spark):
    got = apply(spark, X.parse_price_range, ["KSh 1,200 - KSh 500", "KSh 500 - contact us", "KSh 700", None, "10 to 20 to 30"])
    assert [r and (int(r["low"]), int(r["high"])) for r in got] == [(500, 1200), None, (700, 700), None, (10, 20)]


def test_clean_title(spark):
    got = apply(spark, X.clean_title, ["BRAND NEW Original 20000mAh Power Bank Fast Charging [FREE SHIPPING]", " - (x) ", None, "A|b_C."])
    assert got == ["20000mah power bank fast charging", None, None, "a b c"]


def test_specs(spark):
    got = apply(spark, X.extract_specs, ["Phone 8GB RAM 128GB 6.5 inch 5000mAh", "nothing", None, "Rice 5kg 2 pcs 1.5l"])
    assert got[0] == {"storage_gb": 8.0, "memory_gb": 8.0, "screen_inch": 6.5, "capacity_mah": 5000.0}
    assert got[1] == {} and got[2] is None and got[3] == {"weight_kg": 5.0, "pack_count": 2.0, "volume_litre": 1.5}


def test_sku_fold_and_forms(spark):
    assert apply(spark, lambda c: X.normalise_sku(F.lit("p"), c), [" AB 12/x ", "--", None]) == ["p:ab-12-x", None, None]
    assert apply(spark, X.fold, ["Power-Bank!!", "Crème  Brûlée", None]) == ["power bank", "creme brulee", ""]
    assert apply(spark, lambda c: X.strip_stopwords(X.fold(c)), ["what do power banks cost", "the best"]) == ["power banks", "the best"]
    # both sides of a comparison are cut alike, so "cas" for "cases" is no harm
    assert apply(spark, X.singularise, ["batteries cases glass banks us"]) == ["battery cas glass bank us"]
    assert len(apply(spark, lambda c: X.pseudonym(c, "s"), [" A@b.c "])[0]) == 16


@pytest.mark.parametrize("n", [1, 2, 3, 30, 31, 47])
def test_quantiles_are_exact(spark, n):
    import random

    from stallwise.operators.rollup import quantiles

    rnd = random.Random(n)
    values = sorted(D(rnd.randrange(1000, 4000)) / 100 for _ in range(n))
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "k string, price_kes decimal(12,2)").repartition(3)

    def brute(q):
        at = D(str(q)) * (n - 1)
        lo = int(at)
        hi = min(lo + 1, n - 1)
        return (values[lo] + (values[hi] - values[lo]) * (at - lo)).quantize(D("0.01"), rounding="ROUND_HALF_UP")

    assert tuple(quantiles(df, ["k"]).first()) == ("g", brute(0.25), brute(0.5), brute(0.75))
