"""Margins, platform costs and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
# The share of sales taken to be returned, and the lead below which an unknown fee makes it unproven.
RETURN_RATE = "0.05"
SMALL_LEAD = 30


def _money(value: Column) -> Column:
    """Rounded half to even to 0.01."""
    return F.bround(value, 2).cast(MONEY)


def landed_cost_ceiling(rows: DataFrame, target: str = "0.30") -> DataFrame:
    """``rows`` (``median``, ``commission_rate``, ``last_mile_kes``) with the most a unit may cost to keep the target margin.

    A missing input makes the row a refusal that names it.
    """
    price, rate, mile = F.col("median"), F.col("commission_rate"), F.col("last_mile_kes")
    missing = F.array_compact(
        F.array(F.when(rate.isNull(), "category commission rate"), F.when(mile.isNull(), "last mile cost for this county"))
    )
    out = rows.withColumn("missing", missing).withColumn("margin_available", (F.size("missing") == 0) & price.isNotNull())
    ok = F.col("margin_available")
    out = out.withColumn("commission_kes", F.when(ok, _money(price * rate)))
    out = out.withColumn("net_receipt_kes", F.when(ok, (price - F.col("commission_kes") - mile).cast(MONEY)))
    out = out.withColumn("required_margin_kes", F.when(ok, _money(price * F.lit(target).cast("decimal(3,2)"))))
    out = out.withColumn("landed_cost_ceiling_kes", F.when(ok, (F.col("net_receipt_kes") - F.col("required_margin_kes")).cast(MONEY)))
    return out.withColumn("viable", F.when(ok, F.col("landed_cost_ceiling_kes") > 0))


def other_fees(policy: DataFrame, return_rate: str = RETURN_RATE, include_returns: bool = True) -> DataFrame:
    """Per platform the itemised fees besides commission and delivery, their sum, and whether a return fee is unknown.

    A fee per return counts at the return rate, one per unit and month in full; others are for no single sale.
    """
    fee = policy.select("platform_code", F.explode_outer("fees").alias("fee"))
    value, basis = F.col("fee.value"), F.col("fee.basis")
    amount = F.when((basis == "per_return") & F.lit(include_returns), _money(value * F.lit(return_rate).cast("decimal(5,4)"))).when(
        (basis == "per_unit_per_month") & (value != 0), value.cast(MONEY)
    )
    item = F.when(amount.isNotNull(), F.struct(F.concat(F.col("fee.name"), F.when(basis == "per_return", " provision").otherwise("")).alias("name"), amount.alias("amount_kes")))
    return fee.groupBy("platform_code").agg(
        F.coalesce(F.sum(amount), F.lit(0)).cast(MONEY).alias("other_fees_kes"),
        F.array_sort(F.collect_list(item)).alias("other_fees"),
        F.coalesce(F.bool_or((basis == "per_return") & value.isNull() & F.lit(include_returns)), F.lit(False)).alias("return_fee_unknown"),
    )


def platform_costs(sales: DataFrame, policy: DataFrame, rates: DataFrame, delivery: DataFrame, return_rate: str = RETURN_RATE) -> DataFrame:
    """``sales`` (``platform_code``, ``category_code``, ``county_code``, ``sale_price``) with what one sale costs.

    ``policy`` has ``name``, ``per_category_rates_apply``, ``range_low``, ``range_high``,
    ``payout_days`` and ``fees``. A category's rate holds only on the platform whose
    schedule it is; elsewhere the middle of the published band stands in, and is named so.
    """
    terms = policy.select("platform_code", F.col("name").alias("platform_name"), "per_category_rates_apply", "range_low", "range_high", "payout_days")
    out = (
        sales.join(terms, "platform_code")
        .join(other_fees(policy, return_rate), "platform_code", "left")
        .join(rates.select("category_code", F.col("commission_rate").alias("_own")), "category_code", "left")
        .join(delivery.select("platform_code", "county_code", F.col("door_delivery").alias("last_mile_kes")), ["platform_code", "county_code"], "left")
    )
    own = F.when(F.col("per_category_rates_apply"), F.col("_own"))
    middle = F.bround((F.col("range_low") + F.col("range_high")) / 2, 4).cast("decimal(5,4)")
    price = F.col("sale_price")
    out = out.withColumn("commission_rate", F.coalesce(own, middle)).withColumn("commission_kes", _money(price * F.col("commission_rate")))
    notes = F.array_compact(
        F.array(
            F.when(own.isNull() & middle.isNotNull(), "commission is the middle of the published band"),
            F.when(F.col("commission_rate").isNull(), "no commission figure confirmed"),
            F.when(F.col("last_mile_kes").isNull(), "no delivery figure for the county"),
            F.when(F.col("return_fee_unknown"), "return handling fee not confirmed"),
        )
    )
    net = (price - F.col("commission_kes") - F.col("last_mile_kes") - F.coalesce("other_fees_kes", F.lit(0))).cast(MONEY)
    out = out.withColumn("unconfirmed", notes).withColumn("net_receipt_kes", net)
    take = F.when(price > 0, F.round(((price - F.col("net_receipt_kes")) / price).cast("double"), 4))
    return out.withColumn("take_rate", take).drop("_own", "per_category_rates_apply", "range_low", "range_high", "return_fee_unknown")


def rank_platforms(costs: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """``costs`` with their rank by what the seller keeps (those without a figure last), the lead over the next, and the fastest payer."""
    ranked = Window.partitionBy(*within).orderBy(F.col("net_receipt_kes").isNull(), F.desc("net_receipt_kes"), *order)
    group = Window.partitionBy(*within)
    known = F.col("net_receipt_kes").isNotNull()
    out = costs.withColumn("comparable", known).withColumn("rank", F.row_number().over(ranked))
    out = out.withColumn("lead_kes", F.when(known, (F.col("net_receipt_kes") - F.lead("net_receipt_kes").over(ranked)).cast(MONEY)))
    fastest = F.min(F.when(known & F.col("payout_days").isNotNull() & (F.col("payout_days") > 0), F.struct("payout_days", "rank", "platform_code")))
    return out.withColumn("fastest_payer", fastest.over(group)["platform_code"])


def market_sales(rollups: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted (category, platform, county) with that platform's own figures, and the gap where there are none."""
    figures = rollups.select("category_code", "platform_code", "available", "observation_count", "seller_count", "median", "p25", "p75", "collected_on")
    out = wanted.join(figures, ["category_code", "platform_code"], "left")
    gap = F.when(F.col("available").isNull(), "not collected yet").when(~F.col("available"), F.concat(F.lit("only "), F.col("observation_count").cast("string"), F.lit(" listings collected")))
    return out.withColumn("gap", gap).withColumn("sale_price", F.col("median"))


def compare_market(rollups: DataFrame, wanted: DataFrame, policy: DataFrame, rates: DataFrame, delivery: DataFrame) -> DataFrame:
    """The columns of the comparison for all wanted categories, platforms and counties, ranked within (category, county)."""
    costs = platform_costs(market_sales(rollups, wanted), policy, rates, delivery)
    gaps = F.when(F.col("sale_price").isNull(), F.array_compact(F.array("gap"))).otherwise(F.col("unconfirmed"))
    return rank_platforms(costs.withColumn("gaps", gaps), ["category_code", "county_code"], ["platform_code"]).drop("gap", "unconfirmed")


def compare_at_price(sales: DataFrame, policy: DataFrame, rates: DataFrame, delivery: DataFrame) -> DataFrame:
    """What one sale at the same price leaves on every platform that has a delivery row for its county, ranked.

    ``sales`` has ``category_code`` (empty: no category's rate holds), ``county_code`` and ``sale_price``,
    one row a category and county. A platform without a commission or a delivery figure comes last, with its gaps.
    """
    everywhere = sales.join(delivery.select("platform_code", "county_code"), "county_code")
    out = platform_costs(everywhere, policy, rates, delivery).withColumnRenamed("unconfirmed", "gaps")
    return rank_platforms(out, ["category_code", "county_code"], ["platform_code"])


def verdicts(columns: DataFrame, symbol: str = "KSh") -> DataFrame:
    """One row a (category, county): who leaves the seller most, by how much, and whether the lead is proven."""
    ranked = F.col("comparable")
    grouped = columns.groupBy("category_code", "county_code").agg(
        F.min_by("platform_code", "rank").alias("_first"),
        F.max(F.when(F.col("rank") == 1, ranked)).alias("decided"),
        F.max(F.when(F.col("rank") == 1, F.col("net_receipt_kes"))).alias("net_receipt_kes"),
        F.max(F.when(F.col("rank") == 1, F.col("sale_price"))).alias("sale_price"),
        F.max(F.when(F.col("rank") == 1, F.col("lead_kes"))).alias("lead_kes"),
        F.max(F.when((F.col("rank") == 2) & ranked, F.col("platform_code"))).alias("runner_up"),
        F.bool_or(ranked & F.exists("gaps", lambda g: g.contains("not confirmed"))).alias("_unknown_fee"),
        F.max(F.when(ranked, F.array_max(F.transform("other_fees", lambda f: f["amount_kes"])))).alias("_largest_fee"),
        F.max("fastest_payer").alias("_fastest"),
        F.array_join(F.array_sort(F.collect_list(F.when(~ranked, F.col("platform_code")))), ", ").alias("_left_out"),
    )
    lead = F.col("lead_kes")
    unproven = F.coalesce(F.col("_unknown_fee") & (lead > 0) & (lead < SMALL_LEAD), F.lit(False))
    may_flip = F.coalesce(F.col("_unknown_fee") & (lead > 0) & (F.col("_largest_fee") >= lead), F.lit(False))
    faster = F.when(F.col("_fastest") != F.col("_first"), F.col("_fastest"))
    best = F.when(F.col("decided"), F.col("_first"))
    text = F.when(
        F.col("decided"),
        F.concat_ws(
            " ",
            F.concat(best, F.lit(f" leaves the most: {symbol} "), F.col("net_receipt_kes").cast("string"), F.lit(f" of a {symbol} "), F.col("sale_price").cast("string"), F.lit(" sale.")),
            F.when(lead > 0, F.concat(F.lit(f"That is {symbol} "), lead.cast("string"), F.lit(" more than "), F.col("runner_up"), F.lit("."))),
            F.when(lead <= 0, F.concat(F.col("runner_up"), F.lit(" is level with it."))),
            F.when(unproven, "The lead is unproven: a fee is not confirmed."),
            F.when(faster.isNotNull(), F.concat(faster, F.lit(" pays faster."))),
            F.when(F.col("_left_out") != "", F.concat(F.lit("Not included, for lack of figures: "), "_left_out", F.lit("."))),
        ),
    ).otherwise("These cannot be compared yet.")
    return grouped.select(
        "category_code", "county_code", "decided", best.alias("best"), "net_receipt_kes", "lead_kes", "runner_up",
        unproven.alias("unproven"), may_flip.alias("may_flip"), F.when(F.col("decided"), faster).alias("faster_payer"), text.alias("text"),
    )


def comparison_sentences(columns: DataFrame, symbol: str = "KSh") -> DataFrame:
    """The comparison of each (category, county) in words: ``text`` for those with a platform that can be compared.

    It names what the best leaves after which commission and delivery, the lead over the next,
    that the lead may turn while a return fee is unknown and the largest known fee reaches it,
    a platform that pays sooner, and the best one's first caveat.
    """
    money = lambda c: F.concat(F.lit(f"{symbol} "), c.cast("string"))
    known = F.col("comparable")
    one = F.struct("platform_code", "platform_name", "sale_price", "net_receipt_kes", "commission_rate", "last_mile_kes", "lead_kes", "payout_days", "gaps")
    unknown = F.exists("gaps", lambda g: g.contains("return handling fee not confirmed"))
    soonest = F.when(known & (F.col("payout_days") > 0), F.struct("payout_days", "rank"))
    g = columns.groupBy("category_code", "county_code").agg(
        F.max(F.when(known & (F.col("rank") == 1), one)).alias("best"),
        F.max(F.when(known & (F.col("rank") == 2), F.col("platform_name"))).alias("_next"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(known & unknown, F.struct("rank", "platform_name")))), lambda x: x["platform_name"]), ", ").alias("_unknown"),
        F.max(F.when(known, F.array_max(F.transform("other_fees", lambda f: f["amount_kes"])))).alias("_largest"),
        F.min_by(F.struct("platform_code", "platform_name", "payout_days"), soonest).alias("_soonest"),
    )
    best, lead = F.col("best"), F.col("best.lead_kes")
    mile = F.when(best["last_mile_kes"] > 0, F.concat(F.lit(" and "), money(best["last_mile_kes"]), F.lit(" delivery"))).otherwise("")
    turns = (F.col("_unknown") != "") & (lead > 0) & (F.col("_largest") >= lead)
    other = F.col("_soonest.platform_code") != best["platform_code"]
    text = F.concat_ws(
        " ",
        F.concat(F.lit("Of a sale at "), money(best["sale_price"]), F.lit(", "), best["platform_name"], F.lit(" leaves the most: "), money(best["net_receipt_kes"]), F.lit(" after "), F.round(best["commission_rate"] * 100, 0).cast("int").cast("string"), F.lit("% commission"), mile, F.lit(".")),
        F.when(lead > 0, F.concat(F.lit("That is "), money(lead), F.lit(" a unit more than "), F.col("_next"), F.lit("."))).when(lead <= 0, F.concat(F.col("_next"), F.lit(" is level with it."))),
        F.when(turns, F.concat(F.lit("The lead is not proven: "), F.col("_unknown"), F.lit(" has a return handling fee that is not confirmed, and such a fee is up to "), money(F.col("_largest")), F.lit(" elsewhere, so the order may turn."))),
        F.when(best["payout_days"].isNotNull() & (best["payout_days"] > 0) & other, F.concat(F.col("_soonest.platform_name"), F.lit(" pays sooner: every "), F.col("_soonest.payout_days").cast("string"), F.lit(" days, not "), best["payout_days"].cast("string"), F.lit("."))),
        F.when(F.size(best["gaps"]) > 0, F.concat(F.lit("Caveat: "), F.get(best["gaps"], F.lit(0)), F.lit("."))),
    )
    return g.filter(best.isNotNull()).select("category_code", "county_code", best["platform_code"].alias("best"), text.alias("text"))


def coverage(requested: DataFrame, counties: DataFrame, delivery: DataFrame) -> DataFrame:
    """What is known of delivery for each requested (platform, county), with all that ``delivery`` says of it."""
    out = requested.join(counties.select("county_code", "has_logistics"), "county_code", "left").join(
        delivery, ["platform_code", "county_code"], "left"
    )
    status = (
        F.when(F.col("has_logistics").isNull(), "unknown county")
        .when(~F.col("has_logistics"), "no logistics")
        .when(F.col("door_delivery").isNull(), "served, no figure")
        .otherwise("served")
    )
    return out.withColumn("status", status)


def policy_facts(policy: DataFrame) -> DataFrame:
    """Onboarding, payout and returns of each platform as rows; what is not known says so.

    ``source`` and ``read``, where ``policy`` has them, say from which document and day.
    """
    facts = F.array(
        F.struct(F.lit("payout").alias("topic"), F.concat(F.col("payout_days").cast("string"), F.lit(" day cycle")).alias("fact")),
        F.struct(F.lit("returns").alias("topic"), F.concat(F.col("return_window_days").cast("string"), F.lit(" day window")).alias("fact")),
        F.struct(F.lit("onboarding").alias("topic"), F.array_join("requirements", ", ").alias("fact")),
    )
    origin = [c for c in ("source", "read") if c in policy.columns]
    rows = policy.select("platform_code", F.col("name").alias("platform_name"), *origin, F.inline(facts))
    return rows.withColumn("confirmed", F.col("fact").isNotNull()).withColumn("fact", F.coalesce("fact", F.lit("not confirmed")))


def platforms_of_country(categories: DataFrame, countries: DataFrame, country: str, chosen: list[str] | None = None) -> DataFrame:
    """Each category's platforms in a country by the category's kind; an explicit choice is kept in its order."""
    kinds = countries.filter(F.col("country_code") == country).select("kind", "platforms")
    out = categories.join(kinds, "kind", "left").withColumn("platforms", F.coalesce("platforms", F.array().cast("array<string>")))
    if chosen:
        out = out.withColumn("platforms", F.array_intersect(F.array(*map(F.lit, chosen)), "platforms"))
    return out.select("category_code", "kind", F.posexplode("platforms").alias("place", "platform_code"))
