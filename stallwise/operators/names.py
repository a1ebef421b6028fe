"""Resolving typed names against a table of aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.text import fold, singular, singularise, strip_stopwords, typo_budget
from stallwise.session import cut_lineage


def alias_dim(targets: DataFrame) -> DataFrame:
    """``code``, ``label``, ``kind``, ``alias`` and its place, from targets with their ``names`` in order."""
    rows = targets.select(
        "code", "label", "kind", "place",
        F.posexplode(F.concat(F.array(F.replace("code", F.lit("_"), F.lit(" ")), F.col("label")), F.coalesce("names", F.array().cast("array<string>")))).alias("_i", "_name"),
    )
    folded = rows.withColumn("alias", fold(F.col("_name"))).filter("alias <> ''")
    return folded.groupBy("code", "label", "kind", "alias").agg(F.min(F.struct("place", "_i")).alias("alias_place"))


def _forms(queries: DataFrame, query: str) -> DataFrame:
    """The distinct non-blank queries with their normalised forms."""
    typed = queries.select(F.trim(query).alias("typed")).filter("typed <> ''").distinct()
    out = typed.withColumn("folded", fold(F.col("typed"))).filter("folded <> ''").withColumn("trimmed", strip_stopwords(F.col("folded")))
    return out.withColumn("singular", singularise(F.col("trimmed"))).withColumn("collapsed", F.replace("folded", F.lit(" "), F.lit("")))


def _containing(forms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of names and aliases of which one may contain the other: it holds the other's first four characters."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, F.lit(4))))
    kinds = [F.col(c) for c in ("folded", "trimmed", "singular")]
    begins = lambda c: F.substring(c, 1, 4)
    long_alias = aliases.filter(F.length("alias") >= 4)
    inner = forms.select("typed", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, kinds))))).alias("_gram")).join(
        long_alias.select("alias", begins(F.col("alias")).alias("_gram")).distinct(), "_gram"
    )
    outer = forms.select("typed", F.explode(F.array_distinct(F.array(*map(begins, kinds)))).alias("_gram")).join(
        long_alias.select("alias", F.explode(grams(F.col("alias"))).alias("_gram")), "_gram"
    )
    pairs = inner.select("typed", "alias").unionByName(outer.select("typed", "alias")).distinct()
    return pairs.join(forms, "typed").join(aliases, "alias")


def _near(texts: DataFrame, aliases: DataFrame, budget: Column) -> DataFrame:
    """Pairs of ``texts`` (``_text``) and aliases that up to ``budget`` edits (3 at most) may part.

    An alias is cut in one part more than the budget: one of them is untouched by the
    edits, so it stands in the text, moved by as many characters as the budget at most.
    """
    part = lambda c, n, of, i, by: F.substring(c, F.floor(i * n / of).cast("int") + 1 + by, (F.floor((i + 1) * n / of) - F.floor(i * n / of)).cast("int"))
    pieces = aliases.select("alias", F.length("alias").alias("_n"), (budget + 1).cast("int").alias("_of")).distinct()
    pieces = pieces.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    pieces = pieces.withColumn("_part", part(F.col("alias"), F.col("_n"), F.col("_of"), F.col("_i"), F.lit(0)))
    sizes = pieces.select("_n", "_of").distinct()
    spots = texts.select("_text").distinct().withColumn("_n", F.explode(F.sequence(F.greatest(F.length("_text") - 3, F.lit(1)), F.length("_text") + 3)))
    spots = spots.join(sizes, "_n").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    spots = spots.withColumn("_by", F.explode(F.sequence(1 - F.col("_of"), F.col("_of") - 1)))
    spots = spots.filter(F.floor(F.col("_i") * F.col("_n") / F.col("_of")) + F.col("_by") >= 0)
    spots = spots.withColumn("_part", part(F.col("_text"), F.col("_n"), F.col("_of"), F.col("_i"), F.col("_by")))
    pairs = spots.join(pieces, ["_n", "_of", "_i", "_part"]).select("_text", "alias").distinct()
    return pairs.join(texts, "_text").join(aliases, "alias")


def resolve_names(queries: DataFrame, aliases: DataFrame, query: str = "query") -> DataFrame:
    """The best match of every distinct typed name: exact, then alias, then partial, then within a typo budget.

    Names are matched once each; their forms, and what is still open, are stored between the steps. Equal forms meet by keys; what is still open meets the
    aliases that it can contain or be near to by shared parts, so no pairs of all names
    and aliases are made.
    """
    forms = cut_lineage(_forms(queries, query))
    a = aliases.select("code", "label", "kind", "alias", "alias_place").withColumn("_flat", F.replace("alias", F.lit(" "), F.lit("")))
    a = cut_lineage(a.withColumns({"_one": singularise(F.col("alias")), "_flat_one": singular(F.col("_flat"))}))

    def best(rows: DataFrame, how: str, *order) -> DataFrame:
        w = Window.partitionBy("typed").orderBy(*order)
        return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select("typed", "code", "label", "kind", F.lit(how).alias("how"), "score")

    keyed = forms.select("typed", F.posexplode(F.array("folded", "trimmed", "singular")).alias("_form", "alias"))
    exact = cut_lineage(best(keyed.join(a, "alias").withColumn("score", F.lit(1.0)), "exact", "_form", "alias_place", "code"))
    open_ = forms.join(exact, "typed", "left_anti")

    flat = open_.join(a, F.col("collapsed") == F.col("_flat")).withColumn("score", F.lit(0.98))
    one = open_.join(a, F.col("singular") == F.col("_one")).withColumn("score", F.lit(0.96))
    flat_one = open_.withColumn("_c", singular(F.col("collapsed"))).join(a, F.col("_c") == F.col("_flat_one")).drop("_c").withColumn("score", F.lit(0.96))
    alias = cut_lineage(best(flat.unionByName(one).unionByName(flat_one), "alias", "alias_place", F.desc("score"), "code"))
    open_ = cut_lineage(open_.join(alias, "typed", "left_anti"))

    def holds(form: str):
        f = F.col(form)
        return f.contains(F.col("alias")) | ((F.length(f) >= 4) & F.col("alias").contains(f))

    inside = _containing(open_, a).filter((F.length("alias") >= 4) & (holds("folded") | holds("trimmed") | holds("singular")))
    partial = best(inside.withColumn("score", F.lit(0.9)), "partial", F.desc(F.length("alias")), F.desc("code"), F.desc("label"))

    texts = open_.select("typed", F.posexplode(F.array("folded", "trimmed", "singular")).alias("_form", "_text"))
    tries = _near(texts, a.select("code", "label", "kind", "alias", "alias_place"), typo_budget(F.col("alias")))
    budget = F.least(typo_budget(F.col("alias")), typo_budget(F.col("_text")))
    near = tries.filter(F.abs(F.length("alias") - F.length("_text")) <= budget).withColumn("_d", F.levenshtein("_text", "alias", 3))
    near = near.filter((F.col("_d") >= 0) & (F.col("_d") <= budget))
    near = near.withColumn("score", 1.0 - F.col("_d") / F.greatest(F.length("alias"), F.length("_text"))).filter("score >= 0.6")
    fuzzy = best(near.join(partial, "typed", "left_anti"), "fuzzy", F.desc("score"), "alias_place", "_form", "code")
    out = exact.unionByName(alias).unionByName(partial).unionByName(fuzzy)
    return out.withColumn("certain", F.col("how").isin("exact", "alias") | (F.col("score") >= 0.92)).withColumn("score", F.round("score", 3))


def suggest_names(queries: DataFrame, aliases: DataFrame, query: str = "query", limit: int = 5) -> DataFrame:
    """Up to ``limit`` near misses of every typed name, the best alias of each code."""
    forms = _forms(queries, query)
    budget = F.greatest(typo_budget(F.col("alias")), F.lit(2))
    tries = _near(forms.select("typed", F.explode(F.array("folded", "trimmed")).alias("_text")).distinct(), aliases, budget)
    near = tries.filter(F.abs(F.length("alias") - F.length("_text")) <= budget).withColumn("_d", F.levenshtein("_text", "alias", 3))
    near = near.filter((F.col("_d") >= 0) & (F.col("_d") <= budget))
    near = near.withColumn("score", 1.0 - F.col("_d") / F.greatest(F.length("alias"), F.length("_text")))
    per_code = near.groupBy("typed", "code", "label").agg(F.max("score").alias("_score"))
    w = Window.partitionBy("typed").orderBy(F.desc("_score"), "code")
    return per_code.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("typed", "rank", "code", "label", F.round("_score", 3).alias("score"))
