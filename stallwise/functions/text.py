"""Column expressions for prices, titles, keys and typed names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The forms in which listings write prices, and the words that carry no product meaning.
RANGE_SEPARATORS = (" - ", " to ", " – ")
CURRENCY_NOISE = r"(?i)(ksh?s?|kes|/=|/-|shillings?|bob)\.?"
NUMBER = r"(?<![\d.])(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*([kK])?(?!\d)"
LEAST_PRICE, MOST_PRICE = 10, 10_000_000
TITLE_NOISE = (
    r"(?i)\b(brand new|new arrival|hot sale|best seller|bestseller|free shipping|fast delivery|original|genuine"
    r"|high quality|top quality|wholesale|in stock|limited offer|special offer|discount|promo|offer)\b"
)
SPECS = {
    "capacity_mah": r"(?i)(\d{3,6})\s*mah\b",
    "storage_gb": r"(?i)(\d{1,4})\s*gb\b",
    "memory_gb": r"(?i)(\d{1,3})\s*gb\s*ram\b",
    "screen_inch": r'(?i)(\d{1,3}(?:\.\d)?)\s*(?:inch|inches|")',
    "volume_litre": r"(?i)(\d{1,3}(?:\.\d)?)\s*(?:litre|liter|l)\b",
    "weight_kg": r"(?i)(\d{1,3}(?:\.\d)?)\s*kg\b",
    "pack_count": r"(?i)\b(\d{1,3})\s*(?:pcs|pieces|pack)\b",
}
STOPWORDS = [
    "a", "an", "the", "in", "on", "at", "for", "of", "to", "and", "or", "me", "my", "i", "we", "you", "is", "are",
    "do", "does", "what", "whats", "how", "much", "many", "cost", "costs", "price", "prices", "priced", "sell",
    "sells", "selling", "buy", "cheap", "cheapest", "best", "good", "please", "show", "tell", "find", "get", "want",
    "need", "looking", "kenya", "kenyan", "ksh", "kes", "shillings", "bob",
]
#: Plural endings in the order they are tried: the ending, the letters a word has at least, and what the ending becomes.
SINGULARS = [("ies", 4, "y"), ("ses", 4, "s"), ("ss", 1, "ss"), ("s", 3, "")]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split_range(raw: Column) -> tuple[Column, Column]:
    """The text before and after the first range separator in their order; null after when there is none."""
    low, high = raw, F.lit(None).cast("string")
    for separator in reversed(RANGE_SEPARATORS):
        at = F.instr(raw, separator)
        low = F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(low)
        high = F.when(at > 0, F.substring(raw, at + len(separator), F.length(raw))).otherwise(high)
    return low, high


def parse_price(raw: Column) -> Column:
    """Price text to DECIMAL(18,4): the low end of a range, ``k`` as thousands; null if unreadable or implausible."""
    return once(F.trim(raw), lambda text: _parse_one(_split_range(text)[0]))


def _parse_one(raw: Column) -> Column:
    """``parse_price`` of a text that is no range; each pattern is matched once."""
    found = F.regexp_extract(F.regexp_replace(raw, CURRENCY_NOISE, " "), NUMBER, 0)

    def value(number: Column) -> Column:
        digits = F.translate(number, ", \t\n\x0b\f\rkK", "").try_cast("decimal(18,4)")
        return (digits * F.when(F.lower(F.right(number, F.lit(1))) == "k", 1000).otherwise(1)).try_cast("decimal(18,4)")

    return F.get(F.filter(F.transform(F.array(found), value), lambda v: v.between(LEAST_PRICE, MOST_PRICE)), F.lit(0))


def parse_price_range(raw: Column) -> Column:
    """Both ends in ascending order; one price is both ends; null if an end is unreadable."""

    def ends(text: Column) -> Column:
        low, high = _split_range(text)
        return F.struct(_parse_one(low).alias("a"), once(high, lambda h: _parse_one(_split_range(h)[0])).alias("b"), high.isNull().alias("single"))

    def ordered(e: Column) -> Column:
        a, b = e["a"], F.when(e["single"], e["a"]).otherwise(e["b"])
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))

    return once(once(F.trim(raw), ends), ordered)


def clean_title(raw: Column) -> Column:
    """The words that name the product: no bracketed parts, no promotion, lower case; empty is null."""
    text = F.regexp_replace(raw, r"[\[\(]([^\]\)]*)[\]\)]", " ")
    text = F.regexp_replace(F.regexp_replace(text, TITLE_NOISE, " "), r"[|_]", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    return F.nullif(F.lower(F.regexp_replace(text, r"^[ \-,.|]+|[ \-,.|]+$", "")), F.lit(""))


def extract_specs(title: Column) -> Column:
    """The numeric specifications found; an absent one has no entry."""
    found = [F.nullif(F.regexp_extract(title, p, 1), F.lit("")).try_cast("double") for p in SPECS.values()]
    entries = F.map_from_arrays(F.array(*map(F.lit, SPECS)), F.array(*found))
    return F.when(title.isNotNull(), F.map_filter(entries, lambda _, v: v.isNotNull()))


def normalise_sku(platform: Column, key: Column) -> Column:
    """``platform:key`` with the key's letters and digits joined by dashes; null without any."""
    body = F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return once(body, lambda b: F.when(b != "", F.concat(platform, F.lit(":"), b)))


@F.arrow_udf(StringType())
def _decomposed(texts: pa.Array) -> pa.Array:
    """Compatibility forms without combining marks, null for null; Spark has no function for it."""
    forms = (t and unicodedata.normalize("NFKD", t) for t in texts.to_pylist())
    return pa.array((f and "".join(c for c in f if not unicodedata.combining(c)) for f in forms), pa.string())


def fold(text: Column) -> Column:
    """Lower case without accents, ligatures or punctuation, single spaces; null is empty."""
    body = F.coalesce(text, F.lit(""))
    plain = F.lower(F.coalesce(_decomposed(F.when(body.rlike(r"[^\x00-\x7F]"), body)), body))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"""[-_/\\.,+&()\[\]{}'"!?:;]+""", " "), r"\s+", " "))


def strip_stopwords(folded: Column) -> Column:
    """The folded words that name something; all of them if none does."""
    kept = F.filter(F.split(folded, " "), lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(folded)


def singular(word: Column) -> Column:
    """The regular English singular of a word, by the first ending that fits."""
    out = word
    for ending, least, becomes in reversed(SINGULARS):
        cut = F.concat(F.left(word, F.length(word) - len(ending)), F.lit(becomes))
        out = F.when((F.length(word) >= least) & word.endswith(ending), cut).otherwise(out)
    return out


def singularise(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), singular), " ")


def typo_budget(word: Column) -> Column:
    """Edits forgiven in a word of this length."""
    return F.when(F.length(word) <= 4, 1).when(F.length(word) <= 7, 2).otherwise(3)


def pseudonym(email: Column, salt: str) -> Column:
    """A stable reference of 16 hex digits for an account."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.lower(F.trim(email))).cast("binary"), 256), 1, 16)
