"""Personal data: known formats by rules, further spans by boosted trees over proposed candidates.

The base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers,
leftmost and non-overlapping per kind; a match that fails its check (octets, Luhn,
number of digits) is dropped. What they miss, they miss for their greed (a phone number
with a card number right behind it is one match of too many digits) or for their
strictness (``name [at] host.org``, a card in groups with dots). So generators with a
high recall propose spans, several for one place: addresses with written-out signs,
defanged IPs, cards solid or grouped, phones international or national. A candidate is
described by binned format features (digits, groups, longest group, separators, leading
plus, the kind's own check) and context features (the characters around it, a cue word
among the 24 characters before it, back to the generator's last match).

The label of a candidate is whether a base span of its kind overlaps it, so the trees
learn from all documents in which formats and contexts the known data stand. Candidates are
counted by their features over the whole corpus (at most 27,648 cells a kind), texts of
fold 3 of 4 apart. On these counts the driver fits gradient-boosted trees of depth 2, and
chooses for each kind the lowest score at which, in the held-out fold, nine tenths of the
valid candidates above it are labelled (smoothed, so eight of them are the least); even odds
are the lowest there is. A kind that never gets there adds nothing. Valid candidates above the threshold that overlap no base
span are redactions; of several at one place those stay that no better one overlaps.

All of it are column expressions of one text. A text is cut in blocks of about 4,096
characters where no pattern can pass (a line's end, a space between letters), so that work
grows with the length of texts; a stretch without such a place is one block.

Null texts have no spans. Repeated rows get equal results, each its own. An empty table
gives an empty result, and a model that adds nothing. Columns called like a result are
replaced; others may have any name. Ties in a score: the longer span, then the earlier,
then the kind as listed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. What may not be given back is possessive, and starts inside a run are skipped, so no text takes quadratic time.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Spans that a kind's data may have; several patterns of a kind may meet.
GENERATORS = [
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}} ?(?:[@＠]|[\[(](?:at|AT)[\])]) ?[A-Za-z0-9-]{{1,63}}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{{1,63}}){{0,8}}"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:(?:\.|[\[(](?:\.|dot)[\])])[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([ ._-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{6}\1[0-9]{5})(?![0-9])"),
    ("phone", r"(?:\+|(?<![0-9])00)[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]{0,2}[0-9]{2,4}){1,4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
]
CUES = {
    "email": "mail|contact|write|courriel|correo|schreib",
    "ip": r"\bip\b|addr|host|server",
    "card": "card|visa|master|amex|carte|karte|tarjeta",
    "phone": "tel|phone|call|mobile|fax|whatsapp|tél|ruf",
}
CONTEXT = 24
#: No candidate is in a text without this.
TRIGGER = r"[@＠]|[\[(](?:at|AT)[\])]|[0-9][ .-]?[0-9]|\+[0-9]|[0-9][\[(]"
BLOCK = r"(?s).{4096}.*?(?:\n|(?<=[A-Za-z]) (?=[A-Za-z])|\z)|.+"
#: Features with their greatest value.
FEATURES = {"digits": 5, "groups": 3, "longest": 3, "separators": 3, "before": 2, "after": 2, "cue": 1, "valid": 1, "lead": 1}
FOLDS, HELD_OUT = 4, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(block: Column, before: Column, pattern: str) -> Column:
    """All matches of a pattern in a block: ``start`` and ``end`` in it, the ``hit`` and the text ``before`` and ``after`` it."""
    both = F.struct(F.split(block, pattern, -1).alias("between"), F.regexp_extract_all(block, F.lit(pattern), F.lit(0)).alias("hits"))

    def at(m: Column) -> Column:
        total = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))

        def one(hit: Column, i: Column) -> Column:
            left = F.when(i == 0, F.concat(before, F.get(m["between"], i))).otherwise(F.get(m["between"], i))
            context = F.right(left, F.lit(CONTEXT)).alias("before"), F.left(F.get(m["between"], i + 1), F.lit(1)).alias("after")
            start = total(F.slice(m["between"], F.lit(1), i + 1)) + total(F.slice(m["hits"], F.lit(1), i))
            return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(hit)).alias("end"), hit.alias("hit"), *context))

        return F.transform(m["hits"], one)

    return F.when(block.rlike(pattern), let(both, at)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>"))


def octets(text: Column) -> Column:
    """Whether all parts between dots are 255 at most."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes(kind: str, hit: Column) -> Column:
    """The base rules' check of a match."""
    n = F.length(only_digits(hit))
    if kind == "ip":
        return octets(hit)
    if kind == "card":
        return F.when(n.between(13, 19), F.call_function("luhn_check", only_digits(hit))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def valid(kind: str, hit: Column) -> Column:
    """The check of a candidate, its written-out signs read as what they stand for."""
    if kind == "email":
        host = F.regexp_replace(F.regexp_replace(hit, r" ?(?:[@＠]|[\[(](?:at|AT)[\])]) ?", "@"), r" ?[\[(](?:dot|DOT)[\])] ?", ".")
        return host.rlike(r"@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$")
    return passes(kind, F.regexp_replace(hit, r"[\[(](?:\.|dot)[\])]", ".") if kind == "ip" else hit)


def binned(value: Column, *cuts: int) -> Column:
    return sum((value >= c).cast("int") for c in cuts)


def beside(text: Column) -> Column:
    """The class of a neighbouring character: none or white space, letter or digit, other."""
    return F.when((text == "") | text.rlike(r"^\s"), 0).when(text.rlike(r"^[\p{L}\p{N}_]"), 1).otherwise(2)


def described(kind: str, m: Column) -> dict[str, Column]:
    hit = m["hit"]
    runs = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    marks = F.array_distinct(F.regexp_extract_all(hit, F.lit("[ ._-]"), F.lit(0)))
    return {
        "digits": binned(F.length(only_digits(hit)), 9, 10, 12, 13, 17),
        "groups": binned(F.size(runs), 2, 3, 4),
        "longest": binned(F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), 4, 5, 13),
        "separators": F.when(hit.contains("("), 3).otherwise(F.least(F.size(marks), F.lit(2))),
        "before": beside(F.right(m["before"], F.lit(1))),
        "after": beside(m["after"]),
        "cue": F.lower(m["before"]).rlike(CUES[kind]).cast("int"),
        "valid": valid(kind, hit).cast("int"),
        "lead": hit.rlike(r"^(?:\+|00)").cast("int"),
    }


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def analysed(block: Column, before: Column) -> Column:
    """A block's ``base`` spans by kind and its ``candidates`` with features, label and whether they are ``free`` of base spans."""
    spans = [F.transform(_passing(k, block, before), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS]

    def with_base(base: Column) -> Column:
        found = [F.transform(matches(block, before, pattern), _candidate(kind, base)) for kind, pattern in GENERATORS]
        return F.struct(base.alias("base"), F.concat(*found).alias("candidates"))

    return let(F.array(*spans), with_base)


def _passing(kind: str, block: Column, before: Column) -> Column:
    return F.filter(matches(block, before, BASE[kind]), lambda m: passes(kind, m["hit"]))


def _candidate(kind: str, base: Column) -> Callable[[Column], Column]:
    own = KINDS.index(kind)

    def one(m: Column) -> Column:
        label = F.exists(F.get(base, F.lit(own)), lambda b: overlap(b, m)).cast("int")
        free = ~F.exists(F.flatten(base), lambda b: overlap(b, m))
        return F.struct(F.lit(own).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), label.alias("label"), free.alias("free"), *[c.cast("int").alias(n) for n, c in described(kind, m).items()])

    return one


def examined(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_found``: for each block of the text that can hold a candidate, where it starts and what it holds."""
    body = F.coalesce(F.col(text), F.lit(""))
    blocks = F.when(body.rlike(TRIGGER), F.regexp_extract_all(body, F.lit(BLOCK), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def of(b: Column) -> Column:
        sizes = F.transform(b, F.length)

        def placed(n: Column) -> Column:
            def one(block: Column, i: Column) -> Column:
                tail = F.coalesce(F.right(F.get(b, i - 1), F.lit(CONTEXT)), F.lit(""))
                start = F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda a, x: a + x)
                return F.when(block.rlike(TRIGGER), F.struct(start.alias("offset"), analysed(block, tail).alias("has")))

            return F.filter(F.transform(b, one), lambda x: x.isNotNull())

        return let(sizes, placed)

    # generated, so that no later projection repeats it
    return docs.withColumn("_found", F.explode(F.array(let(blocks, of))))


@dataclass
class Trees:
    """A kind's trees: ``(feature, cut, low, high)`` with a leaf or a further such split as low and high."""

    start: float
    trees: list = field(default_factory=list)
    threshold: float | None = None


def value_of(tree, cell: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        name, cut, low, high = tree
        tree = high if cell[name] >= cut else low
    return tree


def score_of(model: Trees, cell: dict[str, int]) -> float:
    out = model.start
    for t in model.trees:
        out = out + value_of(t, cell)
    return out


def grow(rows: list[tuple[dict[str, int], float, float]], depth: int, rate: float, ridge: float):
    """A regression tree over ``(cell, gradient, weight)``; the split of most gain, the first of equal ones."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-9, None)
    if depth:
        for name, most in FEATURES.items():
            bins = [[0.0, 0.0] for _ in range(most + 1)]
            for cell, dg, dh in rows:
                bins[cell[name]][0] += dg
                bins[cell[name]][1] += dh
            low_g = low_h = 0.0
            for cut in range(1, most + 1):
                low_g, low_h = low_g + bins[cut - 1][0], low_h + bins[cut - 1][1]
                gain = low_g**2 / (low_h + ridge) + (g - low_g) ** 2 / (h - low_h + ridge) - g**2 / (h + ridge)
                if gain > best[0] + 1e-9:
                    best = (gain, (name, cut))
    if best[1] is None:
        return rate * g / (h + ridge)
    name, cut = best[1]
    side = [[r for r in rows if (r[0][name] >= cut) is up] for up in (False, True)]
    return (name, cut, *[grow(s, depth - 1, rate, ridge) for s in side])


def fit_kind(cells: list[tuple[dict[str, int], bool, int, int]], rounds: int, rate: float, depth: int, ridge: float, precision: float) -> Trees:
    """Trees and threshold from ``(cell, held out, candidates, labelled)``."""
    train, held = [c for c in cells if not c[1]], [c for c in cells if c[1]]
    n, hits = sum(c[2] for c in train), sum(c[3] for c in train)
    model = Trees(math.log((hits + 0.5) / (n - hits + 0.5)))
    scores = [model.start] * len(train)
    for _ in range(rounds if 0 < hits else 0):
        rows = []
        for (cell, _, k, pos), s in zip(train, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            rows.append((cell, pos - k * p, k * p * (1 - p)))
        tree = grow(rows, depth, rate, ridge)
        model.trees.append(tree)
        scores = [s + value_of(tree, c[0]) for s, c in zip(scores, train, strict=True)]
    above = right = 0
    by_score: dict[float, list[int]] = {}
    for cell, _, k, pos in held:
        if cell["valid"]:
            both = by_score.setdefault(score_of(model, cell), [0, 0])
            both[0], both[1] = both[0] + k, both[1] + pos
    for s in sorted(by_score, reverse=True):
        above, right = above + by_score[s][0], right + by_score[s][1]
        if s >= 0 and (right + 1) / (above + 2) >= precision:
            model.threshold = s
    return model


def fit(docs: DataFrame, text: str = "text", rounds: int = 20, rate: float = 0.3, depth: int = 2, ridge: float = 1.0, precision: float = 0.9) -> dict[str, Trees]:
    """The trees of each kind, from the counts of all candidates of ``docs`` by their features."""
    fold = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    found = examined(docs.select(F.col(text).alias("_text"), fold.alias("_held")), "_text").select("_held", F.explode("_found.has.candidates").alias("c"))
    each = found.select("_held", F.explode("c").alias("c")).select("_held", "c.kind", "c.label", *[f"c.{n}" for n in FEATURES])
    counted = each.groupBy("kind", "_held", *FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("labelled")).collect()
    counted.sort(key=lambda r: (r["kind"], r["_held"], *[r[n] for n in FEATURES]))
    cells: dict[str, list] = {k: [] for k in KINDS}
    for r in counted:
        cells[KINDS[r["kind"]]].append(({n: r[n] for n in FEATURES}, r["_held"], r["n"], r["labelled"]))
    return {k: fit_kind(c, rounds, rate, depth, ridge, precision) for k, c in cells.items()}


def as_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, cut, low, high = tree
    return F.when(c[name] >= cut, as_column(high, c)).otherwise(as_column(low, c))


def surplus(model: dict[str, Trees], c: Column) -> Column:
    """A candidate's score above its kind's threshold; null where the kind adds nothing."""
    out = F.lit(None).cast("double")
    for i, k in enumerate(KINDS):
        if model[k].threshold is not None:
            score = F.lit(model[k].start)
            for t in model[k].trees:
                score = score + as_column(t, c)
            out = F.when(c["kind"] == i, score - F.lit(model[k].threshold)).otherwise(out)
    return out


def mark(docs: DataFrame, model: dict[str, Trees], text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of kind, start and end, by kind as listed and start.

    Places are code points from 0, the end is exclusive. ``spans`` are the base spans and what the trees add.
    """

    def added(has: Column) -> Column:
        one = lambda c: F.struct(surplus(model, c).alias("s"), (c["end"] - c["start"]).alias("n"), (-c["start"]).alias("first"), (-c["kind"]).alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
        good = F.filter(F.transform(F.filter(has["candidates"], lambda c: c["free"] & (c["valid"] == 1)), one), lambda c: c["s"] >= 0)
        return let(good, lambda g: F.array_distinct(F.filter(g, lambda c: ~F.exists(g, lambda o: overlap(o, c) & (o > c)))))

    def shifted(x: Column) -> Column:
        base = F.transform(x["has"]["base"], lambda spans: F.transform(spans, lambda s: F.struct((s["start"] + x["offset"]).alias("start"), (s["end"] + x["offset"]).alias("end"))))
        more = F.transform(added(x["has"]), lambda c: F.struct(c["kind"].alias("kind"), (c["start"] + x["offset"]).alias("start"), (c["end"] + x["offset"]).alias("end")))
        return F.struct(base.alias("base"), more.alias("more"))

    out = examined(docs.drop("base", "spans"), text).withColumn("_all", F.explode(F.array(F.transform("_found", shifted)))).drop("_found")
    base, spans = [], []
    for i, kind in enumerate(KINDS):
        of_kind = F.flatten(F.transform("_all", _nth(i)))
        more = F.transform(F.filter(F.flatten("_all.more"), _is_kind(i)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
        base.append(F.transform(of_kind, _named(kind)))
        spans.append(F.transform(F.array_sort(F.concat(of_kind, more)), _named(kind)))
    return out.withColumns({"base": F.concat(*base), "spans": F.concat(*spans)}).drop("_all")


def _nth(i: int) -> Callable[[Column], Column]:
    return lambda x: F.get(x["base"], F.lit(i))


def _is_kind(i: int) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == i


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def redact(marked: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``marked`` with ``redacted``: the text with each span, or run of overlapping spans, as its kind in brackets."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    blocks = F.regexp_extract_all(F.col(text), F.lit(BLOCK), F.lit(0))

    def of(x: Column) -> Column:
        def one(block: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(x["sizes"], F.lit(1), i), F.lit(0), lambda a, n: a + n)

            def cut(at: Column) -> Column:
                mine = F.filter(x["spans"], lambda s: (s["start"] >= at) & (s["start"] < at + F.get(x["sizes"], i)))
                step = lambda a, s: F.struct(
                    F.greatest(a["to"], s["end"] - at).alias("to"),
                    F.when(s["start"] - at < a["to"], a["out"]).otherwise(F.concat(a["out"], F.substring(block, a["to"] + 1, s["start"] - at - a["to"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
                )
                return F.aggregate(mine, F.struct(F.lit(0).alias("to"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(block, a["to"] + 1, F.length(block))))

            return let(start, cut)

        return F.array_join(F.transform(x["blocks"], one), "")

    cutting = let(blocks, lambda b: let(F.struct(b.alias("blocks"), F.transform(b, F.length).alias("sizes"), ordered.alias("spans")), of))
    return marked.withColumn("redacted", F.when(F.size(spans) > 0, cutting).otherwise(F.col(text)))
