"""Operators 11 to 13 against plain versions on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from stallwise.llm import merkle, prefix_trie, private_spans, queries

# ---- 11 -----------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(5)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 5, 8, 12])
        for t in range(n):
            body = f"é{t}" if rng.random() < 0.7 else rng.choice(["a", "b", None, ""])
            rows.append((c * (3 if c % 7 == 0 else 1), t if rng.random() < 0.9 else None, rng.choice(["user", None]) if t > 3 else "user", body))
    rows += [(1000 + i, 0, "user", "same") for i in range(40)]  # a large group of equal conversations
    rows += [(1100, t % 2, "user", f"t{t}") for t in range(30)] + [(1101, 0, None, None), (None, 1, "user", "nobody's"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    return rows


def turns_of(rows):
    """Each conversation's turns in order, those of one number by their digest."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        if c is not None:
            out[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16], (r, x)))
    return {c: [e[2] for e in sorted(v)] for c, v in out.items()}


def plain_trie(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in paths.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        text = ",".join(map(str, sorted(ends[node])))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_trie(spark, parts):
    rows = conversations()
    table = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({c: F.lit("clash") for c in ("key", "turns", "shard", "depth")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        turns = prefix_trie.sequences(table)
        plain = turns_of(rows)
        got = prefix_trie.trie(turns).select(*prefix_trie.FIGURES).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_trie(plain)
        made = {}
        for c, own in plain.items():
            h = zlib.crc32(str(c).encode()) % 9
            made[c] = plain.get(c - c % 5, [])[:h] + own[h:]
        got = prefix_trie.trie(queries.rebuilt(turns)).select(*prefix_trie.FIGURES).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_trie(made)
        assert [] in made.values() and any(len(s) > 20 for s in made.values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert prefix_trie.trie(prefix_trie.sequences(table.filter("conv_id = -1"))).count() == 0


def test_find_close_is_a_stacks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 64, 65, 1000, 5000):
        bits, level, stack, want = [1], 1, [0], {}
        opened = 1
        while level:
            up = opened < n and rng.random() < 0.5 + 0.4 * (n > 500)
            if up:
                stack.append(len(bits))
                opened += 1
            else:
                want[stack.pop()] = len(bits)
            bits.append(1 if up else -1)
            level += bits[-1]
            if level == 0 and opened < n:
                bits, level = [*bits[:-1]], 1
                stack.append(0)
                del want[0]
                bits.append(1)
                stack.append(len(bits) - 1)
                opened, level = opened + 1, 2
        excess = np.cumsum(bits)
        opens = np.flatnonzero(np.array(bits) > 0)
        assert dict(zip(opens.tolist(), prefix_trie.find_close(excess, opens).tolist(), strict=True)) == want


def test_least_of_ranges():
    values = np.random.default_rng(2).integers(0, 99, 77)
    pairs = [(a, b) for a in range(77) for b in range(a + 1, 78)]
    got = prefix_trie.least_of_ranges(values, *map(np.array, zip(*pairs, strict=True)))
    assert got.tolist() == [min(values[a:b]) for a, b in pairs]


# ---- 12 -----------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout):
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % fanout : i - i % fanout + fanout]
            steps[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            at[k] = i // fanout
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], steps


@pytest.mark.parametrize("fanout, levels", [(2, 10), (2, 1), (2, 2), (3, 1), (5, 0)])
def test_manifest(spark, fanout, levels):
    rng = random.Random(3)
    rows = [(i * 3 % 101 - 20, rng.choice(["a", None]), rng.choice(["en", "en", "dé", None]), rng.choice([5, None]), rng.choice(["", "x" * 3000, "é\n", None])) for i in range(101)]
    rows += [(None, None, None, None, None)] * 2 + [(1, "a", "alone", 1, "t"), (200, "s", "", 1, "t"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    clash = docs.withColumns({c: F.lit(1) for c in ("leaf", "root", "subroot", "steps", "node", "fold", "_at")})
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r[0], r[1], r[2], r[3], r[4])), r) for r in groups[g]) if g is None else sorted(((r[0] is not None, r[0] or 0, plain_leaf(r[0], r[1], r[2], r[3], r[4])), None) for r in groups[g])
        trees[g] = ([k[2] for k, _ in own], [k[1] if k[0] else None for k, _ in own], plain_tree([k[2] for k, _ in own], fanout))
    root, tops = plain_tree([trees[g][2][0] for g in order], fanout)
    want = []
    for g, top in zip(order, tops, strict=True):
        leaves, ids, (subroot, steps) = trees[g]
        want += [(i, leaf, subroot, root, tuple(s + top)) for i, leaf, s in zip(ids, leaves, steps, strict=True)]
    out = merkle.manifest(clash, fanout=fanout, levels=levels)
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["steps"]))) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    good = out.select(merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root"), merkle.fold(F.lit("0"), F.col("steps")) == F.col("root")).distinct().collect()
    assert [tuple(r) for r in good] == [(True, False)]
    assert merkle.manifest(clash.filter("doc_id = -99"), fanout=fanout, levels=levels).count() == 0


# ---- 13 -----------------------------------------------------------------------------------------------------------

KINDS = ("email", "ip", "card", "phone")
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def checked(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(CONTRACT[k], text) if checked(k, m[0])]


ODD = [
    "a@b.c_d@e.f .x@y.z a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.255 1.2.3", "4111 1111 1111 1111 5500-0000-0000-0004 4111111111111112 1 2 3",
    "+1 (509) 555-6973 +44 20 7946 0958 +1 (826) 555-4081 4111111111111111 + 5 +12", "", None, "é@b.c 日本 x@ü.de x@y.de\n\n+123456789\n", "card:4111111111111111,ip=10.0.0.1;tel(+4930123456)",
    "a" * 60_000, "1" * 20_000 + " " + "9." * 3000 + "@" * 500, "+1 " + "(" * 5000 + " +1234567890", "x.y-" * 3000 + "@" + "q." * 3000 + "z",
]


def pool():
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def one():
        return rng.choice([
            f"+1 ({digits(3)}) 555-{digits(4)}", card(), digits(16), f"user{digits(2)}@mail{digits(1)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)),
            f"order {digits(9)}", f"{digits(3)}.{digits(3)}.{digits(3)}", "plain words here", f"me@host{digits(1)}",
        ])

    texts = []
    for i in range(400):
        texts.append(" ".join(f"{rng.choice(['call', 'see', 'card', 'and', 'mail'])} {one()}{rng.choice([' ', '. ', ', ', chr(10)])}" for _ in range(rng.randrange(6))) + f"end {i}")
    far = " ".join(["word"] * 1500)
    texts += [
        "call (509) 555-6973 now", "write to joe [at] mail.example [dot] com today", f"card 4111.1111.1111.1111 or {card()} {card()}", "call +1 (826) 555-4081 190.137.223.204",
        f"{far}\ncall +1 (509) 555-6973 {far} {far} mail joe(at)example.org {far}", "nothing (at) all, 2024-01-15 12:30, v1.2.3", "defanged 10[.]0[.]0[.]1",
    ]
    return texts


def cut_blocks(text):
    """Blocks of 4,096 characters and on to a line's end or a space between letters."""
    out = []
    while text:
        end = len(text)
        for i in range(4096, len(text)):
            if text[i] == "\n" or (text[i] == " " and re.fullmatch("[A-Za-z] [A-Za-z]", text[i - 1 : i + 2])):
                end = i + 1
                break
        out.append(text[:end])
        text = text[end:]
    return out


def bins(x, *cuts):
    return sum(x >= c for c in cuts)


def candidates(text):
    """Per block the proposed spans as ``(kind, start, end, features, label, free)``."""
    base, start, tail = plain_base(text), 0, ""
    for block in cut_blocks(text):
        found = []
        for kind, pattern in private_spans.GENERATORS:
            last = 0
            for m in regex.finditer(pattern, block):
                left = ((tail if last == 0 and not any(f[0] == kind and f[6] == pattern for f in found) else "") + block[last : m.start()])[-24:]
                last, hit = m.end(), m[0]
                digits, runs = re.sub("[^0-9]", "", hit), re.findall("[0-9]+", hit)
                side = lambda ch: 0 if not ch or re.match(r"[ \t\n\x0b\f\r]", ch) else 1 if regex.match(r"[\p{L}\p{N}_]", ch) else 2
                plain = re.sub(r" ?[\[(](?:dot|DOT)[\])] ?", ".", re.sub(r" ?(?:[@＠]|[\[(](?:at|AT)[\])]) ?", "@", hit))
                good = bool(re.search(r"@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$", plain)) if kind == "email" else checked(kind, re.sub(r"[\[(](?:\.|dot)[\])]", ".", hit))
                cell = {
                    "digits": bins(len(digits), 9, 10, 12, 13, 17), "groups": bins(len(runs), 2, 3, 4), "longest": bins(max(map(len, runs), default=0), 4, 5, 13),
                    "separators": 3 if "(" in hit else min(2, len(set(re.findall("[ ._-]", hit)))), "before": side(left[-1:]), "after": side(block[m.end() : m.end() + 1]),
                    "cue": int(bool(re.search(private_spans.CUES[kind], left.lower()))), "valid": int(good), "lead": int(bool(re.match(r"\+|00", hit))),
                }
                a, b = start + m.start(), start + m.end()
                meets = [s for s in base if s[1] < b and a < s[2]]
                found.append((kind, a, b, cell, int(any(s[0] == kind for s in meets)), not meets, pattern))
        yield found
        start, tail = start + len(block), block[-24:]


def plain_model(texts):
    """Boosted trees on single candidates, all splits tried."""
    rows = defaultdict(list)
    for t in texts:
        held = zlib.crc32((t or "").encode()) % 4 == 3
        for block in candidates(t or ""):
            for kind, _, _, cell, label, *_ in block:
                rows[kind].append((cell, held, label))

    def tree(own, depth):
        g, h = sum(r[1] for r in own), sum(r[2] for r in own)
        best = None
        for name, most in private_spans.FEATURES.items() if depth else ():
            for cut in range(1, most + 1):
                lg, lh = sum(r[1] for r in own if r[0][name] < cut), sum(r[2] for r in own if r[0][name] < cut)
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > (best[0] if best else 1e-9) + 1e-9:
                    best = (gain, name, cut)
        if best is None:
            return lambda cell: 0.3 * g / (h + 1)
        _, name, cut = best
        low, high = tree([r for r in own if r[0][name] < cut], depth - 1), tree([r for r in own if r[0][name] >= cut], depth - 1)
        return lambda cell: high(cell) if cell[name] >= cut else low(cell)

    model = {}
    for kind, own in rows.items():
        train = [r for r in own if not r[1]]
        hits = sum(r[2] for r in train)
        trees, first = [], math.log((hits + 0.5) / (len(train) - hits + 0.5))
        score = lambda cell, trees=trees, first=first: round(first + sum(t(cell) for t in trees), 9)
        for _ in range(20 if hits else 0):
            p = [1 / (1 + math.exp(-score(r[0]))) for r in train]
            trees.append(tree([(r[0], r[2] - q, q * (1 - q)) for r, q in zip(train, p, strict=True)], 2))
        held = [(score(r[0]), r[2]) for r in own if r[1] and r[0]["valid"]]
        fits = [s for s, _ in held if s >= 0 and (sum(y for z, y in held if z >= s) + 1) / (sum(z >= s for z, _ in held) + 2) >= 0.9]
        model[kind] = (score, min(fits, default=None))
    return model


def plain_spans(text, model):
    out = plain_base(text)
    for block in candidates(text):
        good = []
        for kind, a, b, cell, _, free, _ in block:
            score, least = model.get(kind, (None, None))
            if free and cell["valid"] and least is not None and score(cell) >= least:
                good.append((round(score(cell) - least, 9), b - a, -a, -KINDS.index(kind), a, b, kind))
        good = set(good)
        out += [(g[6], g[4], g[5]) for g in good if not any(o > g and o[4] < g[5] and g[4] < o[5] for o in good)]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def test_private_spans(spark):
    texts = [*ODD, *pool(), "call +1 (826) 555-4081 190.137.223.204"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("base", "spans", "kind", "start", "_found", "c")})
    model = private_spans.fit(docs)
    out = {r["doc_id"]: r for r in private_spans.redact(private_spans.mark(docs, model)).collect()}
    assert len(out) == len(texts)
    plain = plain_model(texts)
    for k in KINDS:
        assert (model[k].threshold is None) == (plain[k][1] is None)
    more = 0
    for i, t in enumerate(texts):
        assert [tuple(s) for s in out[i]["base"]] == plain_base(t or ""), t
        spans = [tuple(s) for s in out[i]["spans"]]
        assert spans == plain_spans(t or "", plain), t
        more += len(spans) - len(out[i]["base"])
        want, at = "", 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            want, at = (want + t[at:a] + f"[{kind.upper()}]", b) if a >= at else (want, max(at, b))
        assert out[i]["redacted"] == (None if t is None else want + t[at:])
    assert more >= 5
    assert "call [PHONE] now" in [r["redacted"] for r in out.values()]
    none = docs.filter("doc_id = -1")
    empty = private_spans.fit(none)
    assert all(m.threshold is None for m in empty.values()) and private_spans.mark(none, empty).count() == 0
