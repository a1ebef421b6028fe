"""Each operator against brute force on small fixtures, with nulls, empty and long texts, repeats and clashing columns."""

import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallwise.llm import byte_bpe, jaccard_join, mixing, order_minhash, pitman_yor, quality, sharding, token_counts, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use for their results or inside.
CLASHING = "ids size shard slot kept score component_id n_shingles host path target taken fingerprint class_distance rank block sid goal n_docs purity template shape n_words predicted _at".split()

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def rows():
    base = text(1, 300)
    near = base.replace("alpha", "ALPHA", 3)
    edited = base.split()
    edited[10] = edited[200] = "changed"
    out = [
        (1, base, "en", "a", 1), (2, near, "en", "a", 1), (3, " ".join(edited), "en", "b", 1), (4, base, None, None, None),
        (5, None, "en", "b", 0), (6, "", None, "c", 0), (7, "  \n\t ", "en", None, 5), (8, "one two", "en", "b", 7), (9, "ONE two", "xx", "c", 7),
        (10, text(2, 4000) + "é" * 700 + " \n\n x", "fr", "a", 1), (11, "<|endoftext|> 日本語 'll  don't ", "en", "b", 1), (12, "a b\na b\n\na b", "en", "c", 1),
        (1, base, "en", "a", 1), (None, "no id here at all", "en", "a", 1),
    ]
    return out + [(20 + i, text(100 + i, 20 + 13 * i), "en", "abc"[i % 3], 1) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id = -99")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# ---- 1 ------------------------------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size, overlap", [(32_768, 256), (120, 12), (60, 4)])
def test_bpe_is_the_librarys(docs, rows, size, overlap):
    path, pattern, own = tokenizer()
    out = byte_bpe.decode(byte_bpe.encode(docs, path, pattern, chunk_chars=size, overlap=overlap), path, pattern).collect()
    assert len(out) == len(rows)
    want = Counter((i, tuple(own.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in out)


def test_bpe_of_a_very_long_text(spark):
    """Many chunks, one pre-token longer than the overlap; the work is in proportion to the text."""
    path, pattern, own = tokenizer()
    long = (text(3, 400_000) + " \n" + "x" * 5_000 + " été ") * 3
    out = byte_bpe.encode(spark.createDataFrame([(1, long), (1, long), (2, "")], "doc_id long, text string"), path, pattern).collect()
    want = own.encode_ordinary(long)
    assert sorted((r["doc_id"], r["ids"] == want) for r in out) == [(1, True), (1, True), (2, False)]


@pytest.mark.parametrize("size, overlap", [(32_768, 256), (60, 4)])
def test_bpe_decodes_where_it_encodes(docs, size, overlap):
    """Short texts, which are nearly all, take one Python worker a task for ids and decoded bytes, with the same rows as apart."""
    path, pattern, _ = tokenizer()
    both = byte_bpe.encode(docs, path, pattern, keep=["doc_id"], chunk_chars=size, overlap=overlap, decoded=True)
    apart = byte_bpe.decode(byte_bpe.encode(docs, path, pattern, keep=["doc_id"], chunk_chars=size, overlap=overlap), path, pattern)
    assert both.columns == apart.columns == ["doc_id", "ids", "decoded"]
    count = lambda df: Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in df.collect())
    assert count(both) == count(apart)
    short = both._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert short.count("ArrowEvalPython") == 1, short


def test_bpe_edges(none):
    path, pattern, _ = tokenizer()
    assert byte_bpe.encode(none, path, pattern).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(none, path, pattern, chunk_chars=10, overlap=8)


# ---- 2 ------------------------------------------------------------------------------------------------------------


M64 = (1 << 64) - 1


def mixed(x: int) -> int:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & M64
    return x ^ x >> 31


def plain_signature(body: str):
    """Order MinHash from the text: its k-mers as strings, numbered by occurrence, and whole numbers."""
    grams = [body[i : i + 6] for i in range(max(1, len(body) - 5))] if body else []
    seen, hashed = Counter(), []
    for g in grams:
        h = 0
        for ch in g:
            h = (h * 0x9E3779B97F4A7C15 + ord(ch) + 1) & M64
        hashed.append(mixed((mixed(h) + seen[g] * 0xD6E8FEB86659FD93) & M64) >> 32)
        seen[g] += 1
    slots = []
    for j in range(1, 65):
        seed = mixed(j * 0x632BE59BD9B4E019 & M64)
        rank = lambda i, odd=seed >> 32 | 1, shift=seed & 0xFFFFFFFF: ((hashed[i] * odd & 0xFFFFFFFF) ^ shift, i)
        h = seed
        for i in sorted(sorted(range(len(hashed)), key=rank)[:2]):
            h = mixed((h * 31 + hashed[i] + 1) & M64)
        slots.append((h >> 32 | 1) if hashed else 0)
    return slots


def own_likeness(a: str, b: str, tries: int = 1500) -> float:
    """The chance that two texts agree in a slot, with hash functions of its own."""
    def slots(body):
        seen, marks = Counter(), []
        for i in range(len(body) - 5):
            marks.append((body[i : i + 6], seen[body[i : i + 6]]))
            seen[marks[-1][0]] += 1
        return marks

    x, y = slots(a), slots(b)
    names = {m: k for k, m in enumerate(dict.fromkeys(x + y))}
    px, py = np.array([names[m] for m in x]), np.array([names[m] for m in y])
    rng, hits = np.random.default_rng(4), 0
    for _ in range(tries):
        r = rng.random(len(names))
        pick = lambda p: tuple(p[np.sort(np.argpartition(r[p], 1)[:2])])  # noqa: B023, E731
        hits += pick(px) == pick(py)
    return hits / tries


def test_likeness_is_that_of_other_hash_functions():
    base = text(7, 120)
    words = base.split()
    swapped = " ".join(words[60:] + words[:60])
    few = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    pairs = [(base, few), (base, swapped), (base, order_minhash.edited(base, text(8, 120))), (base, text(9, 120)), ("ab" * 200, "ab" * 150)]
    for a, b in pairs:
        got = order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(b))
        p = own_likeness(a, b)
        assert abs(got - p) < 3.5 * (p * (1 - p) / 64) ** 0.5 + 0.03


def test_signature_selects_the_least_in_text_order():
    a, b = text(5, 40), text(5, 30) + " " + text(6, 10)
    for body in (a, b, "short", "é日本 \U0001f600" * 9, "aaaaaaaaaaaaaaa"):
        assert order_minhash.signature(body).tolist() == plain_signature(body)
    assert not order_minhash.signature("").any() and not order_minhash.signature(None).any()


def test_signature_counts_repeats_and_order():
    a = "xyz" * 40 + "abcdefghij" * 5
    assert order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(a)) == 1
    assert order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(a[::-1])) < 0.2


def test_against_next(docs, rows, none):
    out = order_minhash.against_next(docs, 4).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    got = sorted(out, key=lambda r: (-(2**63) if r["doc_id"] is None else r["doc_id"]))
    for i, row in enumerate(order):
        own, following = row[1] or "", order[(i + 1) % len(order)][1] or ""
        changed = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        matches = [g for g in got if g["doc_id"] == row[0] and g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()]
        assert matches and matches[0]["n_chars"] == len(own)
        if len(own) < 3000 and len(following) < 3000:
            slots = [plain_signature(t) for t in (own, changed, following)]
            alike = lambda k, slots=slots: sum(x == y for x, y in zip(slots[0], slots[k])) / 64
            found = [(g["near_edited"], g["near_next"]) for g in matches]
            assert (alike(1), alike(2)) in found
            assert all(g["fingerprint"] == "".join(f"{x:08x}" for x in slots[0]) and g["edited_fingerprint"] == "".join(f"{x:08x}" for x in slots[1]) for g in matches)
    assert order_minhash.against_next(none, 4).count() == 0
    assert {r["fingerprint"] for r in order_minhash.fingerprint(docs).filter("doc_id = 1").collect()} == {g["fingerprint"] for g in got if g["doc_id"] in (1, 4)}


# ---- 3 ------------------------------------------------------------------------------------------------------------


def test_mixing(docs, rows, none, spark):
    sized = mixing.sized(docs.drop("size"))
    out = mixing.mix(sized, [5, 2, 1]).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["taken"]) for r in out) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["taken"]) for r in mixing.mix(sized.repartition(5), [5, 2, 1]).collect())
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s])
    assert mixing.mix(mixing.sized(none), [5, 2, 1]).count() == 0
    silent = mixing.sized(spark.createDataFrame([(1, None, "en", "a", 0)], SCHEMA))
    assert [(r["taken"], r["target"]) for r in mixing.mix(silent, [5, 2, 1]).collect()] == [(0, 0.0)]


def test_every_block_has_a_slot(spark):
    """Many sources of few blocks, which the points alone leave short, beside a large one."""
    sizes = [(f"s{i:03d}", 1 + i % 7) for i in range(300)] + [("z", 200_000)]
    sources = mixing.targets(spark.createDataFrame(sizes, "source string, size long"), [5, 2, 1], 1.5)
    got = defaultdict(list)
    slots = mixing.schedule(sources).collect()
    for r in slots:
        got[r["sid"]].append((r["slot"], r["rank"]))
    assert len({r["slot"] for r in slots}) == len(slots)
    for r in sources.collect():
        assert [rank for _, rank in sorted(got[r["sid"]])] == list(range(r["blocks"]))
    # the words taken are the targets, rounded down
    docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, size long")
    assert all(r["taken"] == int(r["target"]) for r in mixing.mix(docs, [5, 2, 1]).collect())


def test_targets_reshare_the_excess(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources, [5, 2, 1], 1.5).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx(2 * (3015 - 20) / 3) and got["c"] == pytest.approx((3015 - 20) / 3)


# ---- 4 ------------------------------------------------------------------------------------------------------------


def base_brute(t: str | None):
    t = t or ""
    words = t.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, seen, dup = Counter(windows), set(), 0
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_base(docs, rows, none):
    out = quality.judge(docs.withColumn("text", F.concat("text", F.lit("\na | b\na | b"), F.repeat(F.lit(" u v w x y"), 2)))).collect()
    for r in out:
        n, chars, symbols, dup, rep = base_brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and not (r["base_failed"] and r["kept"])
    assert len(out) == len(rows)
    assert quality.judge(none).count() == 0


def test_quality_divergence(spark):
    clean = [(i, " ".join(w.capitalize() if k % 9 == 0 else w for k, w in enumerate(text(i, 200).split())) + ".", "en") for i in range(60)]
    odd = [(100, " | ".join(text(300, 120).split()), "en"), (101, text(301, 120).upper().replace(" ", "!! "), "en")]
    out = by_id(quality.judge(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")), "kept")
    assert all(out[i] == (True,) for i, *_ in clean) and out[100] == out[101] == (False,)
    p, q = np.array([1.0, 1, 0]), np.array([0.0, 0, 5])
    assert quality.js_distance(p, q) == pytest.approx(1) and quality.js_distance(p, 7 * p) == 0


@pytest.mark.parametrize("parts", [1, 13])
def test_references_do_not_depend_on_the_partitions(spark, parts):
    """Exact common words and median profiles, also of words that only some batches hold."""
    rng = np.random.default_rng(1)
    made = []
    for i in range(130):
        ranks = np.minimum(rng.zipf(1.3, 40), 400) + (400 if i > 120 else 0)
        made.append((i, " ".join(f"w{r}" for r in ranks) + "!" * int(rng.integers(9)), "en" if i % 3 else None))
    made.append((999, "too little of a language", "xx"))
    refs = quality.references(spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(parts), 1 / 100, 100, 20)
    words = defaultdict(Counter)
    for _, t, lang in made:
        words[lang].update(quality.plain_words(t.encode()))
    everything = sum(c.total() for c in words.values())
    assert set(refs) == {"en", None}
    for lang, ref in refs.items():
        assert ref["n"] == words[lang].total()
        assert ref["words"] == {w: n for w, n in words[lang].items() if 100 * n >= everything} and len(ref["words"]) > 2
        shares = np.array([np.rint(quality.class_counts(t) * (quality.STEPS / len(t))) for _, t, own in made if own == lang])
        assert ref["classes"].tolist() == np.sort(shares, axis=0)[(len(shares) - 1) // 2].tolist()


# ---- 5 ------------------------------------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    e, trans = rng.normal(size=11), rng.normal(size=(2, 2))
    lengths = np.array([4, 0, 6, 1])
    p, forward, backward = toxicity._Chains(lengths).marginals(e, trans)
    inner = np.repeat(np.arange(4), lengths)
    got_pairs = toxicity._pairs(e, forward, backward, trans, inner[:-1] == inner[1:])
    at, all_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in range(2**n):
            y = [(path >> i) & 1 for i in range(n)]
            w = math.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            ones += w * np.array(y)
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += w
        assert np.allclose(p[at : at + n], ones / total if n else [])
        at += n
        all_pairs += pairs / total
    assert np.allclose(got_pairs, all_pairs)


def test_toxicity_learns_and_finds_spans(spark, docs, rows, none):
    rng = np.random.default_rng(0)
    train = []
    for i in range(400):
        words = [f"w{rng.integers(0, 400)}" for _ in range(30)]
        if i % 4 == 0:
            words[int(rng.integers(0, 30))] = "zounds" + "".join(rng.choice(list("abcdef"), 3))
        train.append((" ".join(words), int(i % 4 == 0)))
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    table = spark.createDataFrame([(1, "Héllo w1 w2 zoundsxyz w3"), (2, "Héllo w1 w2 w3"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[3]["score"] == got[4]["score"] == 0
    span = got[1]["spans"][0]
    assert "Héllo w1 w2 zoundsxyz w3"[span["start"] : span["end"]] == "zoundsxyz" and span["p"] >= 0.5
    assert toxicity.score(docs, model).count() == len(rows) and toxicity.score(none, model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit([""], [0])).collect()} == {0.0}
    texts = [t for t, _ in train] + ["", "some plain words", "x" * 3000, None]
    for one, t in zip(toxicity.tag(model, texts)[0], texts):
        _, _, p = toxicity.tag(model, [t])
        p = np.empty(0) if p is None else p
        strong = 1 - np.prod(1 - p[p >= toxicity.FLOOR]) if (p >= toxicity.FLOOR).any() else p.max(initial=0)
        assert one == pytest.approx(strong, abs=1e-9)


def test_training_rows_keep_the_fold(spark, docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (20, 0), (21, None), (None, 1), (22, 1)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, F.col("doc_id") == 22)
    assert sorted(y for _, y in got) == [0, 1]
    # long and missing documents take no place of the sample, and an id with many texts gives one
    made = [(i, f"text number {i} " * (900 if i < 40 else 1)) for i in range(60)] + [(50, f"other {j}") for j in range(30)] + [(51, None), (None, "x")]
    table = spark.createDataFrame(made, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    got = toxicity.training_rows(table, marks, sample=5)
    assert Counter(y for _, y in got) == {0: 10, 1: 5}
    assert all(len(t) <= 10_000 for t, _ in got) and toxicity.training_rows(table.limit(0), marks) == []


def chain_loss(e, trans, y):
    """The negative logarithm of the chance of the labels ``y``, by all labellings."""
    score = lambda z: sum(x for x, k in zip(e, z) if k) + sum(trans[i][j] for i, j in zip(z, z[1:]))
    every = [score(z) for z in itertools.product((0, 1), repeat=len(e))]
    return math.log(sum(map(math.exp, every))) - score(y)


def test_gradient_is_that_of_the_loss():
    """What training follows, against differences of the loss over all labellings."""
    rng = np.random.default_rng(6)
    lengths = np.array([4, 1, 6, 2])
    e, trans = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2))
    y = rng.integers(0, 2, lengths.sum())
    ends = np.cumsum(lengths)
    spans = list(zip(ends - lengths, ends))
    loss = lambda e, trans: sum(chain_loss(e[a:b].tolist(), trans.tolist(), y[a:b].tolist()) for a, b in spans)
    p, forward, backward = toxicity._Chains(lengths).marginals(e, trans)
    doc = np.repeat(np.arange(4), lengths)
    inner = doc[:-1] == doc[1:]
    pairs = toxicity._pairs(e, forward, backward, trans, inner)
    step = 1e-6
    for i in range(len(e)):
        d = np.eye(len(e))[i] * step
        assert (loss(e + d, trans) - loss(e - d, trans)) / (2 * step) == pytest.approx(p[i] - y[i], abs=1e-5)
    for i in (0, 1):
        for j in (0, 1):
            d = np.zeros((2, 2))
            d[i, j] = step
            seen = ((y[:-1][inner] == i) & (y[1:][inner] == j)).sum()
            assert (loss(e, trans + d) - loss(e, trans - d)) / (2 * step) == pytest.approx(pairs[i, j] - seen, abs=1e-5)


def test_training_lowers_the_loss_and_marks_are_counted():
    texts = [f"{'vile ' * (i % 2)}word {i} and {'vile slur' if i % 2 else 'good day'} w{i % 7}" for i in range(60)]
    labels = [i % 2 for i in range(60)]
    words = [t.split() for t in texts]
    codes = {w: k for k, w in enumerate(sorted({w for own in words for w in own}))}
    marks = np.array([codes[w] for own in words for w in own])
    doc = np.repeat(np.arange(60), [len(own) for own in words])
    toxic = np.array(labels, bool)
    got = toxicity.mark_tokens([marks], doc, toxic)
    rate = toxic[doc].mean()
    for at, (w, d) in enumerate(zip([w for own in words for w in own], doc)):
        seen1, seen0 = (sum(w in own for own, t in zip(words, labels) if t == y) for y in (1, 0))
        part = min(max(seen1 / (seen1 + seen0), 1e-9), 1 - 1e-9)
        surprise = (seen1 + seen0) * (part * math.log(part / rate) + (1 - part) * math.log((1 - part) / (1 - rate)))
        marked = part > rate and surprise >= math.log(len(codes) / 0.05) and seen1 / 30 >= 60 * (seen0 + 0.5) / 30
        assert got[at] == (marked and labels[d] == 1)
    assert got.any()
    scores = [toxicity.tag(toxicity.fit(texts, labels, steps=n), texts)[0] for n in (1, 20, 80)]
    gap = [s[toxic].mean() - s[~toxic].mean() for s in scores]
    assert gap[0] < gap[1] <= gap[2] + 1e-3 and scores[2][toxic].min() > 0.9 > 0.1 > scores[2][~toxic].max()


# ---- 6 ------------------------------------------------------------------------------------------------------------


def test_stirling_and_seating():
    log_s = pitman_yor.stirling(0.5, 6)
    assert np.exp(log_s[3, 1]) == pytest.approx(0.5 * 1.5) and np.exp(log_s[3, 2]) == pytest.approx(3 * 0.5) and np.exp(log_s[3, 3]) == pytest.approx(1)
    full = pitman_yor.stirling(0.5)
    c = np.full(40_000, 3)
    t = pitman_yor.seat(c, np.full(len(c), 2.0), 0.5, full, np.random.default_rng(1))
    w = np.array([np.exp(full[3, k]) * 2.0**k for k in (1, 2, 3)])
    assert np.allclose(np.bincount(t, minlength=4)[1:] / len(c), w / w.sum(), atol=0.01)
    assert pitman_yor.seat(np.array([0, 1]), np.array([3.0, 3.0]), 0.5, full, np.random.default_rng(1)).tolist() == [0, 1]


@pytest.mark.parametrize("discount", [0.5, 0.8, 0.85])
def test_large_dishes_have_the_models_tables(discount):
    """Mean and spread of the tables by the exact weights, also far above the recurrence's table."""
    row, rows, t = np.full(5002, -np.inf), {}, np.arange(5002)
    row[1] = 0.0
    for c in range(1, 5000):
        stay = np.where(c > t * discount, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + row
        row = np.logaddexp(np.concatenate(([-np.inf], row[:-1])), stay)
        if c + 1 in (65, 200, 1000, 5000):
            rows[c + 1] = row[: c + 2].copy()
    small = pitman_yor.stirling(discount)
    for c, log_s in rows.items():
        for a in (0.05, 0.5, 2.0, 20.0, 200.0):
            k = np.arange(1, c + 1)
            w = log_s[1 : c + 1] + k * np.log(a)
            w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
            mean = (w * k).sum()
            spread = np.sqrt((w * k * k).sum() - mean**2)
            got = pitman_yor.seat(np.full(20_000, c), np.full(20_000, a), discount, small, np.random.default_rng(5))
            assert abs(got.mean() - mean) < 0.03 * spread + 0.01 and abs(got.std() - spread) < 0.04 * spread, (c, a)


def test_blocks_are_dealt_evenly():
    for parts, blocks, shards in ((48, 1, 16), (400, 1, 64), (32, 4, 32)):
        homes = Counter(pitman_yor.home_of(part * (1 << 32) + n, shards) for part in range(parts) for n in range(blocks))
        assert len(homes) > shards * 0.6 and max(homes.values()) < 4 * parts * blocks / shards + 6


@pytest.mark.parametrize("share", [1 / 65_536, 0.02])
def test_language_model(docs, rows, none, share):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = pitman_yor.score(docs, held, pitman_yor.Settings(frequent_share=share)).collect()
    counts, tokens = Counter(), []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split() + [None]
        tokens.append((i, w))
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 1.2
    assert pitman_yor.score(none, held).count() == 0


def test_every_context_has_its_restaurant(spark, monkeypatch):
    """600 words, each below a 1/256 share of the tokens, each always followed by its own second word."""
    monkeypatch.setattr(pitman_yor, "SHARD_CHARS", 40_000)
    monkeypatch.setattr(pitman_yor, "BLOCK_CHARS", 20_000)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 600, 50)), "en", "a", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for share in (1 / 65_536, 0.005):
        out = [r for r in pitman_yor.score(df, F.col("doc_id") % 5 == 0, pitman_yor.Settings(frequent_share=share)).collect() if r["doc_id"] % 5 == 0]
        assert len(out) == 60
        # a first word has a chance of 1 in 600 (-2.8), a second one follows; without its context it has about -3.1
        assert sum(r["score"] for r in out) / sum(r["n_tokens"] for r in out) > -2


def toy_shard(counts):
    """All dishes of ``counts`` (contexts by words, the last word unknown) as one shard."""
    n_contexts, n_words = counts.shape
    word, context = np.repeat(np.arange(n_words), n_contexts), np.tile(np.arange(n_contexts), n_words)
    return pitman_yor.Shard(np.arange(n_words, dtype=np.uint64), np.arange(n_contexts, dtype=np.uint64), word, context, counts.T.ravel(), np.arange(word.size))


def toy_model(counts, s, frequent=()):
    """The passes over one shard; the probabilities as contexts by words."""
    shard = toy_shard(counts)
    known = counts.shape[1] - 1
    words = np.array(frequent, np.uint64)
    corpus = pitman_yor.Corpus(int(counts.sum()), known, words, counts.sum(axis=0)[list(frequent)], words)
    once = np.minimum(shard.c, 1)

    def sums(t):
        at = pitman_yor.find(corpus.words, shard.words)[shard.word]
        return np.bincount(shard.context, t).astype(float), np.bincount(at[at >= 0], t[at >= 0], len(words)).astype(np.int64)

    seatings = [(once, None, None)]
    after = pitman_yor.parent_of(np.array([once.sum()]), sums(once)[1][None], np.array([known - len(words)]), corpus, s, 0)
    for turn in range(1, s.turns + 1):
        seatings = list(pitman_yor.sample(shard, sums(seatings[-1][0])[0], corpus, after, s, 1, turn))
        rare = np.array([w[pitman_yor.find(corpus.words, shard.words) < 0].sum() for _, _, w in seatings])
        after = pitman_yor.parent_of(np.array([t.sum() for t, _, _ in seatings]), np.stack([sums(t)[1] for t, _, _ in seatings]), rare, corpus, s, turn)
    p = pitman_yor.predict(shard, seatings, np.bincount(shard.context, shard.c), np.stack([sums(t)[0] for t, _, _ in seatings]), corpus, after, s)
    return p.reshape(counts.shape[::-1]).T


@pytest.mark.parametrize("frequent", [(), (0, 2), (0, 1, 2, 3)])
def test_probabilities_sum_to_one(frequent):
    """Over the known words and the unknown one, in every context, also in one never seen."""
    counts = np.random.default_rng(2).integers(0, 400, (5, 5)) * np.array([1, 1, 0, 1, 1])
    counts[:, 2] = np.array([1, 0, 2, 0, 70])
    counts[3] = 0
    counts[:, 4] = 0
    p = toy_model(counts, pitman_yor.Settings(), frequent)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-9) and (p > 0).all()


def gibbs_brute(counts, s, sweeps, seed):
    """Customer by customer: each leaves its table and sits down again, in the contexts and in the parent."""
    rng = np.random.default_rng(seed)
    n_contexts, n_words = counts.shape
    known = n_words - 1
    seats = [[[] for _ in range(n_words)] for _ in range(n_contexts)]  # customers of each table
    parent = [[] for _ in range(n_words)]

    def parent_p(w):
        guests, tables = sum(map(sum, parent)), sum(map(len, parent))
        return (sum(parent[w]) - s.parent_discount * len(parent[w]) + (s.parent_strength + s.parent_discount * tables) / (known + 1)) / (s.parent_strength + guests)

    def sit(tables, discount, opening):
        weight = np.array([n - discount for n in tables] + [opening])
        k = int(rng.choice(len(weight), p=weight / weight.sum()))
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k == len(tables) - 1 and tables[k] == 1

    def leave(tables):
        k = int(rng.choice(len(tables), p=np.array(tables) / sum(tables)))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def enter(u, w):
        opened = sum(map(len, seats[u]))
        if sit(seats[u][w], s.discount, (s.strength + s.discount * opened) * parent_p(w)):
            sit(parent[w], s.parent_discount, (s.parent_strength + s.parent_discount * sum(map(len, parent))) / (known + 1))

    customers = [(u, w) for u in range(n_contexts) for w in range(n_words) for _ in range(counts[u, w])]
    for u, w in customers:
        enter(u, w)
    total = np.zeros(counts.shape)
    for sweep in range(sweeps):
        for u, w in customers:
            if leave(seats[u][w]):
                leave(parent[w])
            enter(u, w)
        if sweep >= sweeps // 4:
            p_word = np.array([parent_p(w) for w in range(n_words)])
            for u in range(n_contexts):
                t = np.array([len(x) for x in seats[u]])
                total[u] += (counts[u] - s.discount * t + (s.strength + s.discount * t.sum()) * p_word) / (s.strength + counts[u].sum())
    return total / (sweeps - sweeps // 4)


@pytest.mark.parametrize("frequent", [(), (0, 1, 3)])
def test_probabilities_are_those_of_customer_by_customer_gibbs(frequent):
    """After some turns, of rare and of frequent words; the default's two come near."""
    counts = np.array([[9, 1, 0, 3, 0, 0], [0, 6, 1, 1, 1, 0], [2, 0, 0, 12, 0, 0], [1, 1, 1, 1, 1, 0]])
    want = np.mean([gibbs_brute(counts, pitman_yor.Settings(), 1000, k) for k in (3, 4)], axis=0)
    assert np.allclose(want.sum(axis=1), 1)
    for turns, near in ((2, 0.09), (8, 0.04)):
        got = np.mean([toy_model(counts, pitman_yor.Settings(turns=turns, burn_in=20, sweeps=100, seed=i), frequent) for i in range(8)], axis=0)
        assert np.abs(np.log10(got / want)).max() < near and np.abs(got - want).max() < 0.03


def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SHARD_CHARS", 60_000)
    monkeypatch.setattr(pitman_yor, "BLOCK_CHARS", 30_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = [by_id(pitman_yor.score(docs.repartition(n), F.col("doc_id") % 7 == 2, pitman_yor.Settings(frequent_share=1 / 2_000)), "score", "base_score") for n in (1, 13, 60)]
    assert len(out[0]) == 200
    for other in out[1:]:
        assert all(other[i] == pytest.approx(v, rel=1e-12) for i, v in out[0].items())


def test_frequent_words_do_not_depend_on_the_batches(spark, rows):
    """Also where no partition holds eight occurrences of a word."""
    df = spark.createDataFrame([(r[0], r[1], False) for r in rows], "doc_id long, text string, held_out boolean")
    counts = Counter(w for r in rows for w in [*(r[1] or "").encode().lower().split(), None])
    n = sum(counts.values())
    for parts in (1, 40):
        corpus = pitman_yor.vocabulary(df.repartition(parts), pitman_yor.Settings(frequent_share=5 / n, coded_share=3 / n), 3)
        assert (corpus.n, corpus.known) == (n, len(counts))
        assert sorted(corpus.counts.tolist()) == sorted(c for c in counts.values() if c >= 5)
        assert len(corpus.coded) == sum(c >= 3 for c in counts.values())


# ---- 7 ------------------------------------------------------------------------------------------------------------


def unigram(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.Unigram(pieces, 0, True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    return own


def test_token_counts_are_the_librarys(docs, rows, none, spark):
    import public_tokenizers as tokenizers

    pieces = token_counts.load_pieces(tokenizers.path("piece_bpe_32k.model"))
    bytes_ = [(f"<0x{b:02X}>", -1e9) for b in range(256)]
    own = unigram([("<unk>", 0.0), *bytes_, *pieces])
    assert not {"<s>", "</s>", "<unk>", "<0x41>"} & {p for p, _ in pieces}
    for t in ("a <s> <0x41>", "x<s>y<0x41>z</s>"):
        assert token_counts.Counter(pieces).text(t)[1] == len(own.encode(t, add_special_tokens=False).ids)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count(docs, pieces).collect())
    assert got == sorted((i is None, i or 0, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert token_counts.count(none, pieces).count() == 0
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counter = token_counts.Counter(pieces)
    for t in given.values():
        assert counter.text(t)[1] == len(own.encode(t, add_special_tokens=False).ids)


def test_token_count_ties():
    """Few distinct scores, so that many paths tie; rare and unknown characters; pieces of several bytes."""
    bytes_ = [(f"<0x{b:02X}>", -9.0) for b in range(256)]
    rng = np.random.default_rng(4)
    alphabet = "abcé日" + token_counts.MARK
    words = {"".join(rng.choice(list(alphabet), int(rng.integers(1, 5)))) for _ in range(80)} - {""}
    pieces = [("<unk>", 0.0), *bytes_, *((w, float(-rng.integers(1, 4))) for w in sorted(words) if w != "c")]
    own, counter = unigram(pieces), token_counts.Counter(pieces)
    for n in range(300):
        t = "".join(rng.choice(list("abcé日 \nx" + "𝄞"), int(rng.integers(0, 40))))
        assert counter.text(t)[1] == len(own.encode(t, add_special_tokens=False).ids), t


# ---- 8 ------------------------------------------------------------------------------------------------------------


def components_brute(rows, percent=80, k=5):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted((i is None, i or 0, len(s), -1 if (c := least.get(root(a)) if s else i) is None else c) for a, (i, s) in enumerate(sets))


def test_jaccard_join(docs, rows, none):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in jaccard_join.join(docs).collect())
    assert got == components_brute(rows)
    assert jaccard_join.join(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_of_edited_copies(spark, monkeypatch, seed):
    """Groups of copies edited more or less, over several blocks and shards, with a passage that all share."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(jaccard_join, "SHARD_SHINGLES", 3_000)
    rng = np.random.default_rng(seed)
    passage, rows = text(9999, 60), []
    for g in range(12):
        base = [f"g{g}x{rng.integers(0, 60)}" for _ in range(int(rng.integers(30, 140)))]
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, 8))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w) + (" " + passage if rng.random() < 0.5 else ""), "en", "a", 1))
    got = sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == components_brute(rows)


def near_threshold(seed, count):
    """Copies of one text of 104 words with a few words changed, so that their likeness to it is around the threshold; some are cut short."""
    rng, rows = np.random.default_rng(seed), []
    base = [f"w{i}" for i in range(104)]
    for i in range(count):
        w = list(base)
        for at in rng.choice(104, int(rng.integers(1, 6)), replace=False):
            w[at] = f"e{rng.integers(0, 40)}"
        cut = int(rng.integers(0, 30)) if rng.random() < 0.5 else 0
        rows.append((i, " ".join(w[: len(w) - cut] if rng.random() < 0.5 else w[cut:]), "en", "a", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_around_the_threshold(spark, monkeypatch, seed):
    """Sets that do not link with their hub but with others of its star, over several blocks of a star."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", 16)
    monkeypatch.setattr(jaccard_join, "SHARD_SETS", 20)
    rows = near_threshold(seed, 150)
    got = sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == components_brute(rows)


@pytest.mark.parametrize("size", [80, 81])
def test_jaccard_join_of_sizes_at_the_threshold(spark, size):
    """Over three blocks of sets of one size, the least that links with a set of 100, which holds one of them."""
    long = [f"w{i}" for i in range(104)]
    rows = [(i, " ".join([*long[: size - 30], *(f"x{i}y{j}" for j in range(34))]), "en", "a", 1) for i in range(100)]
    rows += [(100, " ".join(long), "en", "a", 1), (101, " ".join(long[: size + 4]), "en", "a", 1)]
    got = sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == components_brute(rows) and got[-1][-1] == 100


@pytest.mark.parametrize("copies", [2000, 6000])
def test_searches_of_a_large_group_are_few(spark, monkeypatch, copies):
    """Copies that mostly do not link with each other: the rows made are in proportion to them, linked sets meet and others stay apart."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(64)]
    rows = []
    for i in range(copies):
        w = list(base)
        for at in rng.choice(64, 2, replace=False):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w), "en", "a", 1))
    made = []

    def counted(*args, search=jaccard_join.searches):
        found, shards = search(*args)
        made.append(found.count())
        return found, shards

    monkeypatch.setattr(jaccard_join, "searches", counted)
    out = jaccard_join.join(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert sum(made) < 3 * copies
    # all pairs, by the positions that a set still shares with the original; further edits never agree
    kept = np.array([[w == f"w{j}" for j, w in enumerate(r[1].split())] for r in rows])
    shingle = np.stack([kept[:, j : j + 5].all(axis=1) for j in range(60)], axis=1).astype(np.float32)
    parent = list(range(copies))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(copies):
        both = shingle[i] @ shingle[:i].T
        for j in np.flatnonzero(100 * both >= 80 * (120 - both)).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(copies)}


# ---- 9 ------------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    urls = {
        1: "https://A.Example.ORG/es/5?x#y", 2: "http://example.org/en/12", 3: "http://example.org/en/2", 4: "http://x.com/de/1", 5: "http://x.com/fr/1#de",
        6: None, 7: "no scheme/de/1", 8: "http://notexample.org/es/1", 9: "http://y.net/de/9", 10: "http://org?q", 11: "https://x.com/DE/1", 12: "",
    }
    extra = [(100 + i, f"http://{h}.com/{p}/{i}") for i in range(30) for h, p in (("x", "de"), ("x", "fr"))]
    table = spark.createDataFrame([*urls.items(), *extra], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "template": F.lit(3)})
    got = {r["page_id"]: r for r in url_filter.judge(table, rules).collect()}
    assert len(got) == len(urls) + 30
    assert [got[i]["rule"] for i in range(1, 13)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", None, None, "org/", None, None, None, None]
    assert (got[1]["host"], got[1]["path"]) == ("a.example.org", "/es/5") and (got[6]["host"], got[7]["path"]) == ("", "") and got[10]["host"] == "org"
    assert got[9]["verdict"] == "block" and got[11]["verdict"] in ("allow", "block") and got[3]["verdict"] == "allow"
    assert url_filter.judge(table.filter("page_id < 0"), rules).count() == 0


# ---- 10 -----------------------------------------------------------------------------------------------------------


def test_sharding(docs, rows, none, tmp_path):
    keyed = sharding.with_keys(docs).persist()
    out = sharding.assign(keyed, 5).collect()
    assert len(out) == len(rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in out)
    assert all(abs(b - sum(sizes.values()) / 5) <= largest for b in sizes.values())
    assert sharding.assign(sharding.with_keys(none), 5).count() == 0
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), 3)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_sharding_evens_and_keeps_equal_texts(spark):
    texts = [(i, "same text" if i % 3 == 0 else text(i % 500, 30 + i % 7)) for i in range(3000)]
    out = sharding.assign(sharding.with_keys(spark.createDataFrame(texts, "doc_id long, text string")).persist(), 8, tolerance=0.02).collect()
    sizes, homes = Counter(), defaultdict(set)
    for r in out:
        sizes[r["shard"]] += r["size"]
        homes[r["text"]].add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert all(abs(b - mean) <= 0.06 * mean for b in sizes.values())
    assert sum(len(h) > 1 for t, h in homes.items() if t != "same text") <= 7


def test_quality_word_histogram_decides(spark):
    """Texts with the reference's characters and other words: only the word rule can tell."""
    rng = np.random.default_rng(9)
    common = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "el", "is", "or", "ut")]
    others = ["".join(rng.choice(list("bcdfghjklmaneliosrut"), 3)) + "q" for _ in range(400)]
    clean = [(i, " ".join(rng.choice(common, 400)), "en") for i in range(60)]
    odd = [(100 + i, " ".join(w[:3] for w in rng.choice(others, 400)), "en") for i in range(3)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert all(out[i]["kept"] for i, *_ in clean)
    assert all(not out[i]["kept"] and not out[i]["base_failed"] and out[i]["class_distance"] <= 0.185 for i, *_ in odd)
