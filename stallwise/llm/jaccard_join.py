"""N-gram Jaccard join: components of documents whose shingle sets are alike.

Documents with one and the same set form a class and are joined once, by the
smallest id. The join of the classes is exact:

1. Every shingle's document frequency is counted. Sets travel as 32-bit
   fingerprints in blocks, one blob a block and hash shard; the shards send back
   one byte a shingle. A set is then ordered by frequency and hash. Two sets that
   reach the threshold share a shingle within the first ``n - ceil(t n) + 1`` of
   both (prefix filter), so the index lists hold only such shingles, and of those
   only the ones that two documents have: most documents never enter a list.
2. Answers from a similar set: each set is compared with one hub, the most central
   set of most of its lists, and once more with one of another component. A hub and
   the sets compared with it are a star. What a set shares with its hub is kept, as a
   bit for each of the hub's elements and the few elements besides.
3. In lists that still hold several components the entries of one star are a block,
   and a block is skipped as a whole when its sizes or its smallest position cannot
   reach the overlap that the threshold asks for. The sets left are searched in the
   stars left: their exact intersection with each member follows from what both share
   with the hub, without their elements. Stars are cut in blocks of bounded size over
   the tasks, and a block emits a link only where it joins two components. A set that is
   searched for is sent to each block of its star: the rows made are in proportion to
   the sets up to ``SEARCHED`` sets a star (about 5 MB of what they share), and beyond
   that there are as many more of them as the star has blocks.

The blobs of step 1 are a row for each block and shard with shingles in common, so
never more than there are shingles. Rows of one id are one document here: what the
text of either links with is in the component of both. Each different set of such an id,
and of a null one, is joined under a number of its own, and the components are then merged by id.

Null and empty texts have an empty set, link with nothing and are their own
component. Fewer words than ``k`` are one shingle. Repeated rows each give a row.
An empty table gives an empty result. Very long texts are blocks of their own. Shingles of
equal frequency are ordered by hash, hubs that are equally central by id. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
A null id has the component of what its set links with, null if no id is there; it links as any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.graph import components, extended
from stallwise.llm.memory import give_back
from stallwise.llm.tokens import Tokens, mix64, runs
from stallwise.session import cut_lineage

BLOCK_CHARS = 8_000_000
#: Characters whose shingles are made at once; a worker keeps the memory that its largest run took.
RUN_CHARS = 500_000
SHARD_SHINGLES = 2_000_000
#: Sets that meet one copy of their hub, sets of a star that are searched together, and sets that one task searches for, about.
MEMBERS = 1024
SEARCHED = 32_768
SHARD_SETS = 4096
#: Frequencies from here on share a byte by their magnitude.
EXACT_FREQUENCY = 200


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit hashes of its ``k``-word shingles."""
    return [s for a, b in runs(texts, RUN_CHARS) for s in _shingle_sets(texts[a:b], k)]


def _shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    tokens = Tokens(texts)
    h, counts = tokens.hashes(), tokens.counts()
    ends = np.cumsum(counts)
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(h) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(k):
            rolled += h[i : i + n] * odd[i]
        rolled = mix64(rolled)
    out = []
    for c, end in zip(counts.tolist(), ends.tolist()):
        if c >= k:
            out.append(np.unique(rolled[end - c : end - k + 1]))
        elif c:
            out.append(mix64((h[end - c : end] * odd[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _set_ids(docs: DataFrame, k: int, *kept: str) -> DataFrame:
    @F.arrow_udf("struct<n:bigint,set_id:string,chars:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        sets = shingle_sets(rows, k)
        ids = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
        n = pa.array([len(s) for s in sets], pa.int64())
        del sets
        give_back()
        return pa.StructArray.from_arrays([n, pa.array(ids, pa.string()), pa.array([len(t or "") for t in rows], pa.int64())], ["n", "set_id", "chars"])

    return docs.select("doc_id", *kept, run("text").alias("_s")).select("doc_id", *kept, F.col("_s.n").alias("n_shingles"), "_s.set_id", "_s.chars")


def _block_sets(texts: pa.Table, chosen: set, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids and sets of a block's chosen documents, in one order whatever the rows' order."""
    rows = sorted({(d, t) for d, t in zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist()) if d in chosen})
    sets = shingle_sets([t for _, t in rows], k)
    return np.array([d for d, _ in rows], np.int64), sets


def _by_shard(sets: list[np.ndarray], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The flat hashes' order by shard, and each shard's count."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    shard = ((flat >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    return np.argsort(shard, kind="stable"), np.bincount(shard, minlength=shards)


def ordered_sets(docs: DataFrame, reps: DataFrame, k: int, blocks: int, shards: int, percent: int) -> DataFrame:
    """``node``, ``n``, ``lo`` and ``elements``: the sets that have a shared shingle in their prefix.

    ``elements`` is in order of frequency and hash, ``lo`` the place of its first shared one.
    """
    def block(node: str):
        return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int").alias("block")

    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(block("doc_id"), "doc_id", "text")
    members = reps.select(block("rep"), F.col("rep").alias("doc_id"), F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("levels"))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        _, sets = _block_sets(left, set(right["doc_id"].to_pylist()), k)
        order, counts = _by_shard(sets, shards)
        prints = np.concatenate(sets)[order].astype(np.uint32) if sets else np.empty(0, np.uint32)
        cuts = np.split(prints, np.cumsum(counts)[:-1])
        number = left["block"][0].as_py() if left.num_rows else 0
        rows = [(number, s, c.tobytes()) for s, c in enumerate(cuts) if len(c)]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("block", "shard", "prints"), zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int32(), pa.binary()))})

    def count(group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint32) for b in group["prints"].to_pylist()]
        _, number, times = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
        level = np.where(times < EXACT_FREQUENCY, times, EXACT_FREQUENCY + np.log2(np.maximum(times, 1)).astype(np.int64)).astype(np.uint8)[number]
        parts = np.split(level, np.cumsum([len(b) for b in blobs])[:-1])
        return pa.table({"block": group["block"], "shard": group["shard"], "levels": pa.array([p.tobytes() for p in parts], pa.binary())})

    def receive(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sets = _block_sets(left, {d for d in right["doc_id"].to_pylist() if d is not None}, k)
        order, _ = _by_shard(sets, shards)
        blobs = sorted((s, b) for s, b in zip(right["shard"].to_pylist(), right["levels"].to_pylist()) if s >= 0)
        levels = np.empty(len(order), np.uint8)
        levels[order] = np.frombuffer(b"".join(b for _, b in blobs), np.uint8)
        out, at = [], 0
        for node, own in zip(ids.tolist(), sets):
            n, level = len(own), levels[at : at + len(own)]
            at += n
            lo = int((level < 2).sum())
            if lo < n - -(-percent * n // 100) + 1:
                out.append((node, n, lo, own[np.lexsort((own, level))].view(np.int64)))
        node, n, lo, elements = zip(*out) if out else ((), (), (), ())
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.table({name: pa.array(v, t) for name, v, t in zip(("node", "n", "lo", "elements"), (node, n, lo, list(elements)), kinds)})

    sent = texts.groupBy("block").cogroup(members.groupBy("block")).applyInArrow(send, "block int, shard int, prints binary")
    levels = sent.groupBy("shard").applyInArrow(count, "block int, shard int, levels binary")
    back = members.unionByName(levels.select("block", F.lit(None).cast("long").alias("doc_id"), "shard", "levels"))
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(receive, "node bigint, n int, lo int, elements array<bigint>")


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """The index: ``shingle``, ``node``, ``n`` and ``pos`` for the shared shingles of each prefix."""
    width = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - F.col("lo")
    extra = [c for c in sets.columns if c not in ("node", "n", "lo", "elements")]
    return sets.select("node", "n", "lo", *extra, F.posexplode(F.slice("elements", F.col("lo") + 1, width.cast("int"))).alias("_i", "shingle")).select(
        "shingle", "node", "n", "lo", (F.col("lo") + F.col("_i")).alias("pos"), *extra
    )


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``x``, ``y``) with ``n``, what ``x`` shares with the hub ``y`` and what it has besides.

    ``both`` is the intersection's size and ``either`` the union's; ``kept`` has a bit for
    each of the hub's elements in sorted order, ``extra`` the other shared elements of ``x``.
    Pairs of a hub with many are dealt over several copies of it.
    """

    @F.arrow_udf("struct<both:int,kept:binary,extra:array<bigint>>")
    def relate(own: pa.Array, first: pa.Array, hub: pa.Array) -> pa.Array:
        rows = [_relation(*row) for row in zip(_arrays(own), first.to_pylist(), _arrays(hub))]
        both, kept, extra = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(both, pa.int32()), pa.array(kept, pa.binary()), pa.array(list(extra), pa.list_(pa.int64()))], ["both", "kept", "extra"])

    many = pairs.groupBy("y").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_copies")).filter("_copies > 1")
    copy = F.coalesce("_copies", F.lit(1))
    a = pairs.join(many, "y", "left").withColumn("_copy", F.pmod(F.xxhash64("x"), copy).cast("int")).drop("_copies")
    a = a.join(sets.select(F.col("node").alias("x"), "n", "lo", F.col("elements").alias("_own")), "x")
    b = sets.join(pairs.select(F.col("y").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("y"), F.col("elements").alias("_hub"))
    b = b.join(many, "y", "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copy - 1))).drop("_copies")
    joined = a.join(b, ["y", "_copy"]).withColumn("_r", relate("_own", "lo", "_hub")).withColumn("_size", F.size("_hub"))
    return joined.select("x", "y", "n", "_r.both", (F.col("n") + F.col("_size") - F.col("_r.both")).alias("either"), "_r.kept", "_r.extra")


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _relation(own: np.ndarray, first: int, hub: np.ndarray) -> tuple[int, bytes, np.ndarray]:
    """Shared elements, the hub's that the set has as bits, and the set's others that are in any other set."""
    kept = np.isin(np.sort(hub), own)
    return int(kept.sum()), np.packbits(kept).tobytes(), np.setdiff1d(own[first:], hub, assume_unique=True)


def star_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """For each set one hub of another component to compare it with: ``x`` and ``y``.

    A list's hub is its most central set, the one with the least share of elements that
    no other set has: an original is more central than its edited copies, which are
    nearer to it than to each other. A set takes the hub of most of its lists.
    """
    lists = postings(labelled, percent)
    central = F.struct((F.col("lo") / F.col("n")).alias("own"), "n", "node", "component")
    hubs = lists.groupBy("shingle").agg(F.min(central).alias("_hub"), F.min("component").alias("_c0"), F.max("component").alias("_c1"))
    hub_n = F.col("_hub.n")
    return (
        lists.join(hubs.filter("_c0 <> _c1"), "shingle")
        .filter(F.col("component") != F.col("_hub.component"))
        .filter(100 * F.least("n", hub_n) >= percent * F.greatest("n", hub_n))
        .groupBy("node", F.col("_hub.node").alias("hub"))
        .count()
        .groupBy("node")
        .agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
        .select(F.col("node").alias("x"), F.col("hub").alias("y"))
    )


def stars(sets: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """Each set's star, and of the star its number of ``members``, of ``blocks`` and its ``main`` component.

    A hub and a set without one are in their own star, every other set in its hub's. A star
    is cut in blocks of about ``SEARCHED`` sets.
    """
    hubs = known.select(F.col("y").alias("node")).distinct().withColumn("_is_hub", F.lit(True))
    own = known.select(F.col("x").alias("node"), F.col("y").alias("_hub"))
    rows = _labelled(sets.select("node", "n"), labels).join(hubs, "node", "left").join(own, "node", "left")
    rows = rows.withColumn("star", F.when(F.col("_is_hub"), F.col("node")).otherwise(F.coalesce("_hub", "node"))).drop("_is_hub", "_hub")
    sizes = rows.groupBy("star", "component").agg(F.count("*").alias("_n")).groupBy("star")
    sizes = sizes.agg(F.sum("_n").alias("members"), F.max_by("component", F.struct("_n", "component")).alias("main"))
    return rows.join(sizes.withColumn("blocks", F.ceil(F.col("members") / SEARCHED).cast("int")), "star")


def candidates(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``star``: the sets that may link with a set of another component in that star.

    In each list of several components the entries of one star are a block, skipped as a
    whole when its sizes or its smallest position cannot reach the overlap that the
    threshold asks for. Of two sets of one star the one outside its main component is
    named, of two stars the sets of the smaller.
    """
    t = percent / 100
    entries = postings(sets.join(placed.select("node", "component", "star", "members", "main"), "node"), percent)
    entries = entries.withColumn("_room", F.col("n") - F.col("pos"))
    blocks = entries.groupBy("shingle", "star", "members").agg(
        F.min("n").alias("_n0"), F.max("n").alias("_n1"), F.max("_room").alias("_rooms"), F.min("component").alias("_c0"), F.max("component").alias("_c1")
    )
    mixed = blocks.groupBy("shingle").agg(F.min("_c0").alias("_all0"), F.max("_c1").alias("_all1")).filter("_all0 <> _all1").select("shingle")
    blocks = blocks.join(mixed, "shingle", "left_semi").select("shingle", F.col("star").alias("_star"), F.col("members").alias("_members"), "_n0", "_n1", "_rooms", "_c0", "_c1")
    same = (F.col("star") == F.col("_star")) & (F.col("component") != F.col("main"))
    smaller = F.struct("members", "star") < F.struct(F.col("_members").alias("members"), F.col("_star").alias("star"))
    reach = F.least("_room", "_rooms") >= t / (1 + t) * (F.col("n") + F.greatest("_n0", F.ceil(t * F.col("n") - 1e-9))) - 1e-9
    return (
        entries.join(blocks, "shingle")
        .filter((same | smaller) & ((F.col("_c0") != F.col("component")) | (F.col("_c1") != F.col("component"))))
        .filter((100 * F.col("n") >= percent * F.col("_n0")) & (100 * F.col("_n1") >= percent * F.col("n")) & reach)
        .select("node", F.col("_star").alias("star"))
        .distinct()
    )


def _links_of_blocks(group: pa.Table, percent: int) -> pa.Table:
    """Links between sets and the members of star blocks, at most one for each pair of components that it joins.

    A set's intersection with a member comes from what both share with the hub: the bits
    of the hub's elements that both kept, and the extra elements that both have.
    """
    col = {c: group[c].to_numpy() for c in ("star", "block", "node", "n", "component")}
    member, kept = np.array(group["member"].to_pylist(), bool), np.array(group["kept"].to_pylist(), object)
    extra = np.empty(len(member), object)
    extra[:] = _arrays(group["extra"].combine_chunks())
    order = np.lexsort((col["node"], ~member, col["block"], col["star"]))
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(col["star"][order]) != 0) | (np.diff(col["block"][order]) != 0)))) if len(order) else []
    x, y = [], []
    for lo, hi in zip(edge, [*edge[1:], len(order)]):
        rows = order[lo:hi]
        here, asked = rows[member[rows]], rows[~member[rows]]
        if not len(here) or not len(asked):
            continue
        bits = np.frombuffer(b"".join(kept[here]), np.uint8).reshape(len(here), -1)
        owner = np.repeat(np.arange(len(here)), [len(e) for e in extra[here]])
        more = np.concatenate(list(extra[here]))
        by_value = np.argsort(more, kind="stable")
        more, owner = more[by_value], owner[by_value]
        n, nodes = col["n"][here], col["node"][here]
        _, label = np.unique(col["component"][rows], return_inverse=True)
        label, place = label.astype(np.int64), {r: i for i, r in enumerate(rows.tolist())}
        at = np.array([place[r] for r in here.tolist()])
        for r in asked.tolist():
            own = place[r]
            both = np.bitwise_count(bits & np.frombuffer(kept[r], np.uint8)).sum(axis=1, dtype=np.int64)
            a, b = np.searchsorted(more, extra[r], "left"), np.searchsorted(more, extra[r], "right")
            for i, j in zip(a.tolist(), b.tolist()):
                both[owner[i:j]] += 1
            hit = np.flatnonzero((100 * both >= percent * (n + col["n"][r] - both)) & (label[at] != label[own]))
            while len(hit):
                x.append(int(col["node"][r]))
                y.append(int(nodes[hit[0]]))
                label[label == label[at[hit[0]]]] = label[own]
                hit = hit[label[at[hit]] != label[own]]
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def searches(sets: DataFrame, labels: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """The rows of the search, members of star blocks and the sets searched for in each block, and for how many shards."""
    placed = cut_lineage(stars(sets, labels, known.filter("turn = 0")))
    asked = cut_lineage(candidates(sets, placed, percent))
    related = known.select("x", "y", "n", "kept", "extra").dropDuplicates(["x", "y"])
    hubs = asked.select(F.col("star").alias("x")).distinct().select("x", F.col("x").alias("y"))
    pairs = asked.select(F.col("node").alias("x"), F.col("star").alias("y")).unionByName(hubs)
    related = related.unionByName(measure(pairs.join(related, ["x", "y"], "left_anti"), sets).select("x", "y", "n", "kept", "extra"))
    related = cut_lineage(related)
    wanted = placed.join(asked.select("star").distinct(), "star", "left_semi").select(F.col("node").alias("x"), F.col("star").alias("y"), "component", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    members = related.join(wanted, ["x", "y"]).withColumn("member", F.lit(True))
    sizes = placed.select(F.col("star").alias("y"), "blocks").distinct()
    asked = asked.select(F.col("node").alias("x"), F.col("star").alias("y")).join(placed.select(F.col("node").alias("x"), "component"), "x").join(sizes, "y")
    queries = related.join(asked, ["x", "y"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", F.lit(False))
    rows = members.unionByName(queries.drop("blocks")).select(F.col("y").alias("star"), "block", F.col("x").alias("node"), "n", "component", "kept", "extra", "member")
    return rows, max(1, math.ceil(asked.count() / SHARD_SETS))


def link_rest(sets: DataFrame, labels: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The links that join further components: ``x``, ``y``."""
    rows, shards = searches(sets, labels, known, percent)
    shard = F.pmod(F.xxhash64("star", "block"), F.lit(shards)).cast("int").alias("shard")
    return rows.select(shard, "*").groupBy("shard").applyInArrow(lambda group: _links_of_blocks(group, percent), "x bigint, y bigint")


def link_sets(sets: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """The components of the sets that link at all: ``node``, ``component``."""
    labels, known = None, None
    for turn in range(rounds):
        labelled = sets.withColumn("component", F.col("node")) if labels is None else _labelled(sets, labels)
        starred = cut_lineage(measure(star_pairs(labelled, percent), sets).withColumn("turn", F.lit(turn)))
        known = starred if known is None else known.unionByName(starred)
        found = starred.filter(100 * F.col("both") >= percent * F.col("either")).select("x", "y")
        labels = components(found) if labels is None else extended(labels, found)
    rest = cut_lineage(link_rest(sets, labels, known, percent))
    return extended(labels, rest)


def _labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    return sets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs`` (needing ``doc_id`` and ``text``).

    Two documents link when their shingle sets' intersection is at least ``percent`` hundredths of the union.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = cut_lineage(_set_ids(docs, k))
    own = F.coalesce("set_id", F.lit(""))
    odd = ids.groupBy("doc_id").agg(F.min(own).alias("_a"), F.max(own).alias("_b")).filter("_a <> _b OR doc_id IS NULL AND _b <> ''").select("doc_id")
    return _join_one_set_an_id(docs, ids, k, percent) if odd.isEmpty() else _join_numbered(docs, ids, cut_lineage(odd), k, percent)


def _join_numbered(docs: DataFrame, ids: DataFrame, odd: DataFrame, k: int, percent: int) -> DataFrame:
    """``join`` where the ``odd`` ids have several sets or are null: each of their sets gets a number beyond all ids."""
    lowest, highest = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    room = 1 << 62
    if (highest or 0) >= room and (lowest or 0) <= -room:
        raise ValueError("ids leave no room for numbers beside them")
    number = F.monotonically_increasing_id()
    node = F.lit((highest or 0) + 1) + number if (highest or 0) < room else F.lit(lowest - 1) - number
    is_odd = lambda rows, how: rows.join(odd.select(F.col("doc_id").alias("_odd")), F.col("doc_id").eqNullSafe(F.col("_odd")), how)
    sets = cut_lineage(_set_ids(is_odd(docs, "left_semi"), k, "text").dropDuplicates(["doc_id", "set_id"]).withColumn("node", node))
    numbered = sets.select(F.col("node").alias("doc_id"), "text", "n_shingles", "set_id", "chars")
    plain = is_odd(ids, "left_anti")
    all_docs = is_odd(docs, "left_anti").unionByName(numbered.select("doc_id", "text"))
    joined = _join_one_set_an_id(all_docs, plain.unionByName(numbered.drop("text")), k, percent)
    of = sets.select(F.col("node").alias("doc_id"), F.col("doc_id").alias("_id"), F.col("set_id").alias("_set"), F.lit(True).alias("_odd"))
    joined = cut_lineage(joined.join(of, "doc_id", "left"))

    same = joined.filter("_odd AND _id IS NOT NULL").select("_id", F.col("component_id").alias("x"))
    links = same.join(same.groupBy("_id").agg(F.min("x").alias("y")), "_id").filter("x <> y").select("x", "y").distinct()
    merged = components(links).select(F.col("node").alias("component_id"), F.col("component").alias("_merged"))
    joined = joined.join(merged, "component_id", "left").withColumn("_merged", F.coalesce("_merged", "component_id"))
    labels = joined.groupBy("_merged").agg(F.min(F.when(F.col("_odd"), F.col("_id")).otherwise(F.col("doc_id"))).alias("_label"))
    joined = cut_lineage(joined.join(labels, "_merged"))
    rest = joined.filter("_odd IS NULL").select("doc_id", "n_shingles", F.col("_label").alias("component_id"))
    label = joined.filter("_odd").select("_id", "_set", F.col("_label").alias("component_id"))
    back = is_odd(ids, "left_semi").join(label, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("set_id").eqNullSafe(F.col("_set")))
    return rest.unionByName(back.select("doc_id", "n_shingles", "component_id"))


def _join_one_set_an_id(docs: DataFrame, ids: DataFrame, k: int, percent: int) -> DataFrame:
    """``join`` where no id has two sets and none with a set is null; ``ids`` are those of ``_set_ids``."""
    reps = ids.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    chars, shingles = ids.agg(F.sum("chars"), F.sum("n_shingles")).first()
    blocks = max(1, math.ceil((chars or 0) / BLOCK_CHARS))
    shards = max(1, math.ceil((shingles or 0) / SHARD_SHINGLES))
    sets = cut_lineage(ordered_sets(docs, reps.filter("rep IS NOT NULL"), k, blocks, shards, percent))
    linked = link_sets(sets, percent)
    classes = reps.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    # sets that are none join nothing, wherever they are
    key = F.coalesce("set_id", F.concat(F.lit("none-"), F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("string")))
    return ids.withColumn("set_id", key).join(classes, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
