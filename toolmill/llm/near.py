"""Near duplicates by MinHash with tensored banding and full verification.

Sets are the distinct 4-word shingles of a text as 64-bit hashes. Two collections of
``SIDE`` short signatures (two minhashes each) are computed per set; every pair of one
signature from each collection is the key of one table, so ``SIDE``² tables of four
minhashes cost only 4 x ``SIDE`` minhash computations. A link with similarity 0.8 is in no
common bucket with a probability under 6 in 10,000, one of 0.9 under 2 in a million.

Equal sets are one class first; only class representatives go on. In a bucket, members
are compared with its lowest member. Where more than one component is left in a bucket,
classes that met in such comparisons form groups, and a group's pairs are found by
their differences from what most of its sets hold (``_group_links``, exact): copies of one
text that are too far apart to be linked share few of these, so they don't meet. Classes of
buckets that still hold two groups meet in their rarest shingles (``_rest_pairs``, exact): no
bucket is listed pair by pair or capped, and a group of copies costs one comparison per
member. Pairs are dropped unseen only if their sizes or what they can share rule a link out, or
if fewer than ``AGREE`` of all 32 minhashes agree (a link is lost so with probability 1e-5).
What is left is decided by exact set intersections. Components come from contraction
by random order, each step a few plain aggregations and joins.

Defined results: texts with under four words are one shingle of all their words; null
texts and texts without words have an empty set, are kept and linked with nothing; rows
that repeat a doc_id share its fate; a component without any id has a null
``component_id``; no rows in, no rows out. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolmill.llm.common import BLANKS, free, map_texts, text_of
from toolmill.session import materialize

SIDE = 8
AGREE = 14
LINK = (80, 100)  # least share of the union
WIDTH = 4
MULTIPLIER, INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
SIGNATURES = "doc_id long, n_shingles long, s1 long, s2 long, u array<long>, v array<long>, sketch array<short>"

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_random = np.random.RandomState(20_011)  # the same functions in every task
_XOR, _MUL = (_random.randint(0, 1 << 32, (2, 4 * SIDE), dtype=np.uint64) << np.uint64(32)) | _random.randint(0, 1 << 32, (2, 4 * SIDE), dtype=np.uint64)
_MUL |= np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, all texts hashed together: words by
    differences of one running polynomial, shingles from four word hashes."""
    joined = np.frombuffer(b"\n".join([t or b"" for t in texts]).lower() + b"\n", np.uint8)  # of bytes: lowers A-Z only
    blank = _BLANK[joined]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    running = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(MULTIPLIER, len(joined)), out=running[1:])
    word = _mix((running[ends] - running[starts]) * _powers(INVERSE, len(joined))[starts])
    del running
    chain = word[: max(0, len(word) - WIDTH + 1)].copy()
    for k in range(1, WIDTH):
        chain = _mix(chain * np.uint64(MULTIPLIER) + word[k : len(word) - WIDTH + 1 + k])
    begin = np.cumsum([0, *[len(t or b"") + 1 for t in texts]])
    first = np.searchsorted(starts, begin)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= WIDTH:
            out.append(np.unique(chain[a : b - WIDTH + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for k in range(a, b):
                short = _mix(short * np.uint64(MULTIPLIER) + word[k])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(4 * SIDE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 20_000):
        least = np.minimum(least, ((hashes[i : i + 20_000, None] ^ _XOR) * _MUL).min(axis=0))
    return least


def signature_pairs(least: np.ndarray) -> np.ndarray:
    """Two minhashes each: the first ``SIDE`` are one collection, the rest the other."""
    return _mix(_mix(least[0::2]) * np.uint64(MULTIPLIER) + least[1::2]).view(np.int64)


def _identity(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    first, second = _mix(hashes + np.uint64(0x51)).sum(dtype=np.uint64), _mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set size, the set's name, both collections of signatures, and 16 bits of each minhash."""

    def one(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_shingles", "s1", "s2", "u", "v", "sketch")}
        for hashes in shingle_sets(text_of(batch.column("text"))):
            least = minhashes(hashes)
            pairs = signature_pairs(least)
            s1, s2 = _identity(hashes)
            for name, value in (("n_shingles", len(hashes)), ("s1", s1), ("s2", s2), ("u", pairs[:SIDE]), ("v", pairs[SIDE:]), ("sketch", (least >> np.uint64(48)).astype(np.uint16).view(np.int16))):
                out[name].append(value)
        return out | {"doc_id": batch.column("doc_id")}

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), one, SIGNATURES)


def full_sets(docs: DataFrame) -> DataFrame:
    """The name of each document's set and its shingle hashes."""

    def one(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(text_of(batch.column("text")))
        names = [_identity(h) for h in sets]
        return {"s1": [n[0] for n in names], "s2": [n[1] for n in names], "hashes": [h.view(np.int64) for h in sets]}

    return map_texts(docs.select("text"), one, "s1 long, s2 long, hashes array<long>")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); one label per component. Each
    round, every node moves to the neighbour (or itself) that is first in a random order
    and edges follow; about a constant factor of nodes is left each time."""
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    both = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a"))
        near = near.union(near.select("a", F.col("a").alias("b")))
        moves = materialize(near.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("to")), f"{name}-moves")
        one, two = moves.select("a", F.col("to").alias("_a")), moves.select(F.col("a").alias("b"), F.col("to").alias("_b"))
        moved = edges.join(one, "a").join(two, "b").where("_a <> _b")
        edges = materialize(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), f"{name}-edges")
        both = both.join(moves, both["label"] == moves["a"], "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(both, f"{name}-labels")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both sets, shared): exact comparison of full sets."""
    left, right = sets.withColumnRenamed("cls", "a"), sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hashes_b"))
    return pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("hashes", "hashes_b")))


def _is_link() -> Column:
    return LINK[1] * F.col("shared") >= LINK[0] * (F.size("hashes") + F.size("hashes_b") - F.col("shared"))


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each class (cls, grp): what its set and its group's common set have alone
    (``only``), and ``weight``, 5 for each element it lacks and 4 for each it adds.
    Common is what over half of a group's sets hold: at most twice their mean size."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    held = members.join(sizes, "grp").join(sets, "cls")
    counts = held.select("grp", "members", F.explode("hashes").alias("h")).groupBy("grp", "members", "h").agg(F.count("*").alias("n"))
    common = counts.where("2 * n > members").groupBy("grp").agg(F.collect_list("h").alias("common"))
    found = held.join(common, "grp", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    found = found.withColumn("lacks", F.array_except("common", "hashes")).withColumn("adds", F.array_except("hashes", "common"))
    weight = (5 * F.size("lacks") + 4 * F.size("adds")).cast("long")
    return found.select("grp", "cls", F.size("common").cast("long").alias("n_common"), weight.alias("weight"), F.concat("lacks", "adds").alias("only"))


def _group_links(apart: DataFrame, heads: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, pairs left to compare) inside groups; no other pair of a group can matter.

    Two sets that share ``c`` differences from the common set C are linked if and only if
    9 c >= weight + weight' - |C|. The lightest set is thus linked with every set whose weight
    allows it without any shared difference (``inner`` ones). All other pairs need a shared
    difference, and each side knows a least number: 5 c >= weight - |C| for any
    partner, 9 c > weight - lightest for an outer partner. So such pairs meet in the rarest of
    their differences, all but that number less one (prefix filter). Only differences that
    another set has can be shared: from the place where two sets first meet, the shorter
    rest of such differences (``left``) bounds c, which rules out copies with changes of their own."""
    lightest = apart.groupBy("grp").agg(F.min(F.struct("weight", "cls")).alias("l")).select("grp", F.col("l.weight").alias("least"), F.col("l.cls").alias("star"))
    apart = apart.join(lightest, "grp").withColumn("free", F.col("weight") + F.col("least") <= F.col("n_common"))
    links = apart.where("free AND cls <> star").select(F.col("star").alias("a"), F.col("cls").alias("b"))
    outer = ~F.col("free") & (F.col("cls") != F.col("star"))
    any_partner = F.greatest(F.lit(1), F.ceil((F.col("weight") - F.col("n_common")) / 5))
    outer_partner = F.greatest(any_partner, F.floor((F.col("weight") - F.col("least")) / 9) + 1)
    held = F.size("only")
    info = apart.select("grp", "cls", "weight", "n_common", outer.alias("outer"), held.alias("held"), (held - outer_partner + 1).alias("near"), F.when(outer, held - any_partner + 1).otherwise(held - outer_partner + 1).alias("far"))
    listed = apart.select("grp", "cls", F.explode("only").alias("h"))
    often = listed.groupBy("grp", "h").agg(F.count("*").alias("n")).where("n > 1")
    ordered = listed.join(often, ["grp", "h"]).groupBy("grp", "cls").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("order"))
    # differences that nobody shares come first in the order and meet no one
    placed = info.join(ordered, ["grp", "cls"]).withColumn("alone", F.col("held") - F.size("order"))
    placed = placed.where(5 * F.size("order") >= F.col("weight") - F.col("n_common"))
    entries = placed.select("grp", "cls", "weight", "n_common", "outer", "near", "alone", F.size("order").alias("size"), F.posexplode(F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("far") - F.col("alone")).cast("int"))).alias("i", "o"))
    entries = entries.select("grp", "cls", "weight", "n_common", "outer", F.col("o.h").alias("h"), (F.col("size") - F.col("i")).alias("left"), (F.col("alone") + F.col("i") < F.col("near")).alias("near"))
    entries = materialize(entries.join(_known(heads, labels), "cls"), "near-entries")
    hubs = entries.select("grp", "h", *[F.col(c).alias(f"hub_{c}") for c in ("outer", "near", "weight", "left", "sketch", "label")], F.col("n_shingles").alias("hub_n"), F.col("cls").alias("hub"))
    both = F.col("near") & F.col("hub_near") & (F.col("cls") < F.col("hub"))
    enough = 9 * F.least("left", "hub_left") >= F.col("weight") + F.col("hub_weight") - F.col("n_common")
    met = entries.where("outer").join(hubs, (entries["grp"] == hubs["grp"]) & (entries["h"] == hubs["h"]) & enough & (~F.col("hub_outer") | both) & (F.col("label") != F.col("hub_label")) & _alike())
    return links, met.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()


def _known(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, sketch and present component of each class."""
    return heads.select("cls", "n_shingles", "sketch").join(labels, F.col("cls") == F.col("node"), "left").select("cls", "n_shingles", "sketch", F.coalesce("label", "cls").alias("label"))


def _rest_pairs(rest: DataFrame, heads: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ``rest`` (cls, grp) in two groups and two components that may be linked.

    Linked sets share at least four fifths of either, so they meet in the rarest fifth of
    their shingles (and one more), and from there both have 4/9 of the sum of their sizes left
    that other groups hold too. What no other group holds comes first and meets no one. Counts are
    looked up once for a group, not for each of its sets: a set is what over half of its
    group holds (``common``), less what it ``lacks``, and what it ``adds``."""
    sizes = rest.groupBy("grp").agg(F.count("*").alias("members"))
    held = rest.join(sizes, "grp").join(sets, "cls")
    listed = held.select("grp", "members", F.explode("hashes").alias("h"))
    counts = materialize(listed.groupBy("grp", "members", "h").agg(F.count("*").alias("here")), "near-counts")
    often = counts.groupBy("h").agg(F.sum("here").alias("n"), F.count("*").alias("groups")).where("groups > 1").select("h", "n")
    shared = materialize(counts.join(often, "h"), "near-shared")
    common = shared.where("2 * here > members").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("common"))
    common = materialize(common, "near-common")
    no_counts = F.array().cast("array<struct<n:bigint,h:bigint>>")
    apart = held.join(common, "grp", "left").withColumn("_common", F.coalesce(F.col("common.h"), F.array().cast("array<bigint>")))
    apart = materialize(apart.select("cls", "grp", F.array_except("_common", "hashes").alias("lacks"), F.array_except("hashes", "_common").alias("adds")), "near-rest-apart")
    added = apart.select("cls", "grp", F.explode("adds").alias("h")).join(shared, ["grp", "h"])
    added = added.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("added"))
    placed = apart.select("cls", "grp", "lacks").join(common, "grp", "left").join(added, "cls", "left").join(_known(heads, labels), "cls")
    placed = placed.withColumn("common", F.coalesce("common", no_counts)).withColumn("added", F.coalesce("added", no_counts))
    placed = placed.withColumn("size", F.size("common") - F.size("lacks") + F.size("added"))
    need = F.ceil(LINK[0] * F.col("n_shingles") / LINK[1])
    placed = placed.withColumn("depth", F.greatest(F.lit(0), F.col("size") - need + 1).cast("int"))
    kept = F.filter(F.slice("common", F.lit(1), F.col("depth") + F.size("lacks")), lambda o: ~F.array_contains("lacks", o["h"]))
    first = F.slice(F.array_sort(F.concat(kept, F.slice("added", F.lit(1), F.col("depth")))), F.lit(1), F.col("depth"))
    entries = placed.where("depth > 0").select("cls", "grp", "n_shingles", "sketch", "label", "size", F.posexplode(first).alias("i", "o"))
    entries = materialize(entries.select("cls", "grp", "n_shingles", "sketch", "label", F.col("o.h").alias("h"), (F.col("size") - F.col("i")).alias("left")), "near-rest")
    hubs = entries.select("h", *[F.col(c).alias(f"hub_{c}") for c in ("grp", "sketch", "label", "left")], F.col("n_shingles").alias("hub_n"), F.col("cls").alias("hub"))
    enough = (LINK[0] + LINK[1]) * F.least("left", "hub_left") >= LINK[0] * (F.col("n_shingles") + F.col("hub_n"))
    apart = (F.col("label") != F.col("hub_label")) & (F.col("grp") != F.col("hub_grp"))
    met = entries.join(hubs, (entries["h"] == hubs["h"]) & (F.col("cls") > F.col("hub")) & enough & apart & _alike())
    return met.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()


def _alike() -> Column:
    """Sizes and minhashes of a class and a hub allow a link."""
    agree = F.aggregate(F.zip_with("sketch", "hub_sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    return (LINK[1] * F.least("n_shingles", "hub_n") >= LINK[0] * F.greatest("n_shingles", "hub_n")) & (agree >= AGREE)


def _firsts(buckets: DataFrame) -> DataFrame:
    """The lowest member of each bucket, its columns as hub's."""
    ranked = buckets.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("cls"))).where("rank = 1")
    return ranked.select("key", F.col("cls").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sketch").alias("hub_sketch"))


def _still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that have pairs beyond their first member and more than one component, and more than one group if groups are given."""
    named = buckets.join(labels, buckets["cls"] == labels["node"], "left").withColumn("label", F.coalesce("label", "cls"))
    marks = [c for c in ("label", "grp") if c in named.columns]
    still = named.groupBy("key").agg(F.count("*").alias("members"), *[f(c).alias(f"{n}_{c}") for c in marks for n, f in (("least", F.min), ("most", F.max))])
    for c in marks:
        still = still.where(F.col(f"least_{c}") < F.col(f"most_{c}"))
    return buckets.join(still.where(F.col("members") > 2).select("key"), "key", "left_semi")


def link_classes(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, labels): the class of each distinct non-empty set, and the label of every class that has links."""
    classes = materialize(signed.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("row").alias("cls"), F.min("doc_id").alias("low_id")), "near-classes")
    heads = materialize(signed.join(classes.select("cls"), F.col("row") == F.col("cls"), "left_semi").select(F.col("row").alias("cls"), "n_shingles", "u", "v", "sketch"), "near-heads")
    tables = F.flatten(F.transform("u", lambda x, i: F.transform("v", lambda y, j: F.xxhash64(i, j, x, y))))
    keyed = heads.select("cls", F.explode(tables).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    buckets = keyed.join(shared, "key").join(heads.select("cls", "n_shingles", "sketch"), "cls")
    buckets = materialize(buckets.select("key", "cls", "n_shingles", "sketch"), "near-buckets")
    # full sets of the classes in some shared bucket, from any document of the class
    wanted = buckets.select("cls").distinct().join(classes, "cls")
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("low_id").alias("_id")).hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = full_sets(texts).join(wanted.select("s1", "s2", "cls"), ["s1", "s2"]).dropDuplicates(["cls"]).select("cls", "hashes")
    sets = materialize(sets, "near-sets")

    # every member with the first of its bucket
    hubs = _firsts(buckets)
    met = buckets.join(hubs, (buckets["key"] == hubs["key"]) & (F.col("cls") > F.col("hub")) & _alike())
    known = materialize(_compared(met.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), sets).select("a", "b", _is_link().alias("linked")), "near-first")
    links = known.where("linked").select("a", "b")
    labels = components(links)
    open_buckets = materialize(_still_open(buckets, labels), "near-open")
    # classes compared with one hub, or with hubs that were, are a group; inside it, differences from what it has in common
    members = open_buckets.select("cls").distinct()
    groups = components(known.join(members, F.col("b") == F.col("cls"), "left_semi"), "near-groups")
    members = materialize(members.join(groups, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("label", "cls").alias("grp")), "near-members")
    free_links, pairs = _group_links(materialize(_differences(members, sets), "near-apart"), heads, labels)
    links = links.union(materialize(free_links.union(_compared(pairs, sets).where(_is_link()).select("a", "b")), "near-links"))
    labels = components(links)
    # buckets that still hold two groups
    rest = _still_open(open_buckets.join(members, "cls"), labels).select("cls", "grp").distinct()
    pairs = _rest_pairs(materialize(rest, "near-open"), heads, labels, sets)
    found = materialize(_compared(pairs, sets).where(_is_link()).select("a", "b"), "near-links")
    if not found.isEmpty():
        labels = components(links.union(found))
    return classes, labels


def mark(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = materialize(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    classes, labels = link_classes(docs, signed)
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select("s1", "s2", "low_id", F.coalesce("label", "cls").alias("label"))
    lowest = named.groupBy("label").agg(F.min("low_id").alias("component_id"))
    placed = named.join(lowest, "label").select("s1", "s2", "component_id")
    rows = signed.select("doc_id", "n_shingles", "s1", "s2")
    full = rows.where("n_shingles > 0").join(placed, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all columns as they are."""
    (name,) = free(docs, "_kept")
    kept = mark(docs).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """Reference result on a small list, on the words themselves; for tests."""
    import re

    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and LINK[1] * common >= LINK[0] * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    low_id: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        low_id[root(i)] = min(low_id.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), low_id[root(i)], low_id[root(i)] == doc_id) for i, (doc_id, _) in enumerate(rows)]
