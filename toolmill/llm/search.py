"""Ranked lexical search with per-term geometric blocking.

Documents are read once into a forward table: number of terms, and of the terms that the
items ask for, how often each occurs. Rows are dealt into shards of about
``POSTINGS`` postings. In a shard, every term's posting list is clustered by document
similarity: its documents go to the nearest of a few of them (pivots), compared by a
random projection of their impacts, and each cluster is cut into blocks of at most
``BLOCK`` documents. A block stores the coordinatewise maximum of its documents' impacts.
Coordinates are terms: the most frequent ones have one each, rarer ones share the rest,
and a maximum is kept in units of ``UNIT``, rounded up, so that a block's summary times
an item's weights is never below the score of any of its documents.

An item takes its terms' blocks by falling bound, scores their documents exactly from
the forward table, and skips a block only if its bound is below the score that is last of
the best ``k`` found by then; equal bounds are still read, as ties go to the lower id.
Shards are searched in rounds of growing size, and each round starts from the last scores of
the rounds before, so that all shards together send few rows beyond the best.

Items are taken in sets of at most ``TERMS`` terms together (one item at least): a set's terms go to every task,
and its documents are read once. Impacts and scores are 64-bit integers throughout.

Defined results: null texts and texts without terms hold no term and are never found;
null and repeated item ids are items of their own, results carry the id as it is; rows that
repeat a doc_id are found each; ties go to the lower id, null last; no items or no rows in,
no rows out. Only ``doc_id``/``text`` and ``item_id``/``text`` are read; bytes that are no UTF-8 are term characters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toolmill.llm.common import map_texts, text_of
from toolmill.operators.ordering import top_per_group
from toolmill.session import materialize

K = 50
BLOCK = 64
POSTINGS = 1 << 20
TERMS = 50_000
OWN, SHARED, UNIT = 448, 64, 4096  # coordinates of frequent terms, of all others; impacts are below 1,000,000
WIDTH = OWN + SHARED
PROJECTION = 32
ROUND_GROWTH = 8
#: Bytes of terms, A-Z lower-cased; all others become blanks.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

FORWARD = "doc_id long, n long, terms array<int>, tf array<int>"
BLOCKS = "shard long, term int, docs array<int>, summary binary"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms, and its counts of the terms in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast({"vocabulary": vocabulary})

    def one(batch: pa.RecordBatch) -> dict:
        number = shared.value["vocabulary"].get
        n, terms, tf = [], [], []
        for text in text_of(batch.column("text")):
            words = terms_of(text)
            known = np.array([i for w in words if (i := number(w)) is not None], np.int32)
            ids, counts = np.unique(known, return_counts=True)
            n.append(len(words))
            terms.append(ids)
            tf.append(counts.astype(np.int32))
        return {"doc_id": batch.column("doc_id"), "n": n, "terms": terms, "tf": tf}

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), one, FORWARD)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and list borders of a list column."""
    array = column.combine_chunks()
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    lengths = np.asarray(pa.compute.list_value_length(array).fill_null(0), np.int64)
    return np.asarray(array.flatten()), np.concatenate([[0], np.cumsum(lengths)])


def impacts(n: np.ndarray, tf: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 100 - 50 + (50 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def coordinates(df: np.ndarray) -> np.ndarray:
    """Coordinate of each term: its own for the most frequent, a shared one for the rest."""
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    return np.where(rank < OWN, rank, OWN + rank % SHARED)


class Shard:
    """A shard's forward rows as arrays: postings of document ``d`` are start[d]…start[d+1].
    Documents are numbered by ``row``, whatever order a shuffle brings them in."""

    def __init__(self, table: pa.Table, documents: int, total: int) -> None:
        table = table.sort_by("row")
        self.doc_id = table["doc_id"].combine_chunks()
        self.terms, self.start = _flat(table["terms"])
        tf, _ = _flat(table["tf"])
        owner = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        self.owner = owner
        n = np.asarray(table["n"].combine_chunks(), np.int64)
        self.impact = impacts(n[owner], tf.astype(np.int64), documents, total)

    def ceilings(self, coordinate: np.ndarray) -> np.ndarray:
        """Per document and coordinate the greatest impact, in units rounded up."""
        out = np.zeros((len(self.start) - 1, WIDTH), np.uint8)
        np.maximum.at(out, (self.owner, coordinate[self.terms]), (-(-self.impact // UNIT)).astype(np.uint8))
        return out

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents (each with a posting at least)."""
        lengths = self.start[docs + 1] - self.start[docs]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.arange(lengths.sum()) + np.repeat(self.start[docs] - first, lengths)
        return np.add.reduceat(weights[self.terms[at]] * self.impact[at], first)


def list_blocks(docs: np.ndarray, impact: np.ndarray, places: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """Blocks of one posting list: documents by their nearest pivot, the strongest of a cluster first."""
    if len(docs) <= block:
        return [docs]
    pivots = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // block)).astype(np.int64)]
    cluster = (places[docs] @ places[pivots].T).argmax(axis=1)
    order = np.lexsort((-impact, cluster))
    docs, cluster = docs[order], cluster[order]
    begin = np.searchsorted(cluster, cluster)  # start of each row's cluster
    inside = np.arange(len(docs)) - begin
    cuts = np.flatnonzero((inside % block == 0))
    return np.split(docs, cuts[1:])


def build_blocks(table: pa.Table, figures: dict) -> pa.Table:
    """The index of one shard: a row per block."""
    shard = Shard(table, figures["documents"], figures["total"])
    ceiling = shard.ceilings(figures["coordinate"])
    direction = np.random.RandomState(7).choice(np.array([-1.0, 1.0], np.float32), (WIDTH, PROJECTION))
    places = ceiling.astype(np.float32) @ direction
    places /= np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-9)
    order = np.argsort(shard.terms, kind="stable")
    terms, docs, strength = shard.terms[order], shard.owner[order], shard.impact[order]
    borders = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
    out: dict[str, list] = {"term": [], "docs": [], "summary": []}
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        for members in list_blocks(docs[a:b], strength[a:b], places):
            out["term"].append(int(terms[a]))
            out["docs"].append(members.astype(np.int32))
            out["summary"].append(ceiling[members].max(axis=0).tobytes())
    number = table["shard"][0].as_py()
    return pa.table({
        "shard": pa.array([number] * len(out["term"]), pa.int64()), "term": pa.array(out["term"], pa.int32()), "docs": pa.array(out["docs"], pa.list_(pa.int32())), "summary": pa.array(out["summary"], pa.binary()),
    })


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score falling, id rising."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search_shard(blocks: pa.Table, table: pa.Table, figures: dict, seen: list | None = None) -> pa.Table:
    """The best documents of one shard for every item. ``seen`` collects (blocks, blocks read) per item."""
    items, k, weights = figures["items"], figures["k"], figures["weights"]
    shard = Shard(table, figures["documents"], figures["total"])
    ids = np.asarray(shard.doc_id.fill_null(np.iinfo(np.int64).max), np.int64)  # null ids last
    block_term = np.asarray(blocks["term"].combine_chunks())
    members, begin = _flat(blocks["docs"])
    summary = np.frombuffer(b"".join(blocks["summary"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    asked = np.zeros((WIDTH, len(items)))
    for i, terms in enumerate(items):
        np.add.at(asked[:, i], figures["coordinate"][terms], weights[terms] * UNIT)
    bounds = np.concatenate([summary[a : a + 2_048].astype(np.float64) @ asked for a in range(0, len(summary), 2_048)] or [np.zeros((0, len(items)))])
    by_term = np.argsort(block_term, kind="stable")
    first = np.searchsorted(block_term[by_term], np.arange(len(weights) + 1))
    found: list[tuple] = []
    for i, terms in enumerate(items):
        mine = np.concatenate([by_term[first[t] : first[t + 1]] for t in terms.tolist()] or [np.zeros(0, np.int64)])
        if not len(mine):
            continue
        mine = mine[np.argsort(-bounds[mine, i], kind="stable")]
        own = np.zeros(len(weights), np.int64)
        own[terms] = weights[terms]
        best, scored = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = np.zeros(len(ids), bool)
        last, at, step = max(1, figures["floors"].get(i, 1)), 0, 4
        while at < len(mine) and bounds[mine[at], i] >= last:
            part = mine[at : at + step]
            part = part[bounds[part, i] >= last]
            docs = np.unique(np.concatenate([members[begin[b] : begin[b + 1]] for b in part]))
            docs = docs[~done[docs]]
            at, step = at + len(part), step * 2
            if not len(docs):
                continue
            done[docs] = True
            score = shard.scores(docs, own)
            keep = score >= last
            best, scored = np.concatenate([best, docs[keep]]), np.concatenate([scored, score[keep]])
            top = _best(scored, ids[best], k)
            best, scored = best[top], scored[top]
            if len(best) == k:
                last = max(last, int(scored[-1]))
        if seen is not None:
            seen.append((len(mine), at))
        found.append((np.full(len(best), i, np.int32), best, scored))
    item, doc, score = (np.concatenate([f[j] for f in found] or [np.zeros(0, np.int64)]) for j in range(3))
    return pa.table({"item": pa.array(item, pa.int32()), "doc_id": shard.doc_id.take(pa.array(doc, pa.int64())), "score": pa.array(score, pa.int64())})


def item_sets(items: DataFrame, terms: int = TERMS):
    """Sets of items (id, distinct terms), each with at most ``terms`` terms together, one item at least."""
    held, size = [], 0
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator(prefetchPartitions=True):
        own = sorted(set(terms_of(row["text"] and bytes(row["text"]))))
        if held and size + len(own) > terms:
            yield held
            held, size = [], 0
        held.append((row["item_id"], own))
        size += len(own)
    if held:
        yield held


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], postings: int = POSTINGS) -> tuple[DataFrame, DataFrame, dict]:
    """(rows, blocks, figures): forward rows with their shard, the block index of all of them
    for the terms of ``vocabulary``, and the corpus figures that scores need."""
    spark = docs.sparkSession
    rows = materialize(forward(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "search-forward")
    held = rows.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
    figures = {"documents": held[0], "total": held[1] or 0, "shards": max(1, -(-(held[2] or 0) // postings))}
    counts = {r["term"]: r["df"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row per asked term
    df = np.array([counts.get(i, 0) for i in range(len(vocabulary))], np.int64)
    figures |= {"df": df, "coordinate": coordinates(df), "weights": np.array([weight(x, held[0]) for x in df.tolist()], np.int64)}
    rows = rows.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(figures["shards"])))
    shared = spark.sparkContext.broadcast(figures)

    def build(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        return build_blocks(table, shared.value)

    blocks = rows.groupBy("shard").applyInArrow(build, BLOCKS)
    return rows, materialize(blocks, "search-blocks"), figures


def search_index(rows: DataFrame, blocks: DataFrame, figures: dict, items: list[np.ndarray], k: int = K) -> DataFrame:
    """(item, doc_id, score, rank) of the k best documents of each item (an array of term numbers)."""
    spark = rows.sparkSession
    found, floors, start, end = None, {}, 0, 1
    while start < figures["shards"]:
        shared = spark.sparkContext.broadcast(figures | {"items": items, "k": k, "floors": floors})

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            import pyarrow.compute  # noqa: F401

            return search_shard(left, right, shared.value)

        part = (F.col("shard") >= start) & (F.col("shard") < end)
        new = blocks.where(part).groupBy("shard").cogroup(rows.where(part).groupBy("shard")).applyInArrow(search, FOUND)
        found = materialize(new if found is None else found.select("item", "doc_id", "score").union(new), "search-found")
        found = top_per_group(found, ["item"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)
        start, end = end, end * ROUND_GROWTH
        if start < figures["shards"]:  # a row per item that has k results
            floors = {r["item"]: r["score"] for r in found.where(F.col("rank") == k).select("item", "score").collect()}
    return found


def search(docs: DataFrame, items: DataFrame, k: int = K, postings: int = POSTINGS, terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark, out = docs.sparkSession, []
    for held in item_sets(items, terms):
        vocabulary: dict[bytes, int] = {}
        numbered = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], np.int64) for _, own in held]
        rows, blocks, figures = build_index(docs, vocabulary, postings)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(held)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = search_index(rows, blocks, figures, numbered, k)
        out.append(best.join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def brute_force(docs: list[tuple[int | None, str | None]], items: list[tuple], k: int = K) -> list[tuple]:
    """Reference result on a small list, every document for every item; for tests."""
    import re
    from collections import Counter

    def split(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    held = [(doc_id, Counter(split(text))) for doc_id, text in docs]
    documents, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        rows = []
        for doc_id, counts in held:
            score = 0
            for t in set(split(text)) & counts.keys():
                m = 100 - 50 + 50 * sum(counts.values()) * documents // total
                score += weight(df[t], documents) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                rows.append((doc_id, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0]))
        out += [(item_id, rank + 1, doc_id, score) for rank, (doc_id, score) in enumerate(rows[:k])]
    return out
