"""Exact duplicates through a minimal perfect hash over historical digests.

History is reduced to distinct SHA-256 digests of the normalised text, dealt into
shards of bounded size. Each shard is one index row: a levelled bit-vector hash that
maps its n digests onto slots 0…n-1 without gaps, and per slot the full digest, the
winner (smallest doc_id) and the number of copies. Arrivals are reduced to distinct
digests too, dealt the same way, looked up and accepted only if all 32 bytes of the
slot agree; what is not in history forms groups of its own. Hot texts never meet in
one task: both sides are aggregated before the shuffle, and the last join (rows back
to their group) is a plain equi-join that adaptive execution splits.

Defined results: a null text counts as empty; empty texts are equal to each other;
null ids lose to any id, and a group with null ids only has a null ``keep_id``; rows
that repeat a doc_id share its fate; no rows in, no rows out. Only ``doc_id`` and
``text`` are read; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.llm.common import BLANK_RUN, free, shards_for
from toolmill.session import materialize

ROWS_PER_SHARD = 20_000
INDEX = "shard bigint, levels array<binary>, slots binary, winners array<bigint>, copies array<bigint>"  # a null winner: no row with an id
GROUPS = "digest binary, keep_id bigint, group_size bigint"
MAX_LEVELS = 200


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte digest of every document's normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each digest on one level, from two of its four 64-bit words."""
    mixed = words[:, level % 4] + np.uint64(2 * level + 1) * words[:, (level + 1) % 4]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(size)).astype(np.int64)


def _words(digest: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digest).view("<u8").reshape(-1, 4)


def build_levels(digest: np.ndarray) -> list[np.ndarray]:
    """Bit vectors of the hash: a key stays on the first level where no other remaining key shares its bit."""
    words, levels = _words(digest), []
    while len(words):
        if len(levels) == MAX_LEVELS:
            raise ValueError("digests are not distinct")
        size = max(64, len(words) + len(words) // 2)
        at = _positions(words, len(levels), size)
        once = np.bincount(at, minlength=size) == 1
        levels.append(once)
        words = words[~once[at]]
    return levels


def slots_of(digest: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of every digest (an arbitrary one, or -1, for digests outside the index)."""
    words, found = _words(digest), np.full(len(digest), -1, np.int64)
    open_rows, base = np.arange(len(digest)), 0
    for level, bits in enumerate(levels):
        at = _positions(words[open_rows], level, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        found[open_rows[hit]] = base + rank[at[hit]]
        base += int(bits.sum())
        open_rows = open_rows[~hit]
    return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build_shard(table: pa.Table) -> pa.Table:
    digest = _matrix(table["digest"])
    levels = build_levels(digest)
    slot = slots_of(digest, levels)
    order = np.argsort(slot)
    packed = [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in levels]
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int64()), "levels": pa.array([packed], pa.list_(pa.binary())),
        "slots": pa.array([digest[order].tobytes()], pa.binary()),
        "winners": pa.array([table["first_id"].take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
        "copies": pa.array([table["copies"].to_numpy()[order]], pa.list_(pa.int64())),
    })


def _unpack(level: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(level[8:], np.uint8))[: int.from_bytes(level[:8], "little")].astype(bool)


def _ids(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 for null) and where there is one, as arrays that may be changed."""
    return np.array(column.fill_null(0), np.int64), np.array(column.is_valid(), bool)


def _look_up(index: pa.Table, arrivals: pa.Table) -> pa.Table:
    held = np.zeros((0, 32), np.uint8)
    winner, copies = pa.array([], pa.int64()), np.zeros(0, np.int64)
    levels: list[np.ndarray] = []
    if index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        levels = [_unpack(x) for x in row["levels"]]
        held = np.frombuffer(row["slots"], np.uint8).reshape(-1, 32)
        winner, copies = pa.array(row["winners"], pa.int64()), np.array(row["copies"], np.int64)
    new = _matrix(arrivals["digest"])
    keep, named = _ids(winner)
    first, has_id = _ids(arrivals["first_id"])
    count = arrivals["copies"].to_numpy().astype(np.int64)
    slot = slots_of(new, levels)
    member = slot >= 0
    member[member] = (held[slot[member]] == new[member]).all(axis=1)  # the byte check
    old, new_id = slot[member], first[member]
    lower = has_id[member] & (~named[old] | (new_id < keep[old]))
    keep[old[lower]] = new_id[lower]
    named[old] |= has_id[member]
    copies[slot[member]] += count[member]
    out = np.concatenate([held, new[~member]])
    ids = pa.array(np.concatenate([keep, first[~member]]), pa.int64(), mask=~np.concatenate([named, has_id[~member]]))
    return pa.table({
        "digest": pa.array([x.tobytes() for x in out], pa.binary()), "keep_id": ids,
        "group_size": np.concatenate([copies, count[~member]]),
    })


def _distinct(digested: DataFrame, shards: int) -> DataFrame:
    return (
        digested.groupBy("digest")
        .agg(F.min("doc_id").cast("long").alias("first_id"), F.count("*").alias("copies"))
        .withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard of the distinct digests of ``history`` (doc_id, digest)."""
    return _distinct(history, shards).groupBy("shard").applyInArrow(_build_shard, INDEX)


def look_up(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """Every distinct digest of history and ``arrivals`` with its winner and size."""
    return index.groupBy("shard").cogroup(_distinct(arrivals, shards).groupBy("shard")).applyInArrow(_look_up, GROUPS)


def duplicate_groups(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of all rows, and the groups: the ids up to the middle of the id
    range stand for history, the rest (null ids too) for arrivals."""
    digested = materialize(digests(docs), "digests")
    rows, low, high = digested.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    shards = shards_for(rows, rows_per_shard)
    old = F.coalesce(F.col("doc_id") <= F.lit(None if low is None else (low + high) // 2).cast("long"), F.lit(False))
    index = materialize(build_index(digested.where(old), shards), "digest-index")
    return digested, look_up(index, digested.where(~old), shards)


def mark(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per document: which row of its group stays."""
    digested, groups = duplicate_groups(docs, rows_per_shard)
    return digested.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are."""
    _, groups = duplicate_groups(docs, rows_per_shard)
    keep, winner, digest = free(docs, "_keep", "_winner", "_digest")
    winners = groups.select(F.col("keep_id").alias(keep), F.col("digest").alias(winner)).hint("shuffle_hash")
    marked = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    stays = marked.join(winners, F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(digest) == F.col(winner)), "left_semi")
    return stays.dropDuplicates(["doc_id", digest]).drop(digest)


def brute_force(rows: Iterator[tuple[int | None, str | None]]) -> list[tuple]:
    """Reference result on a small list, for tests."""
    import hashlib
    import re

    named = [(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for i, t in rows]
    members: dict[str, list] = {}
    for i, d in named:
        members.setdefault(d, []).append(i)
    keep = {d: min((i for i in ids if i is not None), default=None) for d, ids in members.items()}
    return [(i, keep[d], len(members[d]), i == keep[d], d) for i, d in named]
