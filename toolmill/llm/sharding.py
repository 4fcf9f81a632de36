"""Shards of near equal size by sampled splitters, in DataFrame operations only.

Every document gets an ordering key: a hash of its text, then of its id, then its row
number, so that equal texts lie next to each other and no two rows share a key. Key
samples are drawn with probability by size (a row's own share of all rows counts as
much, so that many tiny documents are seen too), quantiles of the samples' weights are
the splitters, and records are range-partitioned between them. A range that holds more
rows than ``rows_per_range`` is subdivided by samples of its own, until none is overfull:
a text that a third of all rows repeat is many ranges. Sizes are then summed exactly,
range by range in key order, and a shard is the stretch of the order that holds its
equal part of all bytes: sizes differ by one document. A group of equal texts that a
border would cut stays whole, in the shard where it starts, if it holds at most
``whole`` of a shard.

Only hashes, sizes and numbers are shuffled, never texts, and they are read from a table in the
shared folder, so a lost executor draws the same samples again. What the driver holds is
bounded by the shard count; samples are about ``FAN`` x ``DRAWS`` per range.

Defined results: a null text has no bytes and the checksum of the empty text, and is grouped with
it; rows that repeat an id, or lack one, are rows of their own; where two rows agree in
text and id, which of them lies on which side of a border is open, but their results
are the same set; fewer documents than shards leave shards empty; no rows in, no rows out.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolmill.llm.common import free
from toolmill.session import materialize

SHARDS = 24
OVERHEAD = 8  # bytes of a record besides its text
FAN, DRAWS = 128, 24  # parts of a range, samples for each
ROWS_PER_RANGE = 200_000
WHOLE = 0.02
KEY = ("h", "k", "row")


def _measures() -> dict[str, Column]:
    """Size, checksum and the two hashes of the ordering key, from doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + OVERHEAD).cast("long"), F.crc32(text.cast("binary"))
    return {"size": size, "text_crc32": crc, "h": F.xxhash64(text), "k": F.xxhash64(F.col("doc_id").cast("long"), crc, size)}


def keyed(docs: DataFrame) -> DataFrame:
    """One row of numbers per document: id, size, checksum and ordering key."""
    return docs.select(F.col("doc_id").cast("long"), *[c.alias(n) for n, c in _measures().items()], F.monotonically_increasing_id().alias("row"))


def _key() -> Column:
    return F.struct(*KEY)


def _splitters(rows: DataFrame, ranges: DataFrame, fan: int, draws: int, level: int) -> DataFrame:
    """(range, splits) of each range: quantile borders of size-weighted samples.

    A row's weight is its share of the range's bytes plus its share of its rows; it is
    drawn with probability weight x ``fan`` x ``draws`` / 2, at most 1, by a hash of its key."""
    weighed = rows.join(ranges, "range").withColumn("w", F.col("size") / F.col("bytes") + 1 / F.col("n"))
    chance = F.least(F.lit(1.0), F.col("w") * fan * draws / 2)
    drawn = weighed.withColumn("p", chance).where(F.pmod(F.xxhash64(F.lit(level), *KEY), F.lit(1 << 40)) < F.col("p") * (1 << 40))
    samples = drawn.select("range", _key().alias("key"), (F.col("w") / F.col("p")).alias("w"))
    by_range = Window.partitionBy("range")
    upto = by_range.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.floor(F.sum("w").over(upto) * fan / F.sum("w").over(by_range)).cast("int")
    borders = samples.withColumn("part", F.least(part, F.lit(fan - 1))).groupBy("range", "part").agg(F.min("key").alias("key")).where("part > 0")
    return borders.groupBy("range").agg(F.array_sort(F.collect_list("key")).alias("splits"))


def ranged(rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE, fan: int = FAN, draws: int = DRAWS) -> DataFrame:
    """``rows`` with the number of their range, in key order."""
    rows, level = materialize(rows.withColumn("range", F.lit(0).cast("long")), "shard-keys"), 0
    while True:
        ranges = rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        over = ranges.where(F.col("n") > (rows_per_range if level else 0))
        if level and over.isEmpty():
            return rows
        splits = materialize(_splitters(rows, over, fan, draws, level), "shard-splitters")
        below = F.size(F.filter("splits", lambda s: s <= _key()))  # -1 for a range that stays
        rows = rows.join(splits, "range", "left").withColumn("range", F.col("range") * fan + F.greatest(F.lit(0), F.coalesce(below, F.lit(0)))).drop("splits")
        rows, level = materialize(rows, "shard-ranges"), level + 1


def _offsets(ranged_rows: DataFrame) -> DataFrame:
    """Bytes and rows before each range; the window runs over a row per range."""
    sums = ranged_rows.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("b", "r")], F.sum("b").over(Window.partitionBy()).alias("total"))


def _whole_groups(placed: DataFrame, shards: int, whole: float) -> dict[int, int]:
    """Text hashes of groups that borders cut and that are small enough to stay whole, with the
    shard they start in: at most one per border."""
    edges = placed.groupBy("shard").agg(F.min_by("h", "at").alias("first"), F.max_by("h", "at").alias("last"), F.first("total").alias("total")).orderBy("shard").collect()  # a row per shard
    cut = [a["last"] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]]
    if not cut:
        return {}
    groups = placed.where(F.col("h").isin(cut)).groupBy("h").agg(F.sum("size").alias("held"), F.min("shard").alias("home")).collect()
    return {g["h"]: g["home"] for g in groups if g["held"] * shards <= edges[0]["total"] * whole}


def place(docs: DataFrame, shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE, whole: float = WHOLE, fan: int = FAN, draws: int = DRAWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, ordering key (h, k, row), its shard
    and its slot in the shard, in key order."""
    rows = ranged(keyed(docs), rows_per_range, fan, draws)
    inside = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("b0") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    at = F.col("r0") + F.coalesce(F.count("size").over(inside), F.lit(0))
    placed = rows.join(_offsets(rows), "range").withColumn("start", start).withColumn("at", at)
    middle = F.col("start") + F.expr("size div 2")  # a document on a border goes where most of it lies
    placed = materialize(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(float(shards)) / F.col("total"))).cast("int")), "shard-places")
    moved, stay = placed, _whole_groups(placed, shards, whole)
    for h, home in stay.items():
        moved = moved.withColumn("shard", F.when(F.col("h") == h, home).otherwise(F.col("shard")))
    first = moved.groupBy("shard").agg(F.min("at").alias("at0"))
    return moved.join(first, "shard").select("doc_id", "size", "text_crc32", *KEY, "shard", (F.col("at") - F.col("at0")).alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The placement as a table: law ``bytes``, so no grown shard."""
    return place(docs, shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1, **options) -> str:
    """Writes ``docs``, all columns as they are, as one folder per shard with about ``files``
    files, and returns the name of the folders' column. Rows find their shard by the borders'
    keys (two per shard); rows that agree in text and id with a border are dealt over
    the shards that hold that key."""
    (name,) = free(docs, "shard")
    held = place(docs, shards, **options).groupBy("shard").agg(F.min(F.struct("h", "k")).alias("low"), F.max(F.struct("h", "k")).alias("high")).orderBy("shard").collect()
    key, row = F.struct(*[c for n, c in _measures().items() if n in KEY]), F.monotonically_increasing_id()
    border = lambda r: F.struct(F.lit(r["h"]).alias("h"), F.lit(r["k"]).alias("k"))
    fitting = F.array_compact(F.array(*[F.when((border(r["low"]) <= key) & (key <= border(r["high"])), r["shard"]) for r in held]))
    dealt = F.get(fitting, F.pmod(row, F.size(fitting)).cast("int")).cast("int") if held else F.lit(0)
    docs.withColumn(name, dealt).repartition(shards * files, name, F.pmod(F.xxhash64(row), F.lit(files))).write.partitionBy(name).parquet(path)
    return name
