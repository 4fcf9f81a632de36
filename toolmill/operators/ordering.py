"""Positions, first/last rows, batches and ordered texts that hold when one key
owns a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAGE_CHARS = 1 << 20
ROWS_PER_RANGE = 1 << 20
RANGES = 1_024  # the most


def _listed(values: list, of: str) -> Column:
    """A constant array, made of one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{of}>")


def range_splits(df: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> list[int]:
    """Borders that cut the values of ``order`` into parts of about ``rows_per_range`` rows (or a
    ``RANGES``-th of all, if that is more): quantiles of a mergeable sketch over that one column."""
    shares = [i / RANGES for i in range(1, RANGES)]
    rows, found = df.select(F.count(order), F.percentile_approx(order, _listed(shares, "double"), 10 * RANGES)).first()
    ranges = min(RANGES, -(-rows // rows_per_range))
    return sorted({found[i * RANGES // ranges - 1] for i in range(1, ranges)})


def range_of(value: Column, splits: list[int]) -> Column:
    """Number of borders at or below ``value``, by halving: ten comparisons for a thousand borders."""
    if not splits:
        return F.lit(0)
    borders = _listed(splits, "bigint")
    steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
    return F.aggregate(_listed(steps, "int"), F.lit(0), lambda i, step: i + F.when(value >= F.get(borders, i + step - 1), step).otherwise(0))


def _cut(df: DataFrame, order: str, splits: list[int]) -> DataFrame:
    """``df`` with ``_span``, the range of its order, and ``_tie``, a digest of rows without
    an order, which come last and are cut into as many parts by that digest."""
    values = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    tie = F.when(F.col(order).isNull(), F.xxhash64(*values))
    ranged = df.withColumn("_tie", tie)
    return ranged.withColumn("_span", F.when(F.col(order).isNotNull(), range_of(F.col(order), splits)).otherwise(len(splits) + 1 + F.pmod("_tie", F.lit(len(splits) + 1))).cast("long"))


def number_rows(df: DataFrame, keys: list[str], order: str, out: str = "pos0", total: str | None = None, rows_per_range: int = ROWS_PER_RANGE, values: DataFrame | None = None) -> DataFrame:
    """Zero-based position of each row inside its key, by a unique integer column. The ranges'
    borders are taken from ``values``, if a table is given that has the column and costs less to read.

    A plain window would sort a whole key in one task. Here all rows are cut into
    ranges of ``order`` with about equally many rows, whatever gaps its values have: rows are
    numbered inside their key's part of a range, and that part's offset comes from
    pre-aggregated counts. Null is a key like any other; rows without an order come last in
    their key, by a digest of the row.
    """
    cut = _cut(df, order, range_splits(values or df, order, rows_per_range))
    counts = cut.groupBy(*keys, "_span").agg(F.count("*").alias("_rows"))
    by_key = W.partitionBy(*keys)
    before = by_key.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_rows").over(by_key))
    offsets = offsets.drop("_rows").withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_span"]})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_span") == F.col("_of__span"))
    inside = W.partitionBy(*keys, "_span").orderBy(F.col(order).asc_nulls_last(), "_tie")
    return (
        cut.join(offsets, same)
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_span", "_tie", "_offset", *[f"_of_{k}" for k in [*keys, "_span"]])
    )


def first_rows(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The first row per key as an aggregate: combined before the shuffle, so a
    key with many rows sends one row per task. ``order`` must be unique per key."""
    return _edge_rows(df, keys, F.min_by, order, columns)


def last_rows(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    return _edge_rows(df, keys, F.max_by, order, columns)


def _edge_rows(df: DataFrame, keys: list[str], pick, order: Column, columns: list[str]) -> DataFrame:
    picked = df.groupBy(*keys).agg(pick(F.struct(*columns), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The n first rows per key with their rank. Spark limits each key to n rows
    before the shuffle as well as after it."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank.cast("bigint")).where(F.col(out) <= n)


def fixed_batches(df: DataFrame, position: str, size: int) -> DataFrame:
    """Batch number and index inside the batch from an existing position."""
    return df.withColumn("batch_id", F.floor(F.col(position) / size)).withColumn("batch_index", F.col(position) % size)


def place_rows(df: DataFrame, order: str, out: str = "pos0", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Zero-based position of each row in the whole table, whatever gaps the unique
    ``order`` has; rows without an order come last. Rows are numbered inside ranges of about
    equal row numbers; a range's offset comes from the counts of the ranges before it."""
    cut = _cut(df, order, range_splits(df, order, rows_per_range))
    counts = cut.groupBy("_span").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    offsets = counts.select("_span", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.row_number().over(W.partitionBy("_span").orderBy(F.col(order).asc_nulls_last(), "_tie")) - 1
    return cut.join(offsets, "_span").withColumn(out, place).drop("_span", "_tie", "_offset")


def request_batches(df: DataFrame, order: str, size: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Consecutive batches of ``size`` rows in order, the last one perhaps smaller."""
    return fixed_batches(place_rows(df, order, "_place", rows_per_range), "_place", size).drop("_place")


def ordered_text(df: DataFrame, keys: list[str], position: str, line: Column, out: str = "text", separator: str = "\n") -> DataFrame:
    """Lines of a group joined in order. ``keys`` must name bounded groups: a
    chunk, a batch, or a page of a position."""
    rows = df.select(*keys, F.struct(F.col(position).alias("p"), line.alias("l")).alias("_r"))
    listed = F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["l"])
    return rows.groupBy(*keys).agg(F.concat_ws(separator, listed).alias(out))


def pages(df: DataFrame, keys: list[str], order: str, line: Column, size: int = PAGE_CHARS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows with ``page``, ``n_pages``, ``page_pos`` (the row's place in its key, from 0): a page is
    the lines that begin within ``size`` characters of each other's page, so its text is at
    most ``size`` characters and one line. Running lengths are prefix sums over
    the ranges of ``number_rows``, so no key is laid out in one task."""
    splits = range_splits(df, order, rows_per_range)
    cut = _cut(df.withColumn("_line", line), order, splits).withColumn("_chars", F.coalesce(F.char_length("_line"), F.lit(0)).cast("long"))
    sums = cut.groupBy(*keys, "_span").agg(F.count("*").alias("_rows"), F.sum("_chars").alias("_held"))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    all_spans = W.partitionBy(*keys)
    offsets = sums.select(
        *[F.col(k).alias(f"_of_{k}") for k in [*keys, "_span"]], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_char0"), F.sum("_held").over(all_spans).alias("_all"),
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_span") == F.col("_of__span"))
    inside = W.partitionBy(*keys, "_span").orderBy(F.col(order).asc_nulls_last(), "_tie")
    start = F.col("_char0") + F.coalesce(F.sum("_chars").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = cut.join(offsets, same).withColumn("page_pos", F.col("_row0") + F.row_number().over(inside) - 1).withColumn("_start", start)
    return (
        placed.withColumn("n_pages", F.floor(F.greatest(F.lit(0), F.col("_all") - 1) / size) + 1)
        .withColumn("page", F.least(F.floor(F.col("_start") / size), F.col("n_pages") - 1))  # empty lines at the end
        .drop("_line", "_chars", "_span", "_tie", "_row0", "_char0", "_all", "_start", *[f"_of_{k}" for k in [*keys, "_span"]])
    )


def _seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of n rows: order by a seeded digest, then limit. Each task
    keeps n rows, so nothing is sorted as a whole."""
    return df.orderBy(_seeded(key, seed), F.col(key)).limit(n)


def seeded_sample_per_group(df: DataFrame, keys: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    hashed = df.withColumn("_h", _seeded(key, seed))
    return top_per_group(hashed, keys, [F.col("_h"), F.col(key)], n).drop("_h", "rank")
