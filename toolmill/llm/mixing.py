"""Mixing sources to target weights.

Every document gets a hash-random key, the documents of a source are laid out in key
order, and a source's mix is the first ``target`` words of that order, read again from
its start once it is used up (epochs). Positions are distributed prefix sums: the key
range of a source is cut into ranges of bounded expected size, range totals are summed
in key order (few rows), and each range is summed on its own from its offset, so a
source with a third of all rows is many small windows.

The cut is exact to a word: the document on the border is taken in part, so the taken
words of a source are its target rounded to a whole word. ``mixed`` takes documents
whole: the bordering one is taken in full.

Defined results: a null text has size 0 and takes nothing, like any document without
words; a null source is a source of its own, last in order; ties of the key go by
doc_id, then by a digest of the text; a row without an id has its key from its text, so such rows
spread over the ranges too; rows of one source that agree in id and text split what is left
between them, the same amounts in every run; without words all targets are 0; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolmill.llm.common import WORD, free
from toolmill.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_RANGE = 50_000
SEED = "mix"


def key_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Random key by id; by text where there is no id."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(seed + ":"), named).cast("binary"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words and random key; the only columns that are shuffled."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key_of(F.col("doc_id"), F.col("text"), seed).alias("key"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("digest"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Target words of each source: ``share`` of all words dealt by weight, no source
    above ``most`` times its own words. Resharing until none is above ends where every
    source below its bound has the same words per weight; so sources are closed in the
    order of bound per weight, and the first that fits sets that level. Both windows run
    over one row per source."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per_source.withColumn("rank", F.row_number().over(in_order)).withColumn("weight", weight.cast("double"))
    ranked = ranked.withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("bound") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    closed, used = F.coalesce(F.sum("bound").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - closed) / (F.sum("weight").over(everything) - used)
    fits = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("bound"))
    shared = F.min(F.when(F.col("fits"), F.struct(F.col("bound") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return fits.select("source", "source_size", "n_rows", F.least("bound", F.coalesce(shared * F.col("weight"), F.col("bound"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, rows_per_range: int = ROWS_PER_RANGE, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken."""
    rows = materialize(sized(docs, seed), "mix-sizes")
    plan = materialize(targets(rows, weights, share, most), "mix-targets")  # a row per source: Spark broadcasts it if its size allows
    # ranges of a source: as many leading values of the key as bring rows_per_range each
    position = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    planned = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    ranges = F.ceil(F.col("n_rows") / F.lit(rows_per_range))
    laid = planned.withColumn("range", F.floor(position * ranges / F.lit(float(1 << 32))).cast("long"))
    totals = laid.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    placed = laid.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return (
        placed.withColumn("start", start).withColumn("epochs", epochs)
        .select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the mix's proportions: a document comes once for each time it is taken, in full or in part."""
    own, copies, copy = free(docs, "_id", "_copies", "_copy")
    taken = mix(docs, **options).where("taken > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(copies))
    joined = docs.join(taken.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
