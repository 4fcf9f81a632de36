"""Exact vector retrieval and its recall.

``tools(tool_id, vec)`` and ``queries(query_id, vec)`` are keyed tables. Scores
are cosines rounded to six places, ties go to the lower tool id, so results
don't depend on how rows are dealt."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolmill.functions.schema import is_object, items
from toolmill.functions.vectors import SCORE_PLACES, is_finite, norm, or_zero_vector
from toolmill.operators.ordering import top_per_group

PIVOTS = 32
CELL_ROWS = 1_024
QUERY_CHUNK = 512
TOOL_CHUNK = 2_048
BLOCK_ROWS = 32_768  # the most queries, and about the most tools, that one task multiplies
PAIR_CHUNK = 16_384  # pairs scored in doubles at a time
ZERO = -1  # the pivot of zero vectors
NO_SCORE = -2.0  # below every cosine
SLACK = 2e-6  # scores are rounded to six places
EPSILON = 2.0**-24  # of a rounding to float
SPAN = "width int, pivot int, low double, high double, n bigint"
TOOLS = "slice int, width int, pivot int, ids array<bigint>, rows binary"
ASKED = "block int, width int, ids array<bigint>, rows binary, home array<int>, least array<double>"
RESULT = "query_id bigint, tool_id bigint, score double, multiplied bigint"
SCORED = pa.schema([("query_id", pa.int64()), ("tool_id", pa.int64()), ("score", pa.float64()), ("multiplied", pa.int64())])


# --- keyed embedding tables -----------------------------------------------------------

def key_mismatches(tools: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Tools without a vector and vectors without a tool."""
    missing = tools.select("tool_id").join(embeddings, "tool_id", "left_anti").withColumn("problem", F.lit("missing_vector"))
    extra = embeddings.select("tool_id").join(tools, "tool_id", "left_anti").withColumn("problem", F.lit("vector_without_tool"))
    return missing.unionByName(extra)


def complete_vectors(tools: DataFrame, embeddings: DataFrame, dimension: int) -> DataFrame:
    """One vector per tool: a zero vector, flagged, where none exists."""
    joined = tools.select("tool_id").join(embeddings.select("tool_id", "vec"), "tool_id", "left")
    return joined.select("tool_id", or_zero_vector(F.col("vec"), dimension).alias("vec"), F.col("vec").isNull().alias("is_fallback"))


def dimension_errors(embeddings: DataFrame, dimension: int) -> DataFrame:
    """Vectors of another width, and vectors with an element that is null or no finite number."""
    wrong = F.col("vec").isNotNull() & ((F.size("vec") != dimension) | ~is_finite(F.col("vec")))
    return embeddings.where(wrong).select("tool_id", F.size("vec").cast("bigint").alias("dimension"))


# --- top-k -----------------------------------------------------------------------------
#
# Tools are dealt to the nearest of a few pivots and cut into cells: rows of one pivot with
# the interval of their angles to it. A query at angle t to a pivot has an angle of at least
# t - high or low - t to every vector of a cell, so a cell whose best possible cosine is
# below the k-th score the query already has is skipped. No skip changes a result.
#
# What travels are blocks: all tools are cut into slices (whole pivots, or parts of a large one)
# and all queries into groups, and a task gets one group's queries with one slice's tools. It
# carries the k best of a few hundred queries over the slice, so its memory and the rows it sends do
# not depend on the size of the tables, and no row is copied for a cell.

@dataclass(frozen=True)
class Pivots:
    """Unit pivots by vector width; a width without any has its first axis."""

    rows: dict[int, np.ndarray]

    def of(self, width: int) -> np.ndarray:
        return self.rows[width] if width in self.rows else np.eye(1, width)

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each row's nearest pivot and the angle to it; zero rows, which are
        similar to nothing, have number ``ZERO`` and angle 0."""
        cosine = unit @ self.of(unit.shape[1]).T
        near = cosine.argmax(axis=1)
        zero = ~unit.any(axis=1)
        angle = np.arccos(np.clip(cosine[np.arange(len(unit)), near], -1, 1))
        return np.where(zero, ZERO, near), np.where(zero, 0.0, angle)

    def bound(self, unit: np.ndarray, pivot: int, low: float, high: float) -> np.ndarray:
        """The greatest cosine each row can have with a vector of the interval."""
        if pivot == ZERO:
            return np.zeros(len(unit))
        angle = np.arccos(np.clip(unit @ self.of(unit.shape[1])[pivot], -1, 1))
        best = np.cos(np.clip(np.maximum(angle - high, low - angle), 0, np.pi))
        return np.where(unit.any(axis=1), best, 0.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in doubles; zero rows stay zero."""
    rows = rows.astype(np.float64)
    rows = rows / np.maximum(np.abs(rows).max(axis=1), 1e-300)[:, None]  # so that no square over- or underflows
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(length == 0, 1.0, length)[:, None]


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows as they are) of a batch for each width in it."""
    width = np.asarray(pa.compute.list_value_length(batch.column("vec")))
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        flat = batch.column("vec").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, (flat if flat.dtype == np.float32 else flat.astype(np.float64)).reshape(len(at), w)


def choose_pivots(tools: DataFrame, count: int) -> Pivots:
    """Up to ``count`` pivots per width, far from each other, out of ``16 * count`` tools drawn by hash."""
    drawn = tools.orderBy(F.xxhash64("tool_id"), "tool_id").select("tool_id", "vec").limit(16 * count).toArrow().combine_chunks()
    rows = {}
    for batch in drawn.to_batches():
        for _, found in _by_width(batch):
            unit = _unit(found)
            unit = unit[unit.any(axis=1)]
            if not len(unit):
                continue
            chosen, closest = [0], unit @ unit[0]
            while len(chosen) < min(count, len(unit)) and closest.min() < 0.999:
                chosen.append(int(closest.argmin()))
                closest = np.maximum(closest, unit @ unit[chosen[-1]])
            rows[unit.shape[1]] = unit[chosen]
    return Pivots(rows)


def _spans(tools: DataFrame, pivots: Pivots) -> list[tuple[int, int, float, float, int]]:
    """Angles that occur at each pivot and its number of tools: a row per pivot and width."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for _, rows in _by_width(batch):
                near, angle = pivots.nearest(_unit(rows))
                found = [(p, angle[near == p]) for p in np.unique(near).tolist()]
                yield pa.RecordBatch.from_pydict({
                    "width": pa.array([rows.shape[1]] * len(found), pa.int32()), "pivot": pa.array([p for p, _ in found], pa.int32()),
                    "low": pa.array([x.min() for _, x in found], pa.float64()), "high": pa.array([x.max() for _, x in found], pa.float64()), "n": pa.array([len(x) for _, x in found], pa.int64()),
                })

    spans = tools.select("vec").mapInArrow(span, SPAN).groupBy("width", "pivot")
    return [tuple(r) for r in spans.agg(F.min("low"), F.max("high"), F.sum("n")).orderBy("width", "pivot").collect()]


def _parts(rows: int) -> int:
    """Into how many parts a table is cut: of ``BLOCK_ROWS`` rows, and a few if it is small."""
    return max(1, -(-rows // BLOCK_ROWS), min(6, rows // 1_024))


def _slices(spans: list[tuple[int, int, float, float, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """First slice and number of slices of each (width, pivot): small pivots of a width share one."""
    total = sum(s[4] for s in spans)
    size = max(1, -(-total // _parts(total)))
    out, number, held, of = {}, -1, 0, None
    for width, pivot, _, _, n in spans:
        if of != width or held + n > size:
            number, held, of = number + 1, 0, width
        parts = max(1, -(-n // size))
        out[width, pivot] = (number, parts)
        number, held = number + parts - 1, held + n
    return out


def _dealt(n: int, parts: int, salt: int) -> np.ndarray:
    """A part for each of ``n`` rows: runs of equal length; few rows begin at a part by ``salt``."""
    at = np.arange(n)
    return at * parts // max(n, 1) if n >= parts else (at + zlib.crc32(str(salt).encode())) % parts


def _tool_packs(tools: DataFrame, pivots: Pivots, slices: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """Tools of a batch packed by slice and pivot, in the order of their angles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for at, rows in _by_width(batch):
                near, angle = pivots.nearest(_unit(rows))
                ids, out = batch.column("tool_id").to_numpy()[at], []
                for p in np.unique(near).tolist():
                    run = np.flatnonzero(near == p)
                    run = run[np.argsort(angle[run], kind="stable")]
                    first, parts = slices[rows.shape[1], p]
                    part = _dealt(len(run), parts, ids[run[0]])
                    out += [(first + j, p, run[part == j]) for j in np.unique(part).tolist()]
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([o[0] for o in out], pa.int32()), "width": pa.array([rows.shape[1]] * len(out), pa.int32()), "pivot": pa.array([o[1] for o in out], pa.int32()),
                    "ids": pa.array([ids[o[2]] for o in out], pa.list_(pa.int64())), "rows": pa.array([rows[o[2]].tobytes() for o in out], pa.binary()),
                })

    return tools.select("tool_id", "vec").mapInArrow(pack, TOOLS)


def _asked(queries: DataFrame, pivots: Pivots, spans: list[tuple[int, int, float, float, int]], slices: dict[tuple[int, int], tuple[int, int]], groups: int, further: bool) -> DataFrame:
    """Queries packed by the blocks they need: at first the slices of their nearest pivot that has
    tools (``home``), then (``further``) those of all others that may hold a score of at least ``least``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for at, rows in _by_width(batch):
                width, unit = rows.shape[1], _unit(rows)
                here = [s for s in spans if s[0] == width]
                if not here:
                    continue
                bounds = np.stack([pivots.bound(unit, *s[1:4]) for s in here], axis=1)
                best = bounds.argmax(axis=1)
                home = np.array([s[1] for s in here])[best]
                ids, least = batch.column("query_id").take(pa.array(at)), np.asarray(batch.column("least"), np.float64)[at]
                group = np.empty(len(at), np.int64)
                group[np.argsort(best, kind="stable")] = _dealt(len(at), groups, ids[0].as_py())
                wanted: dict[int, np.ndarray] = {}
                for j, (_, pivot, *_) in enumerate(here):
                    rows_of = (best != j) & (bounds[:, j] + SLACK >= least) if further else best == j
                    first, parts = slices[width, pivot]
                    for number in range(first, first + parts) if rows_of.any() else ():
                        wanted[number] = wanted.get(number, False) | rows_of
                for number, rows_of in wanted.items():
                    packs = [np.flatnonzero(rows_of & (group == g)) for g in range(groups)]
                    packs = [(g, x) for g, x in enumerate(packs) if len(x)]
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([number * groups + g for g, _ in packs], pa.int32()), "width": pa.array([width] * len(packs), pa.int32()),
                        "ids": pa.array([ids.take(pa.array(x)).to_pylist() for _, x in packs], pa.list_(pa.int64())), "rows": pa.array([rows[x].tobytes() for _, x in packs], pa.binary()),
                        "home": pa.array([home[x] for _, x in packs], pa.list_(pa.int32())), "least": pa.array([least[x] for _, x in packs], pa.list_(pa.float64())),
                    })

    return queries.select("query_id", "vec", "least").mapInArrow(pack, ASKED)


def _unpacked(packs: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Unit rows of a block, the pack of each, and the ids."""
    width = packs.column("width")[0].as_py()
    lists = packs.column("ids").combine_chunks()
    counts = np.asarray(lists.value_lengths())
    rows = [np.frombuffer(b.as_buffer(), np.float32 if len(b.as_buffer()) == 4 * n * width else np.float64).reshape(n, width) for b, n in zip(packs.column("rows"), counts.tolist())]
    return _unit(np.concatenate(rows)), np.repeat(np.arange(len(counts)), counts), lists.flatten()


class _Best:
    """The ``k`` best tools of each of some queries, and the least score that still counts."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.query, self.tool, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, tool: np.ndarray, score: np.ndarray) -> None:
        query, tool, score = np.append(self.query, query), np.append(self.tool, tool), np.append(self.score, score)
        order = np.lexsort((tool, -score, query))
        first = np.searchsorted(query[order], np.arange(len(self.least)))
        order = order[np.arange(len(order)) - first[query[order]] < self.k]
        self.query, self.tool, self.score = query[order], tool[order], score[order]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.least)) == self.k)
        self.least[full] = np.maximum(self.least[full], self.score[np.searchsorted(self.query, full, "right") - 1])


class _Cells:
    """Tools of one pivot by angle, in cells of ``size`` rows."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, angle: np.ndarray, size: int):
        order = np.argsort(angle, kind="stable")
        self.unit, self.ids, self.size = unit[order], ids[order], size
        self.single = self.unit.astype(np.float32)
        starts = np.arange(0, len(order), size)
        self.low, self.high = angle[order][starts], angle[order][np.minimum(starts + size, len(order)) - 1]

    def reached(self, angle: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell (not included) that may hold a score of ``least`` for each query at ``angle``."""
        reach = np.arccos(np.clip(least - SLACK, -1, 1))
        return np.searchsorted(self.high, angle - reach, "left"), np.searchsorted(self.low, angle + reach, "right")


def _multiplied(unit: np.ndarray, single: np.ndarray, rows: np.ndarray, cells: _Cells, start: int, end: int, best: _Best) -> None:
    """Scores of query ``rows`` with tools ``start`` to ``end``: a product in floats rules out what can't be
    among the k best within its error, the rest is scored in doubles."""
    error = (unit.shape[1] + 4) * EPSILON
    for i in range(start, end, TOOL_CHUNK):
        near = single[rows] @ cells.single[i : min(end, i + TOOL_CHUNK)].T
        least = best.least[rows] - SLACK - error
        if near.shape[1] > best.k and (best.least[rows] == NO_SCORE).any():
            least = np.maximum(least, np.partition(near, -best.k, axis=1)[:, -best.k] - SLACK - 2 * error)
        found = np.flatnonzero(near >= least[:, None].astype(np.float32))
        for j in range(0, len(found), PAIR_CHUNK):  # copies of one vector may all be found
            q, t = np.divmod(found[j : j + PAIR_CHUNK], near.shape[1])
            q, t = rows[q], t + i
            score = np.round(np.einsum("ij,ij->i", unit[q], cells.unit[t]), SCORE_PLACES) + 0.0
            kept = score >= best.least[q]
            if kept.any():
                best.add(q[kept], cells.ids[t[kept]], score[kept])


def _block(queries: pa.Table, tools: pa.Table, pivots: Pivots, k: int, cell_rows: int, chunk: int, further: bool) -> pa.Table:
    """The k best tools of a slice for each query of a group, and a row without a tool that counts the pairs."""
    if not queries.num_rows or not tools.num_rows:
        return SCORED.empty_table()
    unit, pack, ids = _unpacked(tools)
    pivot, numbers, cells = np.asarray(tools.column("pivot"))[pack], ids.to_numpy(), {}
    for p in np.unique(pivot).tolist():
        at = np.flatnonzero(pivot == p)
        angle = np.arccos(np.clip(unit[at] @ pivots.of(unit.shape[1])[p], -1, 1)) if p != ZERO else np.zeros(len(at))
        cells[p] = _Cells(unit[at], numbers[at], angle, cell_rows)
    del unit
    asked, _, query_ids = _unpacked(queries)
    home, least = (np.asarray(queries.column(c).combine_chunks().flatten()) for c in ("home", "least"))
    order, count, out = np.argsort(home, kind="stable"), 0, []
    for at in (order[i : i + chunk] for i in range(0, len(order), chunk)):
        rows, best = asked[at], _Best(least[at], k)
        single, angle = rows.astype(np.float32), np.arccos(np.clip(rows @ pivots.of(rows.shape[1]).T, -1, 1))
        blank = ~rows.any(axis=1)
        for p, held in cells.items():
            first, last = held.reached(angle[:, p] if p != ZERO else np.zeros(len(at)), best.least)
            if p == ZERO:  # similar to nothing: score 0
                first, last = np.zeros_like(first), np.full_like(last, len(held.low))
            else:
                first, last = np.where(blank, 0, first), np.where(blank, len(held.low), last)
            nought = blank | (p == ZERO)
            mine = np.flatnonzero(((home[at] != p) if further else (home[at] == p)) & (first < last) & (~nought | (best.least <= SLACK)))
            if len(mine):
                start, end = first[mine].min() * held.size, min(len(held.ids), last[mine].max() * held.size)
                _multiplied(rows, single, mine, held, start, end, best)
                count += len(mine) * int(end - start)
        out.append(pa.Table.from_arrays([query_ids.take(pa.array(at[best.query])), pa.array(best.tool), pa.array(best.score), pa.nulls(len(best.tool), pa.int64())], schema=SCORED))
    return pa.concat_tables([*out, pa.Table.from_pylist([{"multiplied": count}], schema=SCORED)])


def _products(asked: DataFrame, packs: DataFrame, pivots: Pivots, k: int, cell_rows: int, groups: int, n_slices: int, further: bool) -> DataFrame:
    """Each group of queries with each slice it needs: a block is bounded, so it is one call."""
    blocks, chunk = 2 * groups * n_slices, QUERY_CHUNK

    def multiply(queries: pa.Table, tools: pa.Table) -> pa.Table:
        return _block(queries, tools, pivots, k, cell_rows, chunk, further)

    copies = packs.withColumn("block", F.explode(F.sequence(F.col("slice") * groups, F.col("slice") * groups + (groups - 1))))
    return asked.repartition(blocks, "block").groupBy("block").cogroup(copies.repartition(blocks, "block").groupBy("block")).applyInArrow(multiply, RESULT)


def _phases(tools: DataFrame, queries: DataFrame, k: int, n_pivots: int, cell_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores at each query's own pivot, their k best, and scores at the pivots that may add to these."""
    tools = tools.where(is_finite(F.col("vec")) & F.col("tool_id").isNotNull()).select("tool_id", "vec")
    queries = queries.where(is_finite(F.col("vec"))).select("query_id", "vec")
    pivots = choose_pivots(tools, n_pivots)
    spans = _spans(tools, pivots)
    slices, groups = _slices(spans), _parts(queries.count())
    n_slices = max([1, *(first + parts for first, parts in slices.values())])
    packs = _tool_packs(tools, pivots, slices)
    nothing = F.lit(NO_SCORE)

    def scored(asking: DataFrame, further: bool) -> DataFrame:
        return _products(_asked(asking, pivots, spans, slices, groups, further), packs, pivots, k, cell_rows, groups, n_slices, further)

    first = scored(queries.withColumn("least", nothing), False)
    # numbered by a struct: no filter on the ids that a caller's join infers gets below, so both uses of the first scores are one
    best = top_per_group(first.where("tool_id IS NOT NULL").withColumn("_key", F.struct("query_id")), ["_key"], [F.desc("score"), F.col("tool_id")], k).drop("_key")
    reached = best.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("least"))
    # null-safe: a filter on the ids would keep Spark from using the first scores twice
    known = queries.join(reached, F.col("query_id").eqNullSafe(F.col("_id")), "left").select("query_id", "vec", F.coalesce("least", nothing).alias("least"))
    return first, best, scored(known, True)


def top_k(tools: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k most similar tools of each query with score and rank, exact.

    Rows without a vector take no part (see ``first_k_without_vector``), nor do vectors with an
    element that is null or no finite number (see ``dimension_errors``). Vectors are compared
    with those of their own width. ``pivots`` and ``cell_rows`` change what is skipped, never the result.
    """
    _, best, rest = _phases(tools, queries, k, pivots, cell_rows)
    scored = best.drop("multiplied", "rank").unionByName(rest.where("tool_id IS NOT NULL").drop("multiplied"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.col("tool_id")], k)


def pairs_multiplied(tools: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """How many pairs ``top_k`` scores, and how many there are."""
    first, _, rest = _phases(tools, queries, k, pivots, cell_rows)
    counted = first.unionByName(rest).agg(F.coalesce(F.sum("multiplied"), F.lit(0)).alias("multiplied"))
    return counted.withColumn("pairs", F.lit(tools.count() * queries.count()))


def first_k_without_vector(tools: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries without a vector get the first k tools by position, score 0."""
    head = tools.orderBy("pos").limit(k).select(F.struct("pos", "tool_id").alias("t"))
    listed = head.agg(F.array_sort(F.collect_list("t"))).scalar()
    return (
        queries.where(F.col("vec").isNull())
        .select("query_id", F.posexplode(listed).alias("i", "t"))
        .select("query_id", "t.tool_id", F.lit(0.0).alias("score"), (F.col("i") + 1).cast("bigint").alias("rank"))
    )


def zero_norm(embeddings: DataFrame) -> DataFrame:
    return embeddings.where(norm(F.col("vec")) == 0)


# --- pools ---------------------------------------------------------------------------------

def new_in_pool(retrieved: DataFrame, registered: DataFrame, seen: DataFrame) -> DataFrame:
    """Retrieved names that are registered and not yet in the question's pool."""
    return (
        retrieved.select("question_id", "name").distinct()
        .join(registered.select("name"), "name", "left_semi")
        .join(seen.select("question_id", "name"), ["question_id", "name"], "left_anti")
    )


def first_rounds(retrievals: DataFrame) -> DataFrame:
    """Round in which each name was first retrieved for its question."""
    return retrievals.groupBy("question_id", "name").agg(F.min("round").alias("round"))


def new_per_round(retrievals: DataFrame) -> DataFrame:
    return first_rounds(retrievals).groupBy("question_id", "round").agg(F.count("*").alias("new_tools"))


# --- recall ---------------------------------------------------------------------------------

def expected_names(questions: DataFrame, column: str = "extracted_tools") -> DataFrame:
    """``(question_id, name)`` of the expected tools a question carries as a JSON
    list of objects with a ``function_name``; other entries are passed over."""
    entries = items(F.try_parse_json(column))
    names = F.transform(F.filter(entries, is_object), lambda t: F.try_variant_get(t, "$.function_name", "string"))
    return questions.select("question_id", F.explode(names).alias("name")).where(F.col("name").isNotNull())


def hits(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """Each expected name of a question with its best rank, null if not retrieved."""
    best = retrieved.groupBy("question_id", "name").agg(F.min("rank").alias("rank"))
    return truth.select("question_id", "name").distinct().join(best, ["question_id", "name"], "left")


def recall(questions: DataFrame, retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall and counts per question; a question without expected names has recall 0."""
    found = hits(retrieved, truth).groupBy("question_id").agg(
        F.count("*").alias("_names"), F.count("rank").alias("matched")
    )
    n_retrieved = retrieved.groupBy("question_id").agg(F.count("*").alias("retrieved_count"))
    n_truth = truth.groupBy("question_id").agg(F.count("*").alias("truth_count"))
    return (
        questions.select("question_id")
        .join(found, "question_id", "left").join(n_retrieved, "question_id", "left").join(n_truth, "question_id", "left")
        .fillna(0)
        .select(
            "question_id",
            F.coalesce(F.try_divide("matched", "_names"), F.lit(0.0)).alias("recall"),
            "retrieved_count", "truth_count", "matched",
        )
    )


def recall_at(questions: DataFrame, retrieved: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    per_question = hits(retrieved, truth).groupBy("question_id").agg(
        *[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_at_{k}") for k in ks]
    )
    return questions.select("question_id").join(per_question, "question_id", "left").fillna(0.0)


def recall_summary(recalls: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per k, over all questions of ``recall_at``: mean, population deviation, least and
    greatest recall, and how many are perfect or zero (no expected names: zero). One
    pass, one row per task; no questions, null statistics and zero counts."""
    stats = recalls.agg(*[
        F.struct(
            F.lit(k).cast("bigint").alias("k"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"),
            F.count_if(F.col(c) == 1).alias("count_perfect"), F.count_if(F.col(c) == 0).alias("count_zero"),
        ).alias(c)
        for k in ks for c in [f"recall_at_{k}"]
    ])
    return stats.select(F.inline(F.array(*[f"recall_at_{k}" for k in ks])))


def retrieval_totals(recalls: DataFrame) -> DataFrame:
    """Totals of a run over the rows of ``recall``. A retrieval succeeded if it returned
    anything; expected and retrieved tools count for successful ones only."""
    ok = F.col("retrieved_count") > 0
    totals = recalls.select(ok.alias("ok"), F.when(ok, F.col("truth_count")).alias("truth"), "retrieved_count").agg(
        F.count("*").alias("total_attempts"),
        F.count_if("ok").alias("successful_retrievals"),
        F.count_if(F.col("truth") > 0).alias("questions_with_ground_truth"),
        F.coalesce(F.sum("truth"), F.lit(0)).alias("total_ground_truth_tools"),
        F.coalesce(F.sum("retrieved_count"), F.lit(0)).alias("total_retrieved_tools"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        totals.withColumn("retrieval_success_rate", share("successful_retrievals", "total_attempts"))
        .withColumn("avg_ground_truth_tools", share("total_ground_truth_tools", "questions_with_ground_truth"))
        .withColumn("avg_retrieved_tools", share("total_retrieved_tools", "successful_retrievals"))
    )
