"""Hidden Markov language model over words.

Words are reduced to symbols: each of the (at most) ``SYMBOLS`` most frequent training
tokens that occur twice or more is one; all rarer tokens, and those never seen, are dealt into classes by a
hash of their last ``ENDING`` bytes, as endings tell word forms and languages apart. There are as many classes as
the square root of the number of rarer training words, so the model grows with the vocabulary
(32 thousand classes for a billion words). No part of the model comes from a sample: it starts
from the neighbours of every symbol, counted over all training documents in ``NEIGHBOURS``
classes, and Baum-Welch then runs ``ROUNDS`` full rounds: every partition runs scaled forward and
backward recursions over its training documents and sends expected counts, which are
summed by symbol. A document's score is the log10 probability of its token sequence: the
scaled forward recursion over symbols, and for each rare token its smoothed share of its
class k, (c + 1) / (N_k + 1 * (V_k + 1)). Probabilities of symbols sum to one in every
state and those of the rare words of a class, with one slot for any unknown word, do too.

Texts are split twice: for the vocabulary, then once more into symbol sequences, a table of numbers that
the neighbour counts, every round and the scores read.

The vocabulary is a table; only its ``SYMBOLS`` top rows and a row per class travel to all tasks. Rare tokens
of a document (distinct, with counts) are joined with it on the word, so no single word
gathers many rows, and summed by document.

Defined results: a null text is empty, it has the end token alone; if no document is for
training all counts are 0 and all tokens unknown; words tied at the border of the frequent ones are rare;
repeated rows are scored each; no rows in, no rows out. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolmill.llm.common import fold, kept_with, map_texts, slices, text_of
from toolmill.session import materialize

STATES = 6
SYMBOLS = 40_000
ENDING = 3  # bytes that decide a rare word's class
ROUNDS = 2
NEIGHBOURS = 16  # classes of neighbours: the most frequent symbols, all others, and none for a text's ends
START_ROUNDS = 25
STAY = 0.9  # at the start: a text keeps to its language longer than two neighbours tell
FLUSH_WORDS = 300_000
SLICE = 8 << 20  # bytes of text at once
RUN = 1_500_000  # symbols at once: more rows of like length share a recursion
BATCH_CELLS = 400_000  # documents x steps of one recursion
FLOOR = 1e-3  # pseudo-count of every symbol and step
END = b"\n"  # no word holds a line feed
Model = tuple[np.ndarray, np.ndarray, np.ndarray]  # start (S), steps (S x S), symbols (M x S)


def words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()  # of bytes: A-Z and ASCII blanks only


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, c): tokens of ``training`` and their counts, the end token as a line feed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for part in slices(batches):
            for raw in text_of(part.column("text")):
                held.update(words(raw))
            held[END] += part.num_rows
            if len(held) > FLUSH_WORDS:
                yield flush()
        if held:
            yield flush()

    return training.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(vocab: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int]:
    """The tokens above the lowest count that at most ``most`` tokens exceed, and that count. The
    cut is found on numbers of words by count, so that no task sends its own top list."""
    held, cut = 0, 1  # tokens seen once are always rare: they stand for those not seen at all
    for c, n in vocab.groupBy("c").agg(F.count("*")).orderBy(F.col("c").desc()).limit(most + 1).collect():
        held += n
        if held > most:
            cut = max(c, cut)
            break
    return sorted(((bytes(r[0]), r[1]) for r in vocab.where(F.col("c") > cut).collect()), key=lambda x: (-x[1], x[0])), cut


def class_of(word: bytes, n_classes: int) -> int:
    return zlib.crc32(word[-ENDING:]) % n_classes


def class_column(word: Column, n_classes: int) -> Column:
    """``class_of`` of a binary column."""
    return F.crc32(F.substring(word, -ENDING, ENDING)) % n_classes


def rare_classes(vocab: DataFrame, cut: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class of the words that occur ``cut`` times or less."""
    tokens, distinct = np.zeros(n_classes), np.zeros(n_classes)
    tail = vocab.where(F.col("c") <= cut).groupBy(class_column(F.col("word"), n_classes).alias("k"))
    for k, n, v in tail.agg(F.sum("c"), F.count("*")).collect():
        tokens[k], distinct[k] = n, v
    return tokens, distinct


def _batches(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Rows of similar length together, each batch of a bounded number of cells."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    start = 0
    while start < len(order):
        n = max(1, BATCH_CELLS // max(1, len(texts[order[start]])))
        yield order[start : start + n]
        start += n


def _padded(texts: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(texts[i]) for i in rows])
    grid = np.zeros((lengths[0], len(rows)), np.int64)
    for k, i in enumerate(rows):
        grid[: lengths[k], k] = texts[i]
    alive = (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(axis=1)  # rows are sorted: the first are alive
    return grid, alive


def forward(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each symbol sequence."""
    start, steps, emit = model
    out = np.zeros(len(texts))
    for rows in _batches(texts):
        grid, alive = _padded(texts, rows)
        scale = np.ones(grid.shape)
        state = np.broadcast_to(start, (len(rows), len(start)))
        for t, n in enumerate(alive):
            state = (state[:n] @ steps if t else state) * emit[grid[t, :n]]
            total = state.sum(axis=1)
            state = state / total[:, None]
            scale[t, :n] = total
        out[rows] = np.log10(scale).sum(axis=0)
    return out


def expected(texts: list[np.ndarray], model: Model, counts: Model) -> None:
    """Adds the expected counts of all sequences to ``counts`` (scaled forward and backward)."""
    start, steps, emit = (x.astype(np.float32) for x in model)  # each recursion is rescaled; sums are kept in doubles
    n_states = len(start)
    for rows in _batches(texts):
        grid, alive = _padded(texts, rows)
        ahead = np.zeros((*grid.shape, n_states), np.float32)
        scale = np.ones(grid.shape, np.float32)
        state = np.broadcast_to(start, (len(rows), n_states))
        for t, n in enumerate(alive):
            state = (state[:n] @ steps if t else state) * emit[grid[t, :n]]
            total = state.sum(axis=1)
            state = state / total[:, None]
            ahead[t, :n], scale[t, :n] = state, total
        back = np.ones((alive[-1], n_states), np.float32)
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            if n > len(back):  # sequences that end here
                back = np.concatenate([back, np.ones((n - len(back), n_states), np.float32)])
            weight = back * emit[grid[t, :n]] / scale[t, :n, None]
            ahead_here = ahead[t, :n] * back
            if t:
                counts[1][:] += (ahead[t - 1, :n].T @ weight) * steps
            else:
                counts[0][:] += ahead_here.sum(axis=0)
            ahead[t, :n] = ahead_here
            back = weight @ steps.T
        cells = np.arange(grid.shape[1])[None, :] < alive[:, None]
        symbol, gamma = grid[cells], ahead[cells]
        for s in range(n_states):
            counts[2][:, s] += np.bincount(symbol, gamma[:, s], minlength=len(emit))


def normalised(counts: Model) -> Model:
    start, steps, emit = (x + FLOOR for x in counts)
    return start / start.sum(), steps / steps.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True)


def zeros(symbols: int, states: int) -> Model:
    return np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))


def neighbours(texts: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Of each symbol (rows), how often each class stands before it and after it."""
    none = NEIGHBOURS - 1
    here = np.concatenate([np.zeros(0, np.int64), *texts])
    before, after = (np.full(len(here), none) for _ in range(2))
    edge = np.cumsum([0, *(len(t) for t in texts)])
    inner = np.ones(len(here) + 1, bool)
    inner[edge] = False
    at = np.flatnonzero(inner)  # two symbols of one text meet before these
    before[at], after[at - 1] = classes[here[at - 1]], classes[here[at]]
    size = (len(classes), NEIGHBOURS)
    count = lambda c: np.bincount(here * NEIGHBOURS + c, minlength=size[0] * size[1]).reshape(size)
    return np.concatenate([count(before), count(after)], axis=1).astype(np.float64)


def neighbour_classes(counts: np.ndarray) -> np.ndarray:
    """Class of each symbol: its own for the most frequent, one for all others."""
    classes = np.full(len(counts), NEIGHBOURS - 2)
    top = np.argsort(-counts, kind="stable")[: NEIGHBOURS - 2]
    classes[top] = np.arange(len(top))
    return classes


def start_model(found: np.ndarray, counts: np.ndarray, states: int, rounds: int, seed: int = 7) -> Model:
    """The model in which symbols with like neighbours share a state: expectation
    maximisation of P(neighbour | symbol) = sum of P(state | symbol) P(neighbour | state), from random shares."""
    rng = np.random.RandomState(seed)
    classes = neighbour_classes(counts)
    share = rng.uniform(0.2, 1.8, (len(counts), states))
    share /= share.sum(axis=1, keepdims=True)
    kinds = share.T @ found + FLOOR
    kinds /= kinds.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        ratio = found / np.maximum(share @ kinds, 1e-300)
        share, kinds = share * (ratio @ kinds.T) + FLOOR, kinds * (share.T @ ratio) + FLOOR
        share /= share.sum(axis=1, keepdims=True)
        kinds /= kinds.sum(axis=1, keepdims=True)
    held = (counts[:, None] + 1.0) * share
    of_class = np.stack([held[classes == c].sum(axis=0) + FLOOR for c in range(NEIGHBOURS - 1)])
    of_class /= of_class.sum(axis=1, keepdims=True)
    before, after = found[:, :NEIGHBOURS], found[:, NEIGHBOURS:]
    start, steps, emit = normalised((share.T @ before[:, -1], share.T @ after[:, :-1] @ of_class, held))
    return start, (1 - STAY) * steps + STAY * np.eye(states), emit


def first_model(texts: list[np.ndarray], counts: np.ndarray, states: int, rounds: int, seed: int = 7) -> Model:
    """``start_model`` of texts in memory."""
    return start_model(neighbours(texts, neighbour_classes(counts)), counts, states, rounds, seed)


class Symbols:
    """Symbol and count of the frequent tokens; the classes of rare ones follow them."""

    def __init__(self, rows: list[tuple[bytes, int]], n_classes: int):
        self.n_classes = n_classes
        self.index = {w: i for i, (w, _) in enumerate(rows)}
        self.counts = np.array([c for _, c in rows], np.float64)
        self.rare = len(rows)

    def of(self, raw: bytes | None) -> tuple[np.ndarray, list[bytes]]:
        """Symbols of a text and its end, and the rare tokens."""
        index, first = self.index, self.rare
        tokens = words(raw)
        tokens.append(END)
        found = np.array([index.get(w, first) for w in tokens], np.int64)
        at = np.flatnonzero(found == first)
        rare = [tokens[i] for i in at.tolist()]
        found[at] += np.fromiter((class_of(w, self.n_classes) for w in rare), np.int64, len(rare))
        return found, rare


def symbols_of(shared) -> Symbols:
    return kept_with(shared, "symbols", lambda value: Symbols(value["top"], value["classes"]))


def encoded(docs: DataFrame, symbols, base_floor: float) -> DataFrame:
    """Each document's symbols, once for all that reads them, with its rare tokens, their numbers, and the base score of the others."""

    def parts(batch: pa.RecordBatch) -> dict:
        known = symbols_of(symbols)
        own = np.append(np.log10(known.counts + 1) - base_floor, np.zeros(known.n_classes))
        texts, rare = zip(*(known.of(t) for t in text_of(batch.column("text"))))
        tallies = [Counter(r) for r in rare]
        return {
            "doc_id": batch.column("doc_id"), "n_tokens": [len(t) for t in texts], "n_frequent": [len(t) - len(r) for t, r in zip(texts, rare)],
            "base": [float(own[t].sum()) for t in texts], "symbols": [t.astype(np.int32) for t in texts],
            "rare": [list(c) for c in tallies], "times": [list(c.values()) for c in tallies],
        }

    schema = "doc_id long, n_tokens long, n_frequent long, base double, symbols array<int>, rare array<binary>, times array<long>"
    return materialize(map_texts(docs, parts, schema, SLICE).withColumn("row", F.monotonically_increasing_id()), "hmm-symbols")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of at most ``RUN`` symbols together (one row at least), and their sequences."""
    for batch in batches:
        lists = batch.column("symbols")
        edge, held = np.asarray(lists.offsets), lists.values.to_numpy()
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(edge, edge[start] + RUN, "right")) - 1)
            yield batch.slice(start, end - start), [held[a:b] for a, b in zip(edge[start:end].tolist(), edge[start + 1 : end + 1].tolist())]
            start = end


def _summed(training: DataFrame, count: Callable[[list[np.ndarray]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of a table of numbers over all training documents, ``count`` adding up those of some symbol
    sequences: as many rows are collected as the model has, whatever the corpus."""
    names = [f"c{i}" for i in range(shape[1])]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(shape)
        for _, texts in runs(batches):
            table += count(texts)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(table[used, i]) for i in range(shape[1]))], names=["row", *names])

    rows = training.select("symbols").mapInArrow(task, "row long, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros(shape)
    for row in rows.collect():
        out[row[0]] = row[1:]
    return out


def train(training: DataFrame, n_symbols: int, frequencies: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the symbols of all training documents."""
    classes = neighbour_classes(frequencies)
    found = _summed(training, lambda texts: neighbours(texts, classes), (n_symbols, 2 * NEIGHBOURS))
    model = start_model(found, frequencies, states, START_ROUNDS)
    for _ in range(rounds):
        shared = training.sparkSession.sparkContext.broadcast(model)

        def count(texts: list[np.ndarray], shared=shared) -> np.ndarray:
            counts = zeros(n_symbols, states)
            expected(texts, shared.value, counts)
            return np.concatenate([counts[2], counts[1], counts[0][None]])  # symbols, then the steps from each state, then the start

        table = _summed(training, count, (n_symbols + states + 1, states))
        model = normalised((table[-1], table[n_symbols:-1], table[:n_symbols]))
        shared.unpersist()
    return model


def score(docs: DataFrame, folds: int = 7, held: int = 2, states: int = STATES, n_frequent: int = SYMBOLS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    training = docs.where(fold(folds) != held)
    vocab = materialize(vocabulary(training), "hmm-vocabulary")
    n, v = (x or 0 for x in vocab.agg(F.sum("c"), F.count("*")).first())
    top, cut = frequent(vocab, n_frequent)
    n_classes = max(1, math.isqrt(v - len(top)))
    rare_n, rare_v = rare_classes(vocab, cut, n_classes)
    symbols = spark.sparkContext.broadcast({"top": top, "classes": n_classes})
    frequencies = np.array([*(c for _, c in top), *rare_n], np.float64)
    base_floor = float(np.log10(n + v + 1))
    split = encoded(docs, symbols, base_floor)
    start, steps, emit = train(split.where(fold(folds) != held), len(frequencies), frequencies, states, rounds)
    # a rare word's share of its class is (c + 1) / (N_k + V_k + 1): the divisor here, c + 1 after the join
    model = spark.sparkContext.broadcast((start, steps, emit / np.append(np.ones(len(top)), rare_n + rare_v + 1)[:, None]))

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches):
            yield part.set_column(part.num_columns - 1, "chain", pa.array(forward(texts, model.value)))

    chained = split.select("row", "doc_id", "n_tokens", "n_frequent", "base", "symbols").mapInArrow(chains, "row long, doc_id long, n_tokens long, n_frequent long, base double, chain double")
    scored = materialize(chained, "hmm-scored")
    rare = split.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    seen = rare.join(vocab, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log_c = F.col("times") * F.log10(F.col("c") + 1)
    summed = seen.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(log_c).alias("logs"), F.sum("times").alias("rare_tokens")
    )
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(summed, "row", "left").select(
        "doc_id", (fold(folds) == held).alias("held_out"), "n_tokens", (F.col("n_frequent") + nought("rare_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + nought("logs") - nought("rare_tokens") * F.lit(base_floor)).alias("base_score"),
        (F.col("chain") + nought("logs")).alias("score"),
    )
