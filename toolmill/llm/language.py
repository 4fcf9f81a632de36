"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent character n-grams (1 to ``LONGEST``
letters, words padded with a blank) in order of frequency. A language's profile comes
from all its training documents; a document belongs to the language whose profile is
nearest by out-of-place distance: the sum over the document's n-grams of the difference
of ranks, with the most possible for n-grams the language lacks. The score is one minus
the distance over the largest possible.

Learning sums n-gram counts map-side first, and the ranking per language is limited
before the shuffle, so neither a language with most rows nor a wide script meets in one
task. Profiles are ``PROFILE`` n-grams a language; the number of languages is checked
before they are broadcast.

Defined results: null texts and texts without letters are ``und`` with score 0, as is
every text if nothing could be learned; equal counts rank by n-gram, equal distances go
to the language first by code point; a null id counts as training row if it has text and
lang; repeated rows count repeatedly; no rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toolmill.llm.common import fold, kept_with, map_texts, slices, text_of

LONGEST = 3
PROFILE = 400
MOST_LANGUAGES = 2_000
FLUSH_GRAMS = 2_000_000
UNKNOWN = "und"

_PLANE = np.array([chr(c).isalpha() for c in range(0x10000)], bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not len(points) or points.max() < len(_PLANE):
        return _PLANE[points]
    found = _PLANE[np.minimum(points, len(_PLANE) - 1)]
    high = np.flatnonzero(points >= len(_PLANE))
    found[high] = [chr(c).isalpha() for c in points[high].tolist()]
    return found


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text's words, three code points of 21 bits each; a run
    of non-letters is one blank (0). Single blanks aren't n-grams."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.where(_is_letter(points), points, 0)
    points = np.concatenate([[0], points, [0]])
    points = points[(points != 0) | np.concatenate([[True], points[:-1] != 0])]
    out, code = [points[points != 0]], points
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << 21) | points[n - 1 :]
        middle = np.ones(len(code), bool)
        for k in range(1, n - 1):  # no blank inside
            middle &= points[k : len(points) - n + 1 + k] != 0
        if n == 2:
            middle = (points[:-1] != 0) | (points[1:] != 0)
        out.append(code[middle])
    return np.concatenate(out)


def profile_of(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, in order; equal counts in order of code."""
    unique, counts = np.unique(codes, return_counts=True)
    return unique[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, rank, gram): the profile of every language among ``docs`` with text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for part in slices(batches):
            found: dict[str, list[np.ndarray]] = {}
            for raw, lang in zip(text_of(part.column("text")), part.column("lang").to_pylist()):
                found.setdefault(lang, []).append(grams(raw.decode()))
            for lang, lists in found.items():
                codes, n = np.unique(np.concatenate(lists), return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], codes])
                    codes, where = np.unique(both, return_inverse=True)
                    n = np.bincount(where, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = codes, n
            if sum(len(x[0]) for x in held.values()) > FLUSH_GRAMS:
                yield from flush()
        yield from flush()

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "rank", "gram")


class Profiles:
    """Rank of every known n-gram in every language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.known = np.unique(np.array([r[2] for r in rows], np.int64))
        self.ranks = np.full((len(self.known), len(self.langs)), -1, np.int64)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.known, gram), self.langs.index(lang)] = rank - 1

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes = grams(text) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = profile_of(codes, self.size)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        ranks = np.where((self.known[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * len(own)))


def identify(docs: DataFrame, learned: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    rows = [tuple(r) for r in learned.limit(size * MOST_LANGUAGES + 1).collect()]
    if len(rows) > size * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; lang seems not to hold languages")
    shared = docs.sparkSession.sparkContext.broadcast({"rows": rows})

    def one(batch: pa.RecordBatch) -> dict:
        profiles = kept_with(shared, "profiles", lambda value: Profiles(value["rows"], size))
        found = [profiles.nearest(None if t is None else t.decode()) for t in text_of(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, lang_pred string, score double")


def predict(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learns from the documents outside the held-out fold and predicts all."""
    learned = learn(docs.where(fold(folds) != held))
    found = identify(docs, learned)
    return found.select("doc_id", (fold(folds) == held).alias("held_out"), "lang_pred", "score")
