"""Token counts of fields and sections from one encoding of the whole document.

A document is encoded once; every token has a span of bytes, every section a span too
(sorted, without overlaps). Both are intervals on one line, so the join is a binary
search of token borders among section borders. Tokens that cross a border go by an
explicit rule: ``start`` gives a token to the section of its first byte, ``end`` to that
of its last byte, ``share`` splits it by bytes.

Sections of a document are its lines, each with the line feed that ends it, unless
``sections`` gives other starts. Byte spans lie where character spans do: no section
starts inside a character.

Defined results: a null or empty text has no section and gives no row in ``by_section``,
and zeros in ``by_document``; counts of a document's sections add up to its tokens under
every rule; ``by_document`` is the digest of ``by_section``; repeated rows give repeated
rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolmill.llm.bpe import Encoder, encoder_of, load
from toolmill.llm.common import map_texts, text_of

RULES = ("start", "end", "share")


def line_starts(raw: bytes) -> np.ndarray:
    """Start of every line; a line feed ends its line."""
    if not raw:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], ends[ends < len(raw)]]).astype(np.int64)


def token_lengths(coder: Encoder, words: list[str]) -> np.ndarray:
    """Bytes of every token of words that the coder has learned."""
    return np.frombuffer(b"".join([coder.words[w][3] for w in words]), np.uint8).astype(np.int64)


def _learned(coder: Encoder, raws: list[bytes]) -> list[list[str]]:
    """The words of each text, all of them learned together."""
    if not coder.lengths:
        coder.lengths = True
        coder.words.clear()
    texts = [coder.pieces(raw.decode()) for raw in raws]
    coder.learn(set().union(*texts))
    return texts


def allocate(ends: np.ndarray, starts: np.ndarray, rule: str, crossings: bool = True) -> tuple[np.ndarray, int]:
    """Tokens of each section, and (if asked for) how many tokens cross a border."""
    if not len(starts) or not len(ends):
        return np.zeros(len(starts)), 0
    begins = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, begins, "right") - 1
    if rule == "start" and not crossings:
        return np.bincount(first, minlength=len(starts)).astype(np.float64), 0
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    counts = np.bincount(last if rule == "end" else first, minlength=len(starts)).astype(np.float64)
    if rule == "share":
        for t in crossing:
            counts[first[t]] -= 1
            borders = np.concatenate([[begins[t]], starts[first[t] + 1 : last[t] + 1], [ends[t]]])
            counts[first[t] : last[t] + 1] += np.diff(borders) / (ends[t] - begins[t])
    return counts, len(crossing)


def _encoded(coder: Encoder, batch: pa.RecordBatch, sections: Callable[[bytes], np.ndarray]):
    raws = [raw or b"" for raw in text_of(batch.column("text"))]
    for raw, words in zip(raws, _learned(coder, raws)):
        yield raw, np.cumsum(token_lengths(coder, words)), sections(raw)


def _checked(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")


def by_section(docs: DataFrame, path: str, rule: str = "start", sections: Callable[[bytes], np.ndarray] = line_starts) -> DataFrame:
    """doc_id, section (from 0), its first byte and length, and its tokens."""
    _checked(rule)
    vocabulary = load(docs.sparkSession, path)

    def one(batch: pa.RecordBatch) -> dict:
        # all texts of a slice lie on one line: no token and no section crosses from one to the next
        coder, raws = encoder_of(vocabulary), [raw or b"" for raw in text_of(batch.column("text"))]
        ends = np.cumsum(token_lengths(coder, [w for words in _learned(coder, raws) for w in words]))
        own = [sections(raw) for raw in raws]
        held, sizes = np.array([len(x) for x in own], np.int64), np.array([len(raw) for raw in raws], np.int64)
        of, begin = np.repeat(np.arange(len(raws)), held), np.cumsum(sizes) - sizes
        first = np.concatenate([np.zeros(0, np.int64), *own])
        starts = first + begin[of]
        number = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held)
        n_bytes = np.diff(np.append(starts, sizes.sum()))
        tokens, _ = allocate(ends, starts, rule, crossings=False)
        return {"section": number, "first_byte": first, "n_bytes": n_bytes, "n_tokens": tokens, "doc_id": batch.column("doc_id").take(pa.array(of, pa.int64()))}

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, section long, first_byte long, n_bytes long, n_tokens double")


def by_document(docs: DataFrame, path: str, rule: str = "start", sections: Callable[[bytes], np.ndarray] = line_starts) -> DataFrame:
    """One row per document: its tokens, sections, crossing tokens, the largest section and its tokens."""
    _checked(rule)
    vocabulary = load(docs.sparkSession, path)

    def one(batch: pa.RecordBatch) -> dict:
        coder, out = encoder_of(vocabulary), {k: [] for k in ("n_tokens", "n_sections", "n_crossing", "largest", "largest_tokens")}
        for _, ends, starts in _encoded(coder, batch, sections):
            counts, crossing = allocate(ends, starts, rule)
            out["n_tokens"].append(len(ends))
            out["n_sections"].append(len(starts))
            out["n_crossing"].append(crossing)
            out["largest"].append(int(counts.argmax()) if len(counts) else None)
            out["largest_tokens"].append(float(counts.max()) if len(counts) else 0.0)
        return out | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_tokens long, n_sections long, n_crossing long, largest long, largest_tokens double"
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), one, schema)
