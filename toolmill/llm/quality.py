"""Quality rules as a short-circuit cascade.

On a sample each rule is timed, alone and with the words already split, and the sets of
rules that documents break together are counted. The first rule is the one of most
rejections per second; each next one is chosen by what it rejects among the documents that
are left, at its cost with shared words. A document stops at the first rule it breaks. The
measures behind the rules (words, lines, repeated windows) are computed once per
document and only when a rule asks for them; ``judge`` adds the measures that the
cascade didn't need after its verdict. The verdict is the conjunction of all
rules, so it doesn't depend on the order.

Defined results: a null text has no words; empty, blank and short texts break
``enough_words``; with an empty table the order is the given one; no rows in, no rows
out. All columns pass through the filter untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolmill.llm.common import BLANKS, map_texts, slices, text_of

SAMPLE_ROWS = 2_000
SYMBOLS = b"#*$%&|<>"
NOT_CODE_POINTS = BLANKS + bytes(range(0x80, 0xC0))
NOT_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha())


class Measures:
    """Measures of one text (UTF-8), each computed on first use."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # of bytes: ASCII blanks only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, NOT_CODE_POINTS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times, covered = Counter(windows), bytearray(len(w))
        for i, x in enumerate(windows):
            if times[x] > 1:
                covered[i : i + 3] = b"\x01\x01\x01"
        return sum(covered)

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter (any character beyond ASCII counts as one)."""
        return sum(1 for x in self.words if x.translate(None, NOT_LETTERS))


@dataclass(frozen=True)
class Rule:
    name: str
    keeps: Callable[[Measures], bool]


BASE = (
    Rule("enough_words", lambda m: m.n_words >= 50),
    Rule("few_repeats", lambda m: 100 * m.n_repeat_words <= 50 * m.n_words),
)
RULES = BASE + (
    Rule("few_symbols", lambda m: 10 * m.n_symbols <= m.n_words),
    Rule("few_equal_lines", lambda m: m.n_dup_lines < 4 or 10 * m.n_dup_lines <= 3 * len(m.lines)),
    Rule("word_length", lambda m: 2 * m.n_words <= m.word_chars <= 16 * m.n_words),
    Rule("lettered_words", lambda m: 10 * m.n_lettered >= 7 * m.n_words),
)


@dataclass(frozen=True)
class Profile:
    figures: list[tuple[str, int, int, float]]  # rule, documents, rejected, seconds alone
    shared: dict[str, float]  # seconds of each rule where the words are split already
    broken: dict[int, int]  # documents by the set of rules they break, as bits: 2 ** rules sets at most


def profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> Profile:
    """Costs and rejections on about ``sample_rows`` documents. The sample only sets the order, never a verdict."""
    total = docs.count()

    def time_rules(batch: pa.RecordBatch) -> dict:
        texts = text_of(batch.column("text"))
        broken, alone, shared = [0] * len(texts), [], []
        for i, rule in enumerate(rules):
            for split_before, spent in ((False, alone), (True, shared)):
                fresh = [Measures(t) for t in texts]
                if split_before:
                    for m in fresh:
                        m.n_words  # noqa: B018
                start = time.perf_counter()
                kept = [rule.keeps(m) for m in fresh]
                spent.append(time.perf_counter() - start)
            broken = [bits | (not ok) << i for bits, ok in zip(broken, kept)]
        sets = Counter(broken)
        n = len(rules)
        return {"rule": [*range(n), *[None] * len(sets)], "broken": [*[None] * n, *sets], "n": [*[0] * n, *sets.values()], "alone": [*alone, *[0.0] * len(sets)], "shared": [*shared, *[0.0] * len(sets)]}

    sample = docs.select("text").sample(min(1.0, sample_rows / max(total, 1)), seed)
    timed = map_texts(sample, time_rules, "rule int, broken int, n long, alone double, shared double")
    rows = timed.groupBy("rule", "broken").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"), F.sum("shared").alias("shared")).collect()
    seconds = {r["rule"]: r for r in rows if r["rule"] is not None}
    broken = {r["broken"]: r["n"] for r in rows if r["rule"] is None}
    n = sum(broken.values())
    figures = [(rule.name, n, sum(k for bits, k in broken.items() if bits >> i & 1), seconds[i]["alone"] if seconds else 0.0) for i, rule in enumerate(rules)]
    return Profile(figures, {rule.name: seconds[i]["shared"] for i, rule in enumerate(rules)} if seconds else {}, broken)


def ordered(rules: tuple[Rule, ...], figures: list[tuple[str, int, int, float]], shared: dict[str, float] | None = None, broken: dict[int, int] | None = None) -> tuple[Rule, ...]:
    """Most rejections per second of work first; ties keep the given order. With ``shared`` and
    ``broken`` every rule after the first is judged by its further cost and rejections."""
    cost = {name: spent for name, _, _, spent in figures}
    rejected = {name: k for name, _, k, _ in figures}
    bit = {rule.name: 1 << i for i, rule in enumerate(rules)}
    out: list[Rule] = []
    while len(out) < len(rules):
        rest = [r for r in rules if r not in out]
        best = max(rest, key=lambda r: rejected.get(r.name, 0) / max(cost.get(r.name, 0.0), 1e-9))  # max keeps the first of equals
        out.append(best)
        if len(out) == 1:
            cost |= shared or {}
        if broken is not None:
            done = sum(bit[r.name] for r in out)
            rejected = {r.name: sum(k for bits, k in broken.items() if bits & bit[r.name] and not bits & done) for r in rest}
    return tuple(out)


def cascade_for(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int) -> tuple[Rule, ...]:
    seen = profile(docs, rules, sample_rows)
    return ordered(rules, seen.figures, seen.shared, seen.broken)


def keeps(m: Measures, cascade: tuple[Rule, ...]) -> bool:
    return all(rule.keeps(m) for rule in cascade)  # stops at the first that fails


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base measures and verdict of every document, dropped ones too."""
    cascade = cascade_for(docs, rules, sample_rows)

    def one(batch: pa.RecordBatch) -> dict:
        out: dict[str, object] = {"doc_id": batch.column("doc_id")}
        found = [Measures(t) for t in text_of(batch.column("text"))]
        passed = [keeps(m, cascade) for m in found]
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            out[name] = [getattr(m, name) for m in found]
        out["base_failed"] = [not keeps(m, BASE) for m in found]
        out["kept"] = [ok and not failed for ok, failed in zip(passed, out["base_failed"])]
        return out

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), one, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass every rule, with all their columns."""
    cascade = cascade_for(docs, rules, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            good = part.filter(pa.array([keeps(Measures(t), cascade) for t in text_of(part.column("text"))], pa.bool_()))
            if good.num_rows:
                yield good

    return docs.mapInArrow(run, docs.schema)
