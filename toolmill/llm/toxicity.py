"""Toxicity by a learned lexicon, matched through Levenshtein automata on its trie.

The lexicon is learned from a bounded sample of labelled training documents: words, and
stems of words, that are far more frequent in toxic texts. It is a trie; the Levenshtein
automaton of a word is run against all of it at once, as a set of (trie node, edits)
states that is turned into a deterministic automaton step by step and kept, so a
distinct word costs a few table steps and misspelt terms are found within the edits that
their length allows.

Words are runs of letters, in learning and in matching; runs are
also matched with the few signs between them, for misspellings with signs inside. Words too short for edits are exact.
The lexicon has every term that passes the tests of gain and precision.

Every exact match counts the term's weight; of misspelt ones, which chance makes in long
texts, the strongest counts, less per edit. Weights are changed by the window of words:
quotation marks around it or reporting words make it a quotation, words of address make
it abuse. A logistic model of both sums, fitted on the same sample, gives the score.

Defined results: null and empty texts have no matches and get the model's score for
that; without labelled documents of both classes the score is the share of toxic ones
(0 without any); a document with several labels is toxic if any is; labels without a
document, and null labels, are ignored; repeated rows are scored each; no rows in, no
rows out. Only ``doc_id`` and ``text`` of documents are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toolmill.llm import near
from toolmill.llm.common import fold, kept_with, map_texts, slices, text_of
from toolmill.session import materialize

SAMPLE_LABELS = 20_000
SHORTEST, LONGEST_STEM = 4, 8  # letters of stems
LEAST_GAIN = 20.0  # log likelihood ratio against chance, natural log; far above the log of the number of terms tried
LEAST_PRECISION = 0.9  # share of toxic documents among those with the term
COPY_TESTS = 4
EDIT_LENGTHS = (5, 9)  # one edit from the first length on, two from the second
EDIT_DISCOUNT = 0.5
WINDOW = 6
QUOTED, ADDRESSED = 0.3, 1.5
SEEN_WORDS = 400_000
CACHED_STEPS = 400_000

# Quotation marks, words that report speech, words of address.
MARKS = "\"“”„«»‘’‹›"
REPORTS = frozenset("said says wrote called term word quote quoted sagte schrieb nannte wort zitat dit écrit appelé mot cité dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your yourself du dich dein euch ihr tu te toi ton vous tú ti usted vosotros".split())

_EDGES = regex.compile(r"^[^\p{L}]+|[^\p{L}]+$")
_WORDS = regex.compile(r"\p{L}+")


def plain(word: bytes) -> str:
    """A token in lower case without what isn't a letter at its ends."""
    return _EDGES.sub("", word.decode("utf-8", "replace").lower())


def edits_for(length: int) -> int:
    return sum(length >= n for n in EDIT_LENGTHS)


class Lexicon:
    """Terms with weights, and the automaton over their trie. A stem matches, without
    edits, every word that begins with it; words with edits are terms of their own."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]
        for i, (term, stem, _) in enumerate(terms):
            allowed, node = 0 if stem else edits_for(len(term)), 0
            self.reach[0] = max(self.reach[0], allowed)
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node].append(i)
        self._reset()

    def _reset(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.sets: list[dict[int, int]] = []
        self.found: list[tuple[tuple[int, int] | None, tuple[int, int] | None]] = []
        self.numbers: dict[frozenset, int] = {}
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state with these (node, fewest edits), after skipped letters of terms."""
        open_nodes = list(nodes)
        while open_nodes:
            node = open_nodes.pop()
            for child in self.children[node].values():
                edits = nodes[node] + 1
                if edits <= self.reach[child] and edits < nodes.get(child, 99):
                    nodes[child] = edits
                    open_nodes.append(child)
        name = frozenset(nodes.items())
        if name not in self.numbers:
            whole = [(e, i) for n, e in nodes.items() for i in self.ends[n] if not self.terms[i][1] and e <= edits_for(len(self.terms[i][0]))]
            stems = [(e, i) for n, e in nodes.items() for i in self.ends[n] if self.terms[i][1] and e == 0]
            self.numbers[name] = len(self.sets)
            self.sets.append(nodes)
            self.found.append((min(whole, default=None), min(stems, default=None)))
        return self.numbers[name]

    def _step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            for letter, child in self.children[node].items():
                cost = edits + (letter != ch)
                if cost <= self.reach[child] and cost < out.get(child, 99):
                    out[child] = cost
            if edits + 1 <= self.reach[node] and edits + 1 < out.get(node, 99):  # a letter too many
                out[node] = edits + 1
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or None."""
        if len(self.steps) > CACHED_STEPS:
            self._reset()
        state, stem = 0, None
        for ch in word:
            following = self.steps.get((state, ch))
            if following is None:
                following = self.steps[state, ch] = self._step(state, ch)
            state = following
            if state < 0:
                break
            stem = self.found[state][1] or stem
        whole = self.found[state][0] if state >= 0 else None
        best = min((x for x in (whole, stem) if x), default=None)
        return None if best is None else (best[1], best[0])


class Matcher:
    """Sums of direct and quoted evidence of a text. Words seen are kept, up to a bound."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.lexicon = Lexicon(terms)
        self.seen: set[bytes] = set()
        self.hits: dict[bytes, tuple[float, float]] = {}

    def weights(self, token: bytes) -> tuple[float, float]:
        """Sum of a token's exact matches and its strongest misspelt one: of its letter runs, as
        the lexicon is learned, and of runs with the signs between them, at most as many as edits."""
        whole = plain(token)
        runs = [m.span() for m in _WORDS.finditer(whole)]
        found = [self.lexicon.match(whole[a:b]) for a, b in runs]
        exact = [bool(x) and not x[1] for x in found]
        most = self.lexicon.reach[0]
        for i in range(len(runs)):
            signs = 0
            for j in range(i + 1, len(runs)):
                signs += runs[j][0] - runs[j - 1][1]
                if signs > most or exact[i] or exact[j]:
                    break
                found.append(self.lexicon.match(whole[runs[i][0] : runs[j][1]]))
        weight = [(self.lexicon.terms[x[0]][2] * EDIT_DISCOUNT ** x[1], x[1]) for x in found if x]
        return sum(w for w, edits in weight if not edits), max((w for w, edits in weight if edits), default=0.0)

    def evidence(self, raw: bytes | None) -> tuple[float, float]:
        tokens = (raw or b"").lower().split()
        new = set(tokens).difference(self.seen)
        if len(self.seen) + len(new) > SEEN_WORDS:
            self.seen.clear()
            self.hits.clear()
            new = set(tokens)
        for token in new:
            found = self.weights(token)
            if any(found):
                self.hits[token] = found
        self.seen |= new
        hits = self.hits
        sums, misspelt = [0.0, 0.0], [0.0, 0.0]  # direct, quoted
        for i in [i for i, t in enumerate(tokens) if t in hits]:
            exact, inexact = hits[tokens[i]]
            quotation, address = self.context(tokens, i)
            shares = (QUOTED, 1.0) if quotation else (ADDRESSED if address else 1.0, 0.0)
            for k in (0, 1):
                sums[k] += exact * shares[k]
                misspelt[k] = max(misspelt[k], inexact * shares[k])
        return sums[0] + misspelt[0], sums[1] + misspelt[1]

    @staticmethod
    def context(tokens: list[bytes], i: int) -> tuple[bool, bool]:
        """Whether the window of a match makes it a quotation, and whether it addresses someone."""
        before = [t.decode("utf-8", "replace") for t in tokens[max(0, i - WINDOW) : i]]
        own, after = tokens[i].decode("utf-8", "replace"), [t.decode("utf-8", "replace") for t in tokens[i + 1 : i + 1 + WINDOW]]
        opens = own[:1] in MARKS or any(t[:1] in MARKS for t in before)
        closes = any(c in MARKS for c in own[-2:]) or any(c in MARKS for t in after for c in t[-2:])
        around = {plain(t.encode()) for t in before + after}
        return bool(own) and (opens and closes or bool(around & REPORTS)), bool(around & ADDRESS)


def labelled(docs: DataFrame, labels: DataFrame, folds: int, held: int, rows: int = SAMPLE_LABELS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled training documents, chosen by a hash of
    the id. The chosen ids are few by that bound and are broadcast."""
    per_doc = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = per_doc.where(fold(folds, "_id") != held).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where("text IS NOT NULL").select("text", "toxic")


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with near copies thinned out, so that the words of one much-copied text
    don't look like terms: of rows with a common two-minhash signature one stays, for each
    of ``COPY_TESTS`` signatures in turn."""
    names = [f"u{i}" for i in range(COPY_TESTS)]

    def sign(batch: pa.RecordBatch) -> dict:
        raw = text_of(batch.column("text"))
        pairs = [near.signature_pairs(near.minhashes(h))[:COPY_TESTS] for h in near.shingle_sets(raw)]
        return {"text": batch.column("text"), "toxic": batch.column("toxic")} | {n: [int(p[i]) for p in pairs] for i, n in enumerate(names)}

    found = map_texts(sample, sign, "text string, toxic int, " + ", ".join(f"{n} long" for n in names))
    for name in names:
        first = Window.partitionBy(name).orderBy(F.xxhash64("text"), "text")
        found = found.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    return found.select("text", "toxic")


def candidates(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[tuple[str, bool, int, int, float]], list[tuple[str, float]]]:
    """Words and stems with the documents of each class that have them, best first; and the
    words too rare for that, with their odds, that begin with one of these stems."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[Counter, Counter] = (Counter(), Counter())
        for part in slices(batches):
            for raw, toxic in zip(text_of(part.column("text")), part.column("toxic").to_pylist()):
                terms = set()
                for word in set(_WORDS.findall(raw.decode().lower())):
                    terms.add(word)
                    terms.update(word[:k] + "*" for k in range(SHORTEST, min(len(word), LONGEST_STEM + 1)))
                of[bool(toxic)].update(terms)
        every = list(of[0] | of[1])
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([of[1][t] for t in every], pa.int64()), pa.array([of[0][t] for t in every], pa.int64())], names=["term", "toxic", "clean"])

    sums = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    share, n = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / (n * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0)
    precise = materialize(sums.where((F.col("toxic") > 0) & (F.col("toxic") >= LEAST_PRECISION * n)).withColumn("odds", odds).withColumn("gain", gain), "toxic-terms")
    good = precise.where(F.col("gain") >= LEAST_GAIN)
    rows = good.orderBy((F.col("toxic") * F.col("odds")).desc(), F.length(F.rtrim("term", F.lit("*"))).desc(), F.col("term").desc()).collect()
    words = precise.where((F.col("gain") < LEAST_GAIN) & ~F.col("term").endswith("*"))
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST_STEM)), lambda k: F.concat(F.expr("term").substr(F.lit(1), k), F.lit("*")))
    begun = words.select(F.col("term").alias("word"), F.col("odds").alias("word_odds"), F.explode(starts).alias("term"))
    rarer = begun.join(good.select("term"), "term", "left_semi").select("word", "word_odds").distinct().orderBy("word").collect()
    return [(r["term"].rstrip("*"), r["term"].endswith("*"), r["toxic"], r["clean"], r["odds"]) for r in rows], [tuple(r) for r in rarer]


def choose(ranked: list[tuple[str, bool, int, int, float]], rarer: list[tuple[str, float]] = ()) -> list[tuple[str, bool, float]]:
    """Every whole word, and every stem that no chosen stem covers and that stands for more
    than little beside a chosen term. A word takes its own edits beside the stem that covers
    it, so its misspelt forms are found too. Of the ``rarer`` words those follow that a
    chosen stem stands for."""
    stems: set[str] = set()
    prefixes: dict[str, int] = {}
    out = []
    for term, stem, toxic, _, odds in ranked:
        if stem and (any(term[:k] in stems for k in range(SHORTEST, len(term) + 1)) or prefixes.get(term, -1) * 1.1 >= toxic):
            continue
        out.append((term, stem, float(odds)))
        if stem:
            stems.add(term)
        for k in range(SHORTEST, len(term) + 1):
            prefixes[term[:k]] = max(prefixes.get(term[:k], 0), toxic)
    return out + [(word, False, float(odds)) for word, odds in rarer if any(word[:k] in stems for k in range(SHORTEST, len(word) + 1))]


def features(direct: float, quoted: float) -> list[float]:
    return [1.0, float(np.log1p(direct)), float(np.log1p(quoted))]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the constant isn't shrunk."""
    beta, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ beta)
        beta += np.clip(step, -4, 4)
    return beta


def learn(docs: DataFrame, labels: DataFrame, folds: int, held: int, rows: int = SAMPLE_LABELS) -> tuple[list[tuple[str, bool, float]], np.ndarray]:
    """The lexicon and the coefficients of the model."""
    sample = materialize(without_copies(labelled(docs, labels, folds, held, rows)).repartition(16), "toxic-sample")
    n, n_toxic = (x or 0 for x in sample.agg(F.count("*"), F.sum("toxic")).first())
    if not n_toxic or n == n_toxic:
        return [], np.array([60.0 if n_toxic else -60.0, 0.0, 0.0])
    terms = choose(*candidates(sample, n_toxic, n - n_toxic))

    def measure(batch: pa.RecordBatch) -> dict:
        matcher = Matcher(terms)
        found = [features(*matcher.evidence(t)) for t in text_of(batch.column("text"))]
        return {"toxic": batch.column("toxic"), "direct": [f[1] for f in found], "quoted": [f[2] for f in found]}

    rows_ = map_texts(sample, measure, "toxic int, direct double, quoted double").collect()  # at most the sample's rows, three numbers each
    x = np.array([[1.0, r[1], r[2]] for r in rows_])
    return terms, fit(x, np.array([r[0] for r in rows_], np.float64))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_LABELS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    terms, beta = learn(docs, labels, folds, held, rows)
    shared = docs.sparkSession.sparkContext.broadcast({"terms": terms})

    def one(batch: pa.RecordBatch) -> dict:
        matcher = kept_with(shared, "matcher", lambda value: Matcher(value["terms"]))
        x = np.array([features(*matcher.evidence(t)) for t in text_of(batch.column("text"))])
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        return {"doc_id": batch.column("doc_id"), "score": p.tolist(), "predicted": (p >= 0.5).astype(int).tolist()}

    found = map_texts(docs, one, "doc_id long, score double, predicted int")
    return found.select("doc_id", (fold(folds) == held).alias("held_out"), "score", "predicted")
