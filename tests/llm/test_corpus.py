"""The corpus operators against brute force, the library and SQL, with their edge rows."""

import collections
import hashlib
import importlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect

from toolmill.llm import bpe, exact, hmm, language, mixing, near, quality, surrogates, tokens, toxicity
from toolmill.llm.queries import ORACLES, QUERIES, VOCABULARY

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, _digest string, _row long, _kept long, _id long, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
EDGES = [
    (1, "A b c d e f g", "en", "s1"), (2, "a  B\tc d\ne f g", "en", "s1"), (2, "a  B\tc d\ne f g", "en", "s1"), (3, None, None, None), (None, "a b c d e f g", "en", "s2"),
    (4, "", "fr", "s2"), (5, " \n\t ", "fr", None), (6, LONG, "en", "s1"), (7, "x y", "de", "s3"), (8, "x y", None, "s3"), (9, "é ß 日本語 😀", "de", "s3"), (None, None, None, None),
    (10, "one two three one two three one two three " * 8, "en", "s1"), (11, "!!! ### $$$", "en", "s2"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empties, a long text, ties, repeated rows, and columns with names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, s, 0, "x", 1, 7, 8, "z") for i, t, l, s in EDGES], DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.collect()}


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(name, spark):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


def measured(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, texts, edge, none):
    for row in [*QUERIES["op1_quality_rules"](spark, SMALL).collect()]:
        assert tuple(row[1:6]) == measured(texts[row["doc_id"]])
    rows = quality.judge(edge).collect()
    assert sorted(tuple(r[1:6]) for r in rows) == sorted(measured(t) for _, t, _, _ in EDGES)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    assert quality.keep_good(edge).columns == edge.columns and quality.keep_good(edge).count() == sum(r["kept"] for r in rows)
    assert quality.judge(none).count() == 0


def test_quality_order_is_by_rejections_per_cost():
    rules = quality.RULES[:3]
    figures = [(rules[0].name, 100, 10, 1.0), (rules[1].name, 100, 50, 100.0), (rules[2].name, 100, 10, 0.1)]
    assert [r.name for r in quality.ordered(rules, figures)] == [rules[2].name, rules[0].name, rules[1].name]
    text = quality.Measures(b"short")
    assert not quality.keeps(text, quality.RULES) and "n_repeat_words" not in text.__dict__  # stopped at the first


def test_quality_order_counts_what_is_left():
    """The second rule rejects most, but nothing beyond the first; the third is cheap once the words are split."""
    rules = quality.RULES[:3]
    names = [r.name for r in rules]
    figures = [(names[0], 100, 60, 1.0), (names[1], 100, 50, 1.0), (names[2], 100, 5, 1.0)]
    broken = {0b000: 35, 0b001: 10, 0b011: 50, 0b100: 5}
    assert [r.name for r in quality.ordered(rules, figures, {n: 0.1 for n in names}, broken)] == [names[0], names[2], names[1]]
    assert [r.name for r in quality.ordered(rules, figures)] == names


def test_quality_profile_counts_rules_broken_together(spark, none):
    docs = spark.createDataFrame([("short",), ("# # #",), (" ".join(f"w{i}ord" for i in range(80)),), (None,)], "text string")
    seen = quality.profile(docs, sample_rows=10_000)
    assert sum(seen.broken.values()) == 4 and seen.broken[0] == 1 and {f[0]: f[2] for f in seen.figures}["enough_words"] == 3
    assert all(seconds > 0 for *_, seconds in seen.figures) and set(seen.shared) == {r.name for r in quality.RULES}
    assert quality.profile(none).broken == {} and quality.cascade_for(none, quality.RULES, 10) == quality.RULES


def test_language_held_out(spark, small, edge, none):
    truth = {r["doc_id"]: r["lang"] for r in small.collect()}
    rows = QUERIES["op2_language"](spark, SMALL).collect()
    assert all(r["held_out"] == (held(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
    rows = language.predict(edge).collect()
    assert len(rows) == len(EDGES) and sum(r["lang_pred"] == "und" for r in rows) == 5
    assert language.predict(none).count() == 0
    assert {r["lang_pred"] for r in language.predict(edge.withColumn("lang", edge["lang"].substr(9, 1)).where("lang is null")).collect()} == {"und"}


def test_language_grams():
    found = language.grams("Ab, c").tolist()
    a, b, c = map(ord, "abc")
    pair = lambda x, y: x << 21 | y
    triple = lambda x, y, z: pair(pair(x, y), z)
    assert sorted(found) == sorted([a, b, c, pair(0, a), pair(a, b), pair(b, 0), pair(0, c), pair(c, 0), triple(0, a, b), triple(a, b, 0), triple(0, c, 0)])
    assert language.profile_of(np.array([5, 5, 3, 3, 9])).tolist() == [3, 5, 9]


def test_mixing_on_edges(edge, none, rows):
    found = mixing.mix(edge, rows_per_range=2).collect()
    assert len(found) == len(EDGES) and mixing.mix(none).count() == 0
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix(edge).collect()), key=repr)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    targets = {(r["source_size"], r["target"]) for r in found}  # of four sources, no two alike
    assert abs(sum(r["taken"] for r in found) - sum(t for _, t in targets)) <= 4
    assert mixing.mixed(edge).columns == edge.columns
    table = rows("doc_id long, source string, text string", [(1, "a", "x " * 10), (2, "b", "x " * 100), (3, "c", "x " * 100)])
    assert {r["doc_id"]: r["target"] for r in mixing.mix(table).collect()} == {1: 20.0, 2: 295 / 3 * 2, 3: 295 / 3}


def test_exact_duplicates(edge, none):
    got = sorted(map(tuple, exact.mark(edge, rows_per_shard=2).collect()), key=repr)
    assert got == sorted(exact.brute_force([(i, t) for i, t, _, _ in EDGES]), key=repr)
    kept = exact.drop_duplicates(edge)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {r[1] for r in got if r[3]} and kept.count() == len({r[4] for r in got})
    assert exact.mark(none).count() == 0 and exact.drop_duplicates(none).count() == 0


def test_minimal_perfect_hash():
    digest = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5_000)), np.uint8).reshape(-1, 32)
    levels = exact.build_levels(digest)
    assert sorted(exact.slots_of(digest, levels).tolist()) == list(range(5_000))
    assert exact.slots_of(digest[:3], []).tolist() == [-1, -1, -1]


def test_hmm_base_and_forward(spark, texts, edge, none):
    rows = QUERIES["op6_lm_scoring"](spark, SMALL).collect()
    split = {i: [w.decode() for w in t.encode().lower().split()] + ["\n"] for i, t in texts.items()}
    seen = collections.Counter(w for i, ws in split.items() if held(i, 7) != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for r in rows:
        ws = split[r["doc_id"]]
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(seen[w] > 0 for w in ws), n)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hmm.score(none).count() == 0
    found = hmm.score(edge, n_frequent=5).collect()
    assert len(found) == len(EDGES) and all(r["score"] < 0 for r in found)


def test_hmm_recursions():
    """Scaled forward against the sum over all paths; expected counts against posteriors."""
    rng = np.random.RandomState(1)
    model = tuple(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.rand(2), 0), (rng.rand(2, 2), 1), (rng.rand(3, 2), 0)))
    texts = [np.array(t) for t in ([0, 2, 1], [1], [2, 2, 0, 1])]
    counts = hmm.zeros(3, 2)
    hmm.expected(texts, model, counts)
    want, scores = hmm.zeros(3, 2), []
    for t in texts:
        paths = {}
        for code in range(2 ** len(t)):
            path = [(code >> k) & 1 for k in range(len(t))]
            p = model[0][path[0]] * model[2][t[0], path[0]]
            for a, b, x in zip(path, path[1:], t[1:]):
                p *= model[1][a, b] * model[2][x, b]
            paths[tuple(path)] = p
        total = sum(paths.values())
        scores.append(math.log10(total))
        for path, p in paths.items():
            want[0][path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want[1][a, b] += p / total
            for x, s in zip(t, path):
                want[2][x, s] += p / total
    assert np.allclose(hmm.forward(texts, model), scores)
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(counts, want))


def test_hmm_classes_of_rare_words(spark):
    """Counts by class, the same class in Spark and in Python, and shares that sum to one."""
    counts = {b"a": 9, b"of": 7, b"\n": 6, "é".encode(): 2, b"walking": 2, b"talking": 1, b"xy": 1, "日本語".encode(): 1, b"\xff\xfe": 1, b"": 1}
    vocab = spark.createDataFrame([(bytearray(w), c) for w, c in counts.items()], "word binary, c long")
    top, cut = hmm.frequent(vocab, 3)
    assert top == [(b"a", 9), (b"of", 7), (b"\n", 6)] and cut == 2
    tail = {w: c for w, c in counts.items() if c <= cut}
    n, v = hmm.rare_classes(vocab, cut, 4)
    for k in range(4):
        members = [c for w, c in tail.items() if hmm.class_of(w, 4) == k]
        assert (n[k], v[k]) == (sum(members), len(members))
        assert math.isclose(sum((c + 1) / (n[k] + v[k] + 1) for c in members) + 1 / (n[k] + v[k] + 1), 1)
    assert hmm.class_of(b"walking", 997) == hmm.class_of(b"talking", 997)
    symbols = hmm.Symbols(top, 4)
    found, rare = symbols.of(b"a walking OF new")
    assert rare == [b"walking", b"new"] and found.tolist() == [0, 3 + hmm.class_of(b"walking", 4), 1, 3 + hmm.class_of(b"new", 4), 2]


def test_hmm_score_is_emission_times_share(spark):
    """One state makes the score a product of shares: emission of the symbol, share within its class."""
    docs = spark.createDataFrame([(i, "b a a dog cat" if i % 2 else "a mat") for i in range(40)] + [(100, "a new cat")], "doc_id long, text string")
    rows = hmm.score(docs, states=1, n_frequent=2).collect()
    training = [w for r in docs.collect() if held(r["doc_id"], 7) != 2 for w in [*r["text"].split(), "\n"]]
    seen = collections.Counter(training)
    level = sorted(seen.values(), reverse=True)
    cut = next((c for c in sorted(set(level), reverse=True) if sum(x >= c for x in level) > 2), 1)
    top = [w for w in seen if seen[w] > cut]
    classes = max(1, math.isqrt(len(seen) - len(top)))
    symbol = lambda w: w if w in top else hmm.class_of(w.encode(), classes)
    n, v = collections.Counter(map(symbol, training)), collections.Counter(map(symbol, seen))
    emit = {k: n[k] + hmm.FLOOR for k in [*top, *range(classes)]}
    for r in rows:
        text = next(d["text"] for d in docs.collect() if d["doc_id"] == r["doc_id"])
        want = 0.0
        for w in [*text.split(), "\n"]:
            k = symbol(w)
            want += math.log10(emit[k] / sum(emit.values())) + (0 if w in top else math.log10((seen[w] + 1) / (n[k] + v[k] + 1)))
        assert math.isclose(r["score"], want, rel_tol=1e-4), (text, r["score"], want)


def test_hmm_symbol_probabilities_sum_to_one():
    model = hmm.first_model([np.array([0, 1, 2])] * 3, np.array([3.0, 3, 3, 2]), 2, 3)
    assert np.allclose(model[2].sum(axis=0), 1) and np.allclose(model[1].sum(axis=1), 1) and np.isclose(model[0].sum(), 1)


def test_hmm_rounds_read_symbols(spark, monkeypatch):
    """Texts are split into symbols once; neighbours and rounds read these. Runs of symbols keep every row."""
    frames = []
    monkeypatch.setattr(hmm, "_summed", lambda training, *rest, real=hmm._summed: frames.append(training) or real(training, *rest))
    docs = spark.createDataFrame([(i, f"a b{i} c") for i in range(20)], "doc_id long, text string")
    assert hmm.score(docs, states=2).count() == 20 and len(frames) == 1 + hmm.ROUNDS
    assert all("symbols" in f.columns and "text" not in f.columns and f.count() == sum(held(i, 7) != 2 for i in range(20)) for f in frames)
    batch = pa.record_batch({"symbols": pa.array([[0] * 3, [], [1] * hmm.RUN, [2] * 5, [3]], pa.list_(pa.int32())), "row": pa.array(range(5))})
    found = list(hmm.runs([batch.slice(1), batch.slice(0, 2)]))
    assert [p.column("row").to_pylist() for p, _ in found] == [[1, 2], [3, 4], [0, 1]]
    assert [[len(t) for t in texts] for _, texts in found] == [[0, hmm.RUN], [5, 1], [3, 0]]


def test_hmm_counts_the_neighbours_of_all_documents(spark):
    """The model doesn't depend on how rows are dealt, as one from a sample of them does."""
    classes = np.array([0, 1, hmm.NEIGHBOURS - 2])
    found = hmm.neighbours([np.array([0, 2, 1]), np.array([2]), np.array([0, 1])], classes)
    before, after = found[:, : hmm.NEIGHBOURS], found[:, hmm.NEIGHBOURS :]
    none, other = hmm.NEIGHBOURS - 1, hmm.NEIGHBOURS - 2
    want_before, want_after = np.zeros_like(before), np.zeros_like(after)
    for symbol, c in ((0, none), (2, 0), (1, other), (2, none), (0, none), (1, 0)):
        want_before[symbol, c] += 1
    for symbol, c in ((0, other), (2, 1), (1, none), (2, none), (0, 1), (1, none)):
        want_after[symbol, c] += 1
    assert (before == want_before).all() and (after == want_after).all()
    rng = np.random.default_rng(2)
    words = [f"{'xy'[i % 2]}{j}" for i in range(2) for j in range(40)]
    docs = [(i, " ".join(rng.choice(words[40 * (i % 2) : 40 * (i % 2) + 40], 8))) for i in range(4_000)]
    one, other = (
        {r["doc_id"]: r["score"] for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), states=2).collect()}
        for rows, n in ((docs, 2), (docs[::-1], 5))
    )
    assert all(math.isclose(one[i], other[i], rel_tol=1e-3) for i in one)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [("loser", False, 1.0), ("worthless", False, 1.0), ("abcd", False, 1.0), ("lowei", True, 1.0)]
    lexicon, rng = toxicity.Lexicon(terms), random.Random(3)
    for _ in range(3_000):
        word = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "e", "s"])
        word = "".join(word) + rng.choice(["", "", "x"])
        near_ones = [(distance(word, t), i) for i, (t, stem, _) in enumerate(terms) if not stem and distance(word, t) <= toxicity.edits_for(len(t))]
        near_ones += [(0, i) for i, (t, stem, _) in enumerate(terms) if stem and word.startswith(t)]
        best = min(near_ones, default=None)
        assert lexicon.match(word) == (None if best is None else (best[1], best[0])), word


def test_toxicity_context_and_edges(spark, edge, none, rows):
    matcher = toxicity.Matcher([("idiot", False, 5.0)])
    plain, quoted, addressed = (matcher.evidence(t.encode()) for t in ("he is an idiot", 'he said "idiot" there', "you idiot"))
    assert plain == (5.0, 0.0) and quoted[1] == 5.0 and quoted[0] < plain[0] < addressed[0]
    assert matcher.evidence(None) == (0.0, 0.0) and 0 < matcher.evidence(b"an idiott")[0] < 5
    labels = rows("doc_id long, quality int, toxic int", [(1, 1, 0), (2, 1, 1), (3, 1, 1), (99, 1, 1), (4, 1, None)])
    assert toxicity.score(edge, labels).count() == len(EDGES) and toxicity.score(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.score(edge, labels.limit(0)).collect()} == {0}


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert all(held(r["doc_id"], 5) == 0 for r in rows) and sum(r["predicted"] == toxic[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_toxicity_misspelt_words_of_a_chosen_stem(spark):
    """Singular and plural in toxic texts: their stem ranks first, both words keep their edits."""
    rng = random.Random(9)
    noise = lambda: " ".join("".join(rng.choice("bcdfgklmnpr") for _ in range(9)) for _ in range(30))
    insults = ["idiot"] * 60 + ["idiots"] * 5
    docs = [(i, f"{noise()} {insults[i]} {noise()}") for i in range(65)] + [(i, noise()) for i in range(65, 265)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 65)) for i, _ in docs], "doc_id long, toxic int")
    terms, _ = toxicity.learn(frame, labels, 5, -2)
    assert any(stem and "idiots".startswith(term) for term, stem, _ in terms) and {"idiot", "idiots"} <= {term for term, stem, _ in terms if not stem}
    lexicon = toxicity.Lexicon(terms)
    assert all(lexicon.match(word)[1] == 1 for word in ("idi0t", "ibiot", "ibiots")) and lexicon.match("idiotic")[1] == 0


def test_toxicity_terms_joined_inside_tokens():
    matcher = toxicity.Matcher([("idiot", False, 5.0), ("stupid", False, 4.0), ("scum", False, 3.0), ("ass", False, 2.0), ("白痴", False, 6.0), ("stup", True, 4.0)])
    cases = [("l'idiot", 5), ("idiot/loser", 5), ("stupid-clown", 4), ("trash,scum", 3), ("x idiot/scum", 8), ("dumb-ass", 2), ("滚开！白痴。", 6), ("(idi0t)", 2.5), ("x/idi0t", 2.5), ("stupidly-x", 4), ("fass as", 0)]
    assert [matcher.evidence(text.encode())[0] for text, _ in cases] == [want for _, want in cases]


def test_toxicity_learns_short_terms_and_all_of_them(spark):
    """More than 300 terms, those of under four letters among them."""
    letters = "bcdfghklmnprstvwz"
    terms = [a + b + c for a in letters[:8] for b in "aeiou" for c in letters[:9]]
    docs = [(i, " ".join(f"{t}/" for t in terms[k * 36 : k * 36 + 36]) + f" q{i}") for i, k in enumerate(k for k in range(10) for _ in range(12))]
    docs += [(i, f"good day to all q{i}") for i in range(120, 720)]
    frame = spark.createDataFrame([(i, t, int(i < 120)) for i, t in docs], "doc_id long, text string, toxic int")
    assert {t for t, _, _ in toxicity.choose(*toxicity.candidates(frame, 120, 600))} >= set(terms) and len(set(terms)) == 360


def test_near_duplicates(spark, texts, edge, none):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op9_near_dedup"](spark, SMALL).collect()}
    assert got == {x[0]: x for x in near.brute_force(list(texts.items()))}
    rows = near.mark(edge).collect()
    assert len(rows) == len(EDGES) and sorted({r["component_id"] for r in rows if r["n_shingles"] == 4}) == [1]
    assert near.drop_duplicates(edge).columns == edge.columns and near.mark(none).count() == 0


def test_near_group_around_a_template(spark):
    """Copies of one text with a few changed words each, many not similar enough to the first."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = [(100, " ".join(base))]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"c{rng.randrange(4)}" if i % 2 else f"n{rng.random()}"
        docs.append((i, " ".join(words)))
    got = {r["doc_id"]: tuple(r) for r in near.mark(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {x[0]: x for x in near.brute_force(docs)}


def test_near_groups_with_links_inside(spark):
    """Copies of two templates with few to many edits, and copies of those: links of every kind of weight."""
    rnd = random.Random(77)
    docs = []
    for template in range(2):
        words = [f"t{template}w{i}" for i in range(90)]
        for _ in range(130):
            own = list(words)
            for i in rnd.sample(range(90), rnd.choice([0, 1, 2, 3, 4, 6, 8, 12])):
                own[i] = rnd.choice(["", f"v{rnd.randrange(6)}", f"n{rnd.randrange(10**6)}"])
            docs.append(own)
            if rnd.random() < 0.4:
                again = list(own)
                for i in rnd.sample(range(90), rnd.choice([1, 2, 3])):
                    again[i] = f"v{rnd.randrange(40)}"
                docs.append(again)
    rnd.shuffle(docs)
    docs = [(i, " ".join(w for w in d if w)) for i, d in enumerate(docs)]
    got = {r["doc_id"]: tuple(r) for r in near.mark(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {x[0]: x for x in near.brute_force(docs)}
    assert got == want and 2 < len({x[2] for x in want.values()}) < len(docs) - 50


@pytest.mark.parametrize("shape", ["changed", "passage"])
def test_near_pairs_of_unlinked_copies_stay_level(spark, monkeypatch, shape):
    """Copies about half alike, no two of them linked: the sets compared follow the number of documents."""
    compared = []
    monkeypatch.setattr(near, "_compared", lambda pairs, sets, real=near._compared: real(compared.append(near.materialize(pairs, "pairs")) or compared[-1], sets))
    per_document = []
    for n in (100, 400):
        rnd, compared[:] = random.Random(8), []
        base = [f"b{i}" for i in range(200)]
        docs = []
        for d in range(n):
            words = list(base)
            if shape == "changed":
                for i in rnd.sample(range(200), 9):
                    words[i] = f"n{rnd.randrange(10**9)}"
            else:
                words[120:] = [f"n{rnd.randrange(10**9)}" for _ in range(90)]
            docs.append((d, " ".join(words)))
        rows = near.mark(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert all(r["kept"] for r in rows)
        per_document.append(sum(c.count() for c in compared) / n)
    assert per_document[1] < 1.5 * per_document[0] + 1 and per_document[1] < 70


def test_near_pairs_of_two_groups(spark):
    """Documents around a shared passage that the first of a bucket may not resemble, with links among them."""
    rnd = random.Random(31)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for d in range(150):
        own = [f"o{d}x{i}" for i in range(rnd.randrange(30, 110))]
        docs.append(passage + own)
        if d % 3 == 0:
            again = list(docs[-1])
            again[rnd.randrange(len(again))] = f"z{d}"
            docs.append(again)
    rnd.shuffle(docs)
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = {r["doc_id"]: tuple(r) for r in near.mark(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {x[0]: x for x in near.brute_force(docs)}


def test_near_counts_are_looked_up_once_for_a_group(spark, monkeypatch):
    """Two groups of copies around one passage: shingles that both groups hold are joined with
    their counts once for a group, not for each copy, and links across groups are found."""
    from pyspark.sql import functions as F

    rows = {}
    monkeypatch.setattr(near, "materialize", lambda df, name, real=near.materialize: rows.update({name: (kept := real(df, name)).count()}) or kept)
    rnd = random.Random(12)
    sets, groups, held = [], 40, 60
    for g in range(2):
        template = [f"t{i}" for i in range(held)] + [f"g{g}x{i}" for i in range(15)]
        for c in range(groups):
            own = list(template)
            own[rnd.randrange(len(own))] = f"n{g}x{c}"
            sets.append((g, own))
    docs = [(i, " ".join(w)) for i, (_, w) in enumerate(sets)]
    frame = near.signatures(spark.createDataFrame(docs, "doc_id long, text string"))
    heads = frame.select(F.col("doc_id").alias("cls"), "n_shingles", "sketch")
    full = spark.createDataFrame([(i, [int(h) for h in x.view("int64")]) for i, x in enumerate(near.shingle_sets([t.encode() for _, t in docs]))], "cls long, hashes array<long>")
    rest = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(sets)], "cls long, grp long")
    labels = spark.createDataFrame([], "node long, label long")
    found = {tuple(sorted(r)) for r in near._rest_pairs(rest, heads, labels, full).collect()}
    hashes = {r["cls"]: set(r["hashes"]) for r in full.collect()}
    linked = {(a, b) for a in range(groups) for b in range(groups, 2 * groups) if 10 * len(hashes[a] & hashes[b]) >= 8 * len(hashes[a] | hashes[b])}
    assert linked <= found and all(sets[a][0] != sets[b][0] for a, b in found)
    assert rows["near-shared"] <= 4 * held


def test_near_members_of_a_group_travel_with_its_counts(spark, monkeypatch):
    """What over half of a group holds is found without a join of its shingles with its size, once."""
    plans = {}

    def kept(df, name, real=near.materialize):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(near, "materialize", kept)
    shared = [f"t{i}" for i in range(60)]
    docs = [(10 * g + c, " ".join([*shared, *(f"g{g}x{i}" for i in range(4)), f"n{g}x{c}"])) for g in range(2) for c in range(3)] + [(90, " ".join([*shared, "u1 u2 u3"]))]
    frame = near.signatures(spark.createDataFrame(docs, "doc_id long, text string")).localCheckpoint()
    sets = spark.createDataFrame([(i, [int(h) for h in near.shingle_sets([t.encode()])[0].view("int64")]) for i, t in docs], "cls long, hashes array<long>")
    rest = spark.createDataFrame([(i, i // 10) for i, _ in docs], "cls long, grp long")
    found = near._rest_pairs(rest, frame.select(frame.doc_id.alias("cls"), "n_shingles", "sketch"), spark.createDataFrame([], "node long, label long"), sets)
    hashes = {r["cls"]: set(r["hashes"]) for r in sets.collect()}
    linked = {(a, b) for a in hashes for b in hashes if a < b and a // 10 != b // 10 and 10 * len(hashes[a] & hashes[b]) >= 8 * len(hashes[a] | hashes[b])}
    assert linked and linked <= {tuple(sorted(r)) for r in found.collect()}
    assert len(plans["near-common"]) == 1 and "Join" not in plans["near-common"][0]


def test_components_of_a_path(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (900, 901)], "a long, b long")
    labels = {r["node"]: r["label"] for r in near.components(links).collect()}
    assert len(labels) == 202 and len({labels[i] for i in range(200)}) == 1 and labels[900] == labels[901] != labels[0]


def test_bpe_equals_library(texts, edge, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    coder = bpe.Encoder(open(VOCABULARY, encoding="utf-8").read())
    rng = random.Random(4)
    cases = [t for t in texts.values()][:60] + [t or "" for _, t, _, _ in EDGES]
    cases += ["a<|endoftext|> b<|endoftext|><|endoftext|>", " \n\n  x \t\r\n", "don't I'll", "x" * 3_000, " " * 2_000 + "y", "\x1c\x85᠎​﻿ a", "՘Ᲊ֋1"]
    cases += ["".join(rng.choice("abcdeth ing\n.,'s12 é") for _ in range(rng.randrange(120))) for _ in range(200)]
    cases += ["".join("a" + chr(c) + "1 " + chr(c) for c in range(low, low + 64)) for low in range(0x80, 0xD800, 4_096)]
    for text in cases:
        pieces = coder.pieces(text)
        coder.learn(set(pieces))
        want = library.encode(text, add_special_tokens=False).ids
        assert ",".join(coder.words[w][0] for w in pieces) == ",".join(map(str, want))
        assert coder.decode(want).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)
    rows = bpe.encode(edge, VOCABULARY).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in rows) == sorted((i or 0, t or "") for i, t, _, _ in EDGES)
    assert bpe.digests(none, VOCABULARY).count() == 0


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts_add_up(rule, edge, none):
    total = {(r["doc_id"], r["n_tokens"]) for r in bpe.encode(edge, VOCABULARY).collect()}
    assert {(r["doc_id"], r["n_tokens"]) for r in tokens.by_document(edge, VOCABULARY, rule).collect()} == total
    sums = collections.Counter()
    for r in tokens.by_section(edge.where("doc_id <> 2"), VOCABULARY, rule).collect():
        sums[r["doc_id"]] += r["n_tokens"]
    assert all(math.isclose(sums[i], n) for i, n in total if n and i not in (None, 2))
    assert tokens.by_section(none, VOCABULARY, rule).count() == 0


def test_token_rules_at_borders():
    starts = tokens.line_starts(b"ab\ncd")
    assert starts.tolist() == [0, 3]
    ends = np.array([1, 4, 5])  # a | b\nc | d
    assert tokens.allocate(ends, starts, "start")[0].tolist() == [2, 1] and tokens.allocate(ends, starts, "end")[0].tolist() == [1, 2]
    assert np.allclose(tokens.allocate(ends, starts, "share")[0], [1 + 2 / 3, 1 + 1 / 3])


def by_offsets(library, text, rule):
    """Tokens of each line of a text, and those that cross a border, from the library's offsets in characters."""
    at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(int)
    lines = [len(line.encode()) for line in re.findall(r"[^\n]*\n|[^\n]+", text)]
    owner = np.repeat(np.arange(len(lines)), lines)
    counts, crossing = np.zeros(len(lines)), 0
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        of = owner[at[a] : at[b]]
        crossing += of[0] != of[-1]
        for section, share in zip(*np.unique(of, return_counts=True)):
            counts[section] += share / len(of) if rule == "share" else section == (of[-1] if rule == "end" else of[0])
    return lines, counts, crossing


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_equal_library_offsets(spark, small, texts, rule):
    """Rows of the query, and of its digest, against the library; texts of ASCII, where offsets in characters cut no token."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    found = QUERIES["op7_token_counts"](spark, SMALL) if rule == "start" else tokens.by_section(small, VOCABULARY, rule)
    rows, digests = collections.defaultdict(list), {r["doc_id"]: r for r in tokens.by_document(small, VOCABULARY, rule).collect()}
    for r in found.orderBy("doc_id", "section").collect():
        rows[r["doc_id"]].append(r)
    assert len(digests) == len(texts) and set(rows) == {i for i, t in texts.items() if t}
    tested = [(i, t) for i, t in texts.items() if t and t.isascii()]
    assert len(tested) > 20 and sum("\n" in t for _, t in tested) > 10
    for i, text in tested:
        lines, counts, crossing = by_offsets(library, text, rule)
        assert [(r["section"], r["first_byte"], r["n_bytes"]) for r in rows[i]] == [(k, sum(lines[:k]), n) for k, n in enumerate(lines)]
        assert np.allclose([r["n_tokens"] for r in rows[i]], counts)
        d = digests[i]
        assert (d["n_sections"], d["n_crossing"]) == (len(lines), crossing) and math.isclose(d["largest_tokens"], counts.max()) and math.isclose(d["n_tokens"], counts.sum())
        assert math.isclose(rows[i][d["largest"]]["n_tokens"], counts.max())


PII = "Mail Ann.Lee@mail1.example.com or ann.lee@mail1.example.com, call +1 (017) 555-7713, from 97.51.17.173, card 4539 1488 0343 6467, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Frau Müller met Mr. John Smith; Ms Smith left."


def test_surrogates(spark, edge, none):
    docs = spark.createDataFrame([(1, PII, "k"), (2, "Again ann.lee@mail1.example.com.", "k"), (3, None, "k"), (4, "plain", "k"), (4, "plain", "k")], "doc_id long, text string, kind string")
    rows = sorted(surrogates.replace(docs, "secret").collect(), key=lambda r: r["doc_id"])
    text = rows[0]["text"]
    for gone in ("Lee", "lee@", "555-7713", "97.51", "4539 1488", "04dbeb", "Müller", "Smith", "John"):
        assert gone not in text
    kinds = [k for k, *_ in surrogates.find(PII)]
    assert [k for k, *_ in surrogates.find(text)] == kinds and rows[0]["n_entities"] == len(kinds) == 10
    mails = [text[a:b].lower() for k, _, a, b in surrogates.find(text) if k == "email"]
    assert mails[0] == mails[1] and mails[0] in rows[1]["text"]  # coreference
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", text).group(1)
    assert surrogates.luhn(card.replace(" ", "")) == 0 and "+1 (" in text
    families = re.findall(r"(?:Frau|Mr\. \w+|Ms) (\w+)", text)
    assert families[1] == families[2] != families[0]
    assert (rows[2]["text"], rows[3]["text"], rows[3]["n_entities"]) == (None, "plain", 0) and len(rows) == 5
    assert surrogates.replace(edge, "secret").columns == [*edge.columns, "n_entities"] and surrogates.replace(none, "secret").count() == 0


def test_surrogates_of_untitled_mentions(spark):
    """By surname or given name only, with an ending, before the title, in capitals, in other scripts; not inside other words or in lower case."""
    cases = [
        ("Mr. John Smith came. Smith left, John stayed.", ["john", "smith", "smith", "john"]),
        ("Smith's car: Mr Smith's, SMITH, O'Brien-Smith, Smithson, smith, Smith2 (Smith)", ["smith"] * 5),
        ("Frau O’Hara-Lee und Lee; O'Hara-Lee, O'Hara", ["o'hara-lee", "o'hara-lee"]),
        ("Mr. Kim Lee, Ms. Lee Kim. Kim", ["kim", "lee", "lee", "kim", "kim"]),
        ("Господин Иванов ушёл. Иванов, мистер", ["иванов", "иванов"]),
        ("Mr. Smith: smith@x.org, Smith@x.org", ["smith", "smith@x.org", "smith@x.org"]),
        ("Smith and John", []),
    ]
    for text, want in cases:
        assert [e for _, e, _, _ in surrogates.find(text)] == want, text
    assert [k for k, *_ in surrogates.find(cases[3][0])] == ["name-given-m", "name-family", "name-given-f", "name-family", "name-family"]
    rows = surrogates.replace(spark.createDataFrame([(1, cases[0][0]), (2, "Smith met John")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    given, family, again, last = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) left, (\w+) stayed\.", rows[0]["text"]).groups()
    assert (given, family) == (last, again) and not {given, family} & {"John", "Smith"} and rows[0]["n_entities"] == 4
    assert (rows[1]["text"], rows[1]["n_entities"]) == ("Smith met John", 0)  # no title in this text


def test_surrogate_collisions_are_resolved(spark, monkeypatch):
    """Entities of a narrow format: 200 of the 254 to the fourth addresses are forced onto few draws."""
    real = surrogates.draw
    monkeypatch.setattr(surrogates, "draw", lambda key, kind, entity, attempt: f"s{int(hashlib.sha256(f'{entity}{attempt}'.encode()).hexdigest(), 16) % 150}" if attempt < 20 else real(key, kind, entity, attempt))
    entities = spark.createDataFrame([("ip", f"s{i}" if i < 5 else f"e{i}") for i in range(100)] * 2, "kind string, entity string")
    rows = surrogates.assign(entities, b"k").collect()
    names = {r["entity"] for r in rows}
    assert len(rows) == 100 == len({r["replacement"] for r in rows}) and not names & {r["replacement"] for r in rows}


def test_pipeline_against_brute_force(spark, small, texts):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    source = {r["doc_id"]: r["source"] for r in small.collect()}
    good = {i: t for i, t in texts.items() if quality.keeps(quality.Measures(t.encode()), quality.RULES)}
    once = {r[0]: good[r[0]] for r in exact.brute_force(list(good.items())) if r[3]}
    apart = [r[0] for r in near.brute_force(list(once.items())) if r[3]]
    size = {i: len(WORD.findall(texts[i])) for i in apart}
    total = collections.Counter()
    for i in apart:
        total[source[i]] += size[i]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    target, left = {}, set(total)
    while True:  # sources that would be above their bound are closed, the rest is shared anew
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in total if s not in left)) / sum(weights[s] for s in left)
        above = {s for s in left if level * weights[s] > 2 * total[s]}
        if not above:
            break
        left -= above
    target = {s: level * weights[s] if s in left else 2 * total[s] for s in total}
    want = collections.Counter()
    for s in total:
        budget = round(target[s])
        epochs, at = budget // total[s], 0
        for i in sorted((i for i in apart if source[i] == s), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            part = max(0, min(size[i], budget - epochs * total[s] - at))
            at += size[i]
            want[i] += math.ceil((epochs * size[i] + part) / size[i])
    rows = pipeline.run(spark, SMALL).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == +want
    assert all(r["decoded"] == texts[r["doc_id"]] for r in rows)
