"""Ordinary and odd rows that operators once got wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from toolmill.llm import exact, mixing, surrogates, tokens
from toolmill.llm.queries import VOCABULARY

LARGEST = (1 << 63) - 1


@pytest.mark.parametrize(("text", "kinds"), [
    ("Built 2024-01-15 in 1914-1918.", []), ("12.05.2020 10 000 000", []), ("call 555-123-4567 on 2024-01-15", ["phone"]), ("15/03/1999, 1.234.567 euros, 2019/2020", []),
    ("SSN 123-45-6789", ["ssn"]), ("at 00:1A:2b:3C:4d:5E", ["mac"]), ("2001:db8::ff00:42:8329 and fe80:0:0:0:0:0:0:1, std::vector", ["ip6", "ip6"]),
    ("fe80::1 up, std::vector, x[1::2]: a: b:", ["ip6"]),
    ("Dr. Jane Doe came", ["name-given-n", "name-family"]), ("(030) 123 456, 020 123 456 789", ["phone", "phone"]),
])
def test_what_is_an_entity(text, kinds):
    assert [k for k, *_ in surrogates.find(text)] == kinds


def test_surrogates_of_new_kinds_keep_their_format(spark):
    docs = spark.createDataFrame([(1, "123-45-6789 00:1A:2B:3C:4D:5E 2001:db8::ff00:42:8329 Dr. Jane Doe")], "doc_id long, text string")
    (row,) = surrogates.replace(docs, "k").collect()
    ssn, mac, ip6, title, given, family = row["text"].split()
    import re

    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and re.fullmatch(r"(?:[0-9A-F]{2}:){5}[0-9A-F]{2}", mac) and re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4}", ip6)
    assert title == "Dr." and given.isalpha() and family.isalpha() and row["n_entities"] == 5


def test_a_full_format_gets_longer_replacements(spark):
    """All ten one-digit numbers are entities: none is free, and no exception is raised."""
    entities = spark.createDataFrame([("phone", str(i)) for i in range(10)], "kind string, entity string")
    made = {r["entity"]: r["replacement"] for r in surrogates.assign(entities, b"k").collect()}
    assert len(made) == len(set(made.values())) == 10 and not set(made.values()) & set(made) and all(v.isdigit() and len(v) > 1 for v in made.values())
    assert surrogates.fitted("57", "phone", "3") == "57"


def test_given_and_family_names_stay_apart(spark, monkeypatch):
    real = surrogates.draw
    monkeypatch.setattr(surrogates, "draw", lambda key, kind, entity, attempt: "same" if attempt == 0 else real(key, kind, entity, attempt))
    entities = spark.createDataFrame([("name-family", "smith"), ("name-given-m", "smith"), ("name-given-f", "ann")], "kind string, entity string")
    assert len({r["replacement"] for r in surrogates.assign(entities, b"k").collect()}) == 3


def test_mixing_reruns_agree_without_ids(spark):
    """A third of all rows has no id, ids repeat with other texts: any partitioning gives the same amounts."""
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i // 2, "w " * rng.randrange(30), f"s{i % 4}") for i in range(900)] + [(None, "same text here", "s1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(tuple, mixing.mix(d, rows_per_range=25).collect()), key=repr) for d in (docs.repartition(7), docs.orderBy(F.desc("text")).coalesce(2))]
    assert runs[0] == runs[1]
    targets = {r["source"]: r["target"] for r in mixing.targets(mixing.sized(docs)).collect()}
    assert sum(r[4] for r in runs[0]) == sum(round(t) for t in targets.values())
    sized = mixing.sized(docs).where("doc_id IS NULL").select("key").distinct().count()
    assert sized > 20  # rows without an id don't share one key


def test_the_largest_id_is_an_id(spark):
    rows = [(LARGEST, "only"), (LARGEST, "twice"), (5, "twice"), (None, "nobody"), (None, "nobody"), (None, "someone"), (LARGEST, "someone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for per_shard in (20_000, 1):
        assert sorted(map(tuple, exact.mark(docs, per_shard).collect()), key=repr) == sorted(exact.brute_force(rows), key=repr)
    assert sorted(r["text"] for r in exact.drop_duplicates(docs).collect()) == ["nobody", "only", "someone", "twice"]


TEXTS = ["é😀\nü ﷽\n\n日本語のテキスト\nab", None, "", "\n", "naïve café\r\nÆØÅ 😀😀\n" * 20, "x" * 50_000 + "\n" + "é" * 3_000, "plain words\nmore words\n\n", "<|endoftext|>\nü"]


@pytest.mark.parametrize("rule", ["start", "end"])
def test_token_sections_equal_the_library(spark, rule):
    """Multi-byte texts: each token goes to the line of its first or last byte, by the library's own offsets."""
    library = Tokenizer.from_file(VOCABULARY)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["section"]): (r["first_byte"], r["n_bytes"], r["n_tokens"]) for r in tokens.by_section(docs, VOCABULARY, rule).collect()}
    expected = {}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        if not raw:
            continue
        starts = [0] + [k + 1 for k, c in enumerate(raw) if c == 10 and k + 1 < len(raw)]
        lengths = [len(library.decode([t], skip_special_tokens=False).encode()) if "�" not in library.decode([t], skip_special_tokens=False) else None for t in library.encode(text, add_special_tokens=False).ids]
        table = {c: b for b, c in enumerate_bytes().items()}
        lengths = [n if n is not None else len([table[c] for c in library.id_to_token(t)]) for n, t in zip(lengths, library.encode(text, add_special_tokens=False).ids)]
        ends = np.cumsum(lengths)
        at = ends - 1 if rule == "end" else ends - lengths
        owner = np.searchsorted(starts, at, "right") - 1
        for s, (a, b) in enumerate(zip(starts, [*starts[1:], len(raw)])):
            expected[i, s] = (a, b - a, float((owner == s).sum()))
    assert got == expected


def enumerate_bytes():
    """The printable character that stands for each byte in the vocabulary's tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
