"""Shards and spelling variants against brute force, with their edge rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from toolmill.llm import sharding, variants
from toolmill.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, shard string, range long, word string, h long, n long"


@pytest.fixture
def docs(spark):
    """Texts under columns with names the operators use themselves."""
    return lambda rows: spark.createDataFrame([(i, t, "x", 7, "w", 5, 3) for i, t in rows], DDL)


def check_shards(rows, result, shards):
    got = [r.asDict() for r in result.collect()]
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, got


def test_shards_of_the_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sizes, got = check_shards(rows, QUERIES["op12_sharding"](spark, "/root/testdata/sf0.01"), 24)
    share, largest = sum(sizes.values()) / 24, max(r["size"] for r in got)
    assert all(abs(s - share) <= largest + 0.02 * share for s in sizes.values()) and len(sizes) == 24
    again = QUERIES["op12_sharding"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_shards_of_odd_rows(docs):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (None, None), (3, ""), (4, "é😀 " * 20_000), (5, "a b")]
    check_shards(rows, sharding.shard(docs(rows)), 24)
    assert sharding.shard(docs([])).count() == 0


def test_a_hot_text_is_many_ranges_and_shards(docs):
    """A third of all rows is one text without an id: its ranges are subdivided and its shards stay level."""
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(2_000)] + [(None, "the same words")] * 1_000
    sizes, _ = check_shards(rows, sharding.shard(docs(rows), shards=6, rows_per_range=50, fan=4, draws=8), 6)
    share = sum(sizes.values()) / 6
    assert all(abs(s - share) <= 0.02 * share + 100 for s in sizes.values())
    ranged = sharding.ranged(sharding.keyed(docs(rows)), rows_per_range=50, fan=4, draws=8)
    assert max(r["count"] for r in ranged.groupBy("range").count().collect()) <= 50
    placed = [r for r in ranged.select("range", F.struct("h", "k", "row").alias("key")).collect()]
    by_key = [r["range"] for r in sorted(placed, key=lambda r: tuple(r["key"]))]
    assert by_key == sorted(by_key)  # ranges are in key order


def test_small_groups_stay_whole(docs):
    rows = [(10 * i + j, f"document {i}") for i in range(400) for j in range(3)]
    got = sharding.shard(docs(rows), shards=8, whole=0.05).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    rows = [(i, f"t{i}" * 9) for i in range(200)] + [(None, "same")] * 100
    name = sharding.write_shards(docs(rows), str(tmp_path / "out"), shards=4, whole=0)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    assert back.where("shard = 'x'").count() == 300
    counts = [r["b"] for r in back.groupBy(name).agg(F.sum(F.octet_length("text") + 8).alias("b")).collect()]
    assert len(counts) == 4 and max(counts) < 1.3 * min(counts)
    empty = sharding.write_shards(docs([]), str(tmp_path / "none"))
    assert empty == "shard_"


def test_variants_of_the_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, SMALL).collect())) == sorted(variants.brute_force(rows))


def misspelt():
    rng, rows = random.Random(3), []
    for length in (7, 8, 9, 10, 12, 63, 64, 65, 66):
        w = "".join(rng.choice("abé") for _ in range(length))
        rows += [(len(rows), w + " x")] * 12
        for _ in range(8):
            j = rng.randrange(length)
            v = rng.choice([w[:j] + w[j + 1 :], w[:j] + "b" + w[j:], w[:j] + "a" + w[j + 1 :]])
            rows += [(len(rows), v), (len(rows) + 1, v.upper())]
    long = "ab" * 3_000
    return rows + [(i, long) for i in range(25)] + [(7, long[1:])] * 2 + [(None, long + "c")] * 2 + [(8, None), (9, ""), (10, "!?"), (11, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ àÀÀÀÀÀÀ")]


@pytest.mark.parametrize("longest", [64, 8])
def test_variants_of_words_of_any_length(docs, longest):
    """Replacements, insertions, deletions, runs of equal letters, ties; long words by digests."""
    rows = misspelt()
    got = variants.variants(variants.words(docs(rows)), longest=longest).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(variants.brute_force(rows), key=repr)
    assert any(r["form"] for r in got)


def test_roots_follow_chains(spark):
    counted = spark.createDataFrame([("abcdefg", 3), ("abcdefgh", 40), ("abcdefghi", 500), ("zzzzzzz", 2)], "word string, n long")
    roots = {r["word"]: (r["form"], r["root"]) for r in variants.variants(counted).collect()}
    assert roots == {"abcdefg": ("abcdefgh", "abcdefghi"), "abcdefgh": ("abcdefghi", "abcdefghi"), "abcdefghi": (None, "abcdefghi"), "zzzzzzz": (None, "zzzzzzz")}


def test_no_words(docs):
    assert variants.group_spellings(docs([])).count() == 0 == variants.group_spellings(docs([(1, None), (2, "short")])).count()
