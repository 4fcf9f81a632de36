"""Ranked search against SQL and brute force, with its edge rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from toolmill.llm import search
from toolmill.llm.queries import QUERIES

DDL = "doc_id long, text string, shard long, row long, terms string, item string, rank int"
WORDS = [f"w{i}" for i in range(60)] + ["Über", "日本語", "A1b2"]


@pytest.fixture
def docs(spark):
    """Texts under columns with names the operator uses itself."""
    return lambda rows: spark.createDataFrame([(i, t, 1, 2, "x", "y", 9) for i, t in rows], DDL)


def some(n, seed=5):
    rng = random.Random(seed)
    weights = [1 / (1 + i) for i in range(len(WORDS))]
    return [(i, " ".join(rng.choices(WORDS, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]


ODD = [(5, "w1 w2, W3."), (5, "w1 w2, W3."), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, "--- !?"), (903, "日本語 über ÜBER"), (904, "w1 " * 40_000 + "w2")]
ITEMS = [(1, "w1 W1 w50"), (2, "Über ÜBER 日本語"), (None, "w2"), (1, "w59 w58 w57"), (3, None), (4, ""), (5, "nothing here matches"), (6, " ".join(WORDS))]


def same(got, expected):
    key = lambda rows: sorted(((i, rank, d, s) for i, rank, d, s in map(tuple, rows)), key=repr)
    assert key(got) == key(expected)


@pytest.mark.parametrize(("postings", "k", "terms"), [(1 << 20, 50, 50_000), (1_000, 7, 50_000), (3_000, 3, 4)])
def test_odd_rows_shards_and_item_sets(spark, docs, postings, k, terms):
    rows, items = some(1_500) + ODD, spark.createDataFrame([(i, t, 7) for i, t in ITEMS], "item_id long, text string, doc_id int")
    same(search.search(docs(rows), items, k, postings, terms).collect(), search.brute_force(rows, ITEMS, k))


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    found = search.search(docs(some(20)), items.limit(0))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(docs([]), items).count() == 0 == search.search(docs([(1, None)]), items).count()


def shard_tables(rows, items):
    vocabulary, numbered = {}, []
    for _, text in items:
        numbered.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in sorted(set(search.terms_of(text.encode())))], np.int64))
    counted = [(i, search.terms_of(t.encode())) for i, t in rows]
    held = {"doc_id": [i for i, _ in counted], "n": [len(w) for _, w in counted], "row": list(range(len(rows))), "shard": [0] * len(rows)}
    pairs = [np.unique([vocabulary[w] for w in words if w in vocabulary], return_counts=True) for _, words in counted]
    table = pa.table(held | {"terms": pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), "tf": pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32()))})
    df = np.bincount(np.concatenate([p[0] for p in pairs]).astype(np.int64), minlength=len(vocabulary))
    figures = {"documents": len(rows), "total": sum(held["n"]), "coordinate": search.coordinates(df), "weights": np.array([search.weight(x, len(rows)) for x in df.tolist()]), "items": numbered, "k": 10, "floors": {}}
    return table, figures


def test_blocks_cover_lists_and_bounds_hold():
    """Every posting is in one block of its term, no block is over its size, summaries bound every score, and blocks are skipped."""
    rng = random.Random(1)
    topics = [rng.sample([f"t{i}" for i in range(400)], 25) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(rng.choice(topics), k=40))) for i in range(4_000)]
    items = [(i, " ".join(rng.sample(topics[i], 8))) for i in range(10)]
    table, figures = shard_tables(rows, items)
    blocks = search.build_blocks(table, figures)
    shard = search.Shard(table, figures["documents"], figures["total"])
    listed = sorted((t, d) for t, docs in zip(blocks["term"].to_pylist(), blocks["docs"].to_pylist()) for d in docs)
    assert listed == sorted(zip(shard.terms.tolist(), shard.owner.tolist()))
    assert max(len(d) for d in blocks["docs"].to_pylist()) <= search.BLOCK
    summary = np.array([np.frombuffer(s, np.uint8) for s in blocks["summary"].to_pylist()], np.int64)
    for terms in figures["items"]:
        own = np.zeros(len(figures["weights"]), np.int64)
        own[terms] = figures["weights"][terms]
        asked = np.zeros(search.WIDTH, np.int64)
        np.add.at(asked, figures["coordinate"][terms], own[terms])
        for block, docs in zip(summary, blocks["docs"].to_pylist()):
            assert (shard.scores(np.array(docs), own) <= (block * search.UNIT) @ asked).all()
    seen: list = []
    found = search.search_shard(blocks, table, figures, seen)
    same([(i, 0, d, s) for i, d, s in zip(*(found[c].to_pylist() for c in ("item", "doc_id", "score")))], [(i, 0, d, s) for i, _, d, s in search.brute_force(rows, items, 10)])
    assert sum(read for _, read in seen) < 0.7 * sum(all_blocks for all_blocks, _ in seen)


def test_the_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    same(QUERIES["op11_lexical_search"](spark, folder).collect(), search.brute_force(rows, items))
