"""Spelling variants by permuterm rotations.

A word's rotations are those of the word with an end mark. A rotation without its last
character is a prefix that skips one character of the word, at every place once; a
whole rotation is what is left of any longer word whose skipped character is not there.
So all words at one replacement from each other share such a prefix, and a word with a
character more shares it with the whole rotation of the word without. Rotations are
sorted by that prefix; each prefix range is a group, and a group holds at most one word
per character of the alphabet and one whole rotation, however large the corpus. Scans
of the groups emit, for every word in them, how many neighbours it has there and the
best one. Deleting any character of a run of equal ones gives the same word, so only the
run's first counts, and every pair of words meets in exactly one group.

Words are counted before anything else, per task and then over all, so that a common
word is one row. Roots are found by doubling: each round replaces a word's root by that
root's own, and frequencies rise tenfold along a chain, so rounds are few.

Defined results: a null text has no words; a null id reads as the empty string in the
noise rule; rows that repeat an id are counted each; a text without blanks is one long run, and a
word of over ``LONG`` characters stands in its rotations by digests, so that their rows
stay small (its time still grows with the square of its length); no rows in, no rows
out. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolmill.session import materialize

LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST = 7, 2
FACTOR = 10
NOISE = 31
LONG = 64
END = "$"  # no letter
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def noisy(doc_id: Column, run: Column, noise: int = NOISE) -> Column:
    """The run, or without one character where ``noise`` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % noise == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, noise: int = NOISE) -> DataFrame:
    """(word, n): words of at least ``shortest`` characters that occur at least ``least`` times."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))).alias("run"))
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run")).select(noisy(F.col("doc_id"), F.col("run"), noise).alias("word"))
    return runs.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rotations(counted: DataFrame) -> DataFrame:
    """(prefix, word, n, whole, first) of every rotation. ``whole`` ones are kept in full; the
    others lost their last character, and ``first`` says it was the first of its run."""
    length = F.char_length("word")
    at = counted.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * length)).alias("e"))
    i, whole = F.floor(F.col("e") / 2).cast("int"), F.col("e") % 2 == 0
    head = F.substring("word", F.lit(1), i)
    tail = F.substring(F.col("word"), i + F.when(whole, 1).otherwise(2), length)
    first = ~whole & ((i == 0) | (F.substring(F.col("word"), i, F.lit(1)) != F.substring(F.col("word"), i + 1, F.lit(1))))
    return at.select(F.concat(tail, F.lit(END), head).alias("prefix"), "word", "n", whole.alias("whole"), first.alias("first"))


def scanned(rotated: DataFrame) -> DataFrame:
    """(word, n_near, best) per word and prefix range that gives it neighbours; ``best`` is
    (-n, word) of the most frequent neighbour there, the smallest of equal ones."""
    group = Window.partitionBy("prefix")
    rank = F.struct((-F.col("n")).alias("minus"), "word")
    rotated = rotated.withColumn("me", rank)
    skips = rotated.withColumn("skips", F.count_if(~F.col("whole")).over(group)).withColumn("firsts", F.count_if("first").over(group))
    full = F.min(F.when(F.col("whole"), F.col("me"))).over(group)
    marked = skips.withColumn("full", full).withColumn("top", F.min(F.when(~F.col("whole"), F.col("me"))).over(group)).withColumn("top_first", F.min(F.when(F.col("first"), F.col("me"))).over(group))
    marked = marked.where((F.col("skips") > 1) | F.col("full").isNotNull() & (F.col("firsts") > 0))
    second = F.min(F.when(~F.col("whole") & (F.col("me") != F.col("top")), F.col("me"))).over(group)
    other = F.when(F.col("me") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    with_full = F.col("first") & F.col("full").isNotNull()
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("skips") - 1 + with_full.cast("int"))
    best = F.when(F.col("whole"), F.col("top_first")).when(with_full, F.least(other, F.col("full"))).otherwise(other)
    return marked.withColumn("second", second).select("word", near.alias("n_near"), best.alias("best")).where("n_near > 0")


def scanned_long(counted: DataFrame, longest: int = LONG) -> DataFrame:
    """As ``scanned``, for the pairs with a word of over ``longest`` characters: rotations are
    digests, and pairs (at most one per character of the alphabet in a group) get their words by a join."""
    length = F.char_length("word")
    held = counted.where(length >= longest).select("word", "n", F.md5(F.col("word").cast("binary")).alias("id"), (length > longest).alias("long"))
    turned = rotations(held).select(F.md5(F.col("prefix").cast("binary")).alias("prefix"), F.md5(F.col("word").cast("binary")).alias("id"), (length > longest).alias("long"), "whole", "first")
    other = turned.select("prefix", *[F.col(c).alias(f"{c}_b") for c in ("id", "long", "whole", "first")])
    meets = ~F.col("whole") & ~F.col("whole_b") | F.col("first") & F.col("whole_b") | F.col("whole") & F.col("first_b")
    pairs = turned.join(other, "prefix").where(meets & (F.col("id") != F.col("id_b")) & (F.col("long") | F.col("long_b"))).select("id", "id_b")
    near = pairs.join(held.select(F.col("id").alias("id_b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "id_b").join(held.select("id", "word"), "id")
    return near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: the end of each chain of forms."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if found.join(further, "root", "left_semi").isEmpty():
            return found
        found = materialize(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")


def variants(counted: DataFrame, factor: int = FACTOR, longest: int = LONG) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``counted`` (word, n)."""
    found = scanned(rotations(counted.where(F.char_length("word") <= longest))).union(scanned_long(counted, longest))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    joined = counted.join(near, "word", "left")
    is_form = -F.col("best.minus") >= factor * F.col("n")
    formed = joined.select(
        "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.minus")).alias("form_n")
    )
    formed = materialize(formed, "variant-forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR, noise: int = NOISE) -> DataFrame:
    """Spelling variants of the words of ``docs``."""
    return variants(materialize(words(docs, shortest, least, noise), "variant-words"), factor)


def brute_force(rows: list[tuple[int | None, str | None]], shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR) -> list[tuple]:
    """Reference result on a small list: all single edits of every word; for tests."""
    import re
    import zlib
    from collections import Counter

    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % NOISE == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}
    letters = sorted({c for w in n for c in w})
    form, n_near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near = [v for v in edits if v in n and v != w]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w], n_near[w] = best if best is not None and n[best] >= factor * n[w] else None, len(near)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], n_near[w], n[form[w]] if form[w] else None))
    return out
