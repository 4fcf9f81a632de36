"""Byte-level BPE by traversal of a trie of words.

A text is split by the vocabulary's pattern; the distinct words of a slice form a trie,
walked depth first. The trie is held as its words in sorted order, which is its
preorder: going from one word to the next keeps the states of their common prefix and
computes only the new nodes, so a shared prefix is encoded once. The state of a node is
the last token of its prefix's encoding. A token t that ends the prefix is that token
exactly if it may follow the state of the node before t, that is, if no
merge across the border of the two comes before they are complete; merging by rank makes
such a chain unique.
Encoded words stay in a bounded cache of the worker and are used for all texts.

Defined results: a null text counts as empty and has no tokens; added tokens of the
vocabulary that occur in a text become their ids, as the library has it; repeated rows
give repeated rows; no rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolmill.llm.common import kept_with, map_texts, text_of

# Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Below this character, all Unicode tables agree on what is assigned.
SETTLED = "\u0558"

CACHED_WORDS = 400_000
CACHED_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if it prints in
    Latin-1, else the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, vocabulary: str):
        """``vocabulary``: the JSON text of a byte-level BPE tokenizer."""
        spec = json.loads(vocabulary)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take blanks or need word borders are not supported")
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a token: what it is merged from, and when
        for rank, (a, b) in enumerate(pairs):
            left, right = self.ids[as_bytes(a)], self.ids[as_bytes(b)]
            self.ranks[left, right] = rank
            self.parts.setdefault(self.ids[as_bytes(a + b)], (left, right, rank))
        self.never = len(self.ranks)
        self.backward: dict[int, int] = {}  # trie of the reversed tokens: node << 8 | byte -> node; node 0 is its root
        self.token_at: list[int] = [-1]
        for token, i in self.ids.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                node = self.backward.get(key, 0)
                if not node:
                    node = self.backward[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.pattern = regex.compile(PATTERN)
        self.vocabulary = vocabulary
        self.library = None
        self.lengths = False  # whether to keep token lengths too
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.follows: dict[int, bool] = {}
        self.words: dict[str, tuple[str, int, bytes, bytes]] = {}

    def may_follow(self, before: int, token: int) -> bool:
        """Whether ``token`` may come after ``before`` (-1: the start of a word): no merge
        across their border comes before both have grown to full size. The border is
        traced back in time: the part on it that was merged last is undone first, and two
        parts that stood side by side must have no merge earlier than the merges that took
        them up; of equal merges the left one comes first."""
        key = (before + 1) << 32 | token
        known = self.follows.get(key)
        if known is not None:
            return known
        known, parts, ranks = True, self.parts, self.ranks
        if before >= 0:
            left, right, left_taken, right_taken = before, token, self.never, self.never
            while True:
                rank = ranks.get((left, right), self.never)
                if rank < left_taken and rank <= right_taken and rank != self.never:
                    known = False
                    break
                of_left, of_right = parts.get(left), parts.get(right)
                if of_left is None and of_right is None:
                    break
                if of_right is None or of_left is not None and of_left[2] > of_right[2]:
                    left_taken, left = of_left[2], of_left[1]
                else:
                    right_taken, right = of_right[2], of_right[0]
        if len(self.follows) >= CACHED_PAIRS:
            self.follows.clear()
        self.follows[key] = known
        return known

    def encode_trie(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Token ids of each word, by one walk over the trie of all of them."""
        follows, may_follow, backward, token_at = self.follows, self.may_follow, self.backward, self.token_at
        length_of = {}
        states, path, out = [-1], b"", {}
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared, len(word)):
                node, start, ending = 0, end, []  # tokens that end here, the shortest first
                while start >= 0:
                    node = backward.get(node << 8 | word[start])
                    if node is None:
                        break
                    token = token_at[node]
                    if token >= 0:
                        ending.append((token, start))
                    start -= 1
                for token, start in reversed(ending):
                    before = states[start]
                    ok = follows.get((before + 1) << 32 | token)
                    if ok or ok is None and may_follow(before, token):
                        states.append(token)
                        length_of[token] = end + 1 - start
                        break
            chain, end = [], len(word)
            while end:
                token = states[end]
                chain.append(token)
                end -= length_of[token]
            out[word] = chain[::-1]
            path = word
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens. Tables of different Unicode versions may
        not agree on characters that are new; texts with such ones are split by the library."""
        if not text.isascii() and any(c >= SETTLED and unicodedata.category(c) == "Cn" for c in set(text)):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.vocabulary).pre_tokenizer
            return [text[start:end] for _, (start, end) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens of a text, in order."""
        if self.special is None or not self.special.search(text):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Puts words into the cache: ids as text, their number, decoded bytes, and if
        wanted token lengths in bytes."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = words
        coded = self.encode_trie({w.encode() for w in new if w not in self.added})
        for w in new:
            chain = [self.added[w]] if w in self.added else coded[w.encode()]
            decoded = self.decode(chain)
            lengths = bytes([len(self.bytes_of[t]) for t in chain]) if self.lengths else b""
            self.words[w] = (",".join(map(str, chain)), len(chain), decoded, lengths)


def encoder_of(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary."""
    return kept_with(shared, "encoder", lambda value: Encoder(value["vocabulary"]))


def load(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast; its size is fixed, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast({"vocabulary": f.read()})


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the ids as decimal text joined by commas, and the text decoded from the ids."""
    vocabulary = load(docs.sparkSession, path)

    def one(batch: pa.RecordBatch) -> dict:
        coder, out = encoder_of(vocabulary), {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids": [], "decoded": []}
        for ids, counts, decoded in _words_of(coder, batch):
            out["ids"].append(",".join(ids))
            out["n_tokens"].append(sum(counts))
            out["decoded"].append(b"".join(decoded).decode("utf-8", "replace"))
        return out

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, n_tokens long, ids string, decoded string")


def _words_of(coder: Encoder, batch: pa.RecordBatch):
    """Of each text, per word and in order: ids as text, their number, decoded bytes."""
    texts = [coder.pieces((t or b"").decode()) for t in text_of(batch.column("text"))]
    coder.learn(set().union(*texts))
    for words in texts:
        yield tuple(zip(*map(coder.words.__getitem__, words)))[:3] or ((), (), ())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode``, with digests in place of the ids and the text, so that only these leave the worker."""
    vocabulary = load(docs.sparkSession, path)

    def one(batch: pa.RecordBatch) -> dict:
        coder, out = encoder_of(vocabulary), {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids, counts, decoded in _words_of(coder, batch):
            out["ids_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            out["n_tokens"].append(sum(counts))
            text = b"".join(decoded).decode("utf-8", "replace")
            out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
        return out

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
