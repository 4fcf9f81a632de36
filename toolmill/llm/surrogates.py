"""Surrogates for personal data.

Mail addresses, phone and social-security numbers, IPv4, IPv6 and hardware addresses, card
numbers, IBANs, secrets and names after a title are found by pattern and check digit; dates,
spans of years and numbers in groups of thousands are no phone numbers. Each distinct entity gets a
replacement drawn from a keyed stream (HMAC-SHA256 of key, kind, entity, attempt) that
keeps type and format: digits stay digits, letters letters of the same case and script,
separators stay, card numbers keep their length and check digit, names the gender of
their title. The parts of a name are entities of their own and their other mentions in
the same text, capitalised and without a title, are mentions of them too: by surname
only, by given name only, with an ending such as 's, or before the title. A part that
names several entities is the last one named before, or else the first one.

Collisions are checked over the corpus: of the entities of one kind that drew the same
replacement, or one that is itself an entity of the corpus, all but the first by code
point draw again until none is left, so different entities stay different and equal ones
equal in every document. Entities are distinct before they are compared, and only those
in conflict go through another round. Given and family names are compared together.
Where ``DRAWS`` rounds find no free value, a format is taken as full, and the replacement gets
longer by a digit each round (an IPv4 address draws on). Texts are joined with replacements only where they
have entities.

Defined results: null and empty texts come back as they are, with no entity; overlapping
finds go to the kind listed first; repeated rows are treated alike; all columns of
``docs`` pass through and only ``text`` changes; no rows in, no rows out.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolmill.llm.common import free, slices, text_of
from toolmill.session import materialize

DRAWS = 12  # of an entity's own format; then replacements get longer

# Patterns of entities, in order of precedence, and titles by gender.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?<![.-])",
    "secret": r"(?i)(?<=\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_\-/+]{8,}|\b[0-9a-f]{32,}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "mac": r"(?<![\w:-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:-])|(?<![\w:-])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![\w:-])",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){3}|[0-9A-Fa-f]{4}::[0-9A-Fa-f]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)(?![\w:])",
    "phone": r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,5}){1,4}(?![\w-]|\.\d)|(?<![\w.-])\+\d{8,15}(?!\w)",
    "name": r"\b(?:Dr|Dra|Prof|Doctor|Professor|Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Господин|Госпожа|Κύριος|Κυρία)\b\.?\s+\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+)?",
}
MALE = frozenset("Mr Mister Herr Monsieur Señor Господин Κύριος".split())
NEUTRAL = frozenset("Dr Prof Doctor Professor".split())
# Dates and spans of years, then numbers in groups of thousands, which look like phone numbers.
DATES = r"(?<!\d)\d{4}([-./])\d{1,2}\1\d{1,2}(?!\d)|(?<!\d)\d{1,2}([-./])\d{1,2}\2\d{4}(?!\d)|(?<![\d(+])(?:1[0-9]|20)\d\d ?[-–] ?(?:1[0-9]|20)\d\d(?![\d-])"
THOUSANDS = r"(?<![\d(+.-])(?<![\d)][ .-])[1-9]\d{0,2}([ .])\d{3}(?:\1\d{3})+(?![ .-]?\d)"
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
CONSONANTS = {"latin": "bcdfglmnprstv", "cyrillic": "бвгдклмнпрст", "greek": "βγδκλμνπρστ"}

_FINDERS = {kind: regex.compile(p) for kind, p in PATTERNS.items()}
_NO_PHONE = [regex.compile(DATES), regex.compile(THOUSANDS)]
_MAYBE = regex.compile(r"[0-9@]|::|\b(?:" + "|".join(sorted(MALE | NEUTRAL | set("Dra Mrs Ms Miss Frau Madame Mme Señora Госпожа Κυρία".split()))) + r")\b|(?i:token|secret|passw|key)")
_PIECES = regex.compile(r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}]*(?![\p{L}\p{M}\p{N}])")
_JOINED = frozenset("'’-")
_ENDING = regex.compile(r"(?i:['’]s)?['’-]*$")  # not of the name
MENTION = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("finish", T.IntegerType())])
)


def luhn(digits: str) -> int:
    """What the check digit adds up to; 0 for valid numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def canonical(kind: str, text: str) -> str:
    """The form in which mentions of one entity agree."""
    digits = "".join(c for c in text if c.isdigit())
    if kind == "phone" and text[0] == "+":  # the country's code apart, as far as it is set apart
        code = regex.match(r"\+\d{1,3}(?=\D)|\+\d", text).group()
        return f"{code} {digits[len(code) - 1 :]}"
    if kind in ("card", "phone"):
        return digits
    if kind == "iban":
        return text.replace(" ", "")
    if kind.startswith("name"):
        return text.lower().replace("’", "'")
    return text.lower() if kind in ("email", "mac", "ip6") else text


def later(text: str, names: list[tuple[str, str, int, int]], used: bytearray) -> list[tuple[str, str, int, int]]:
    """Mentions without a title of the parts of names found in a text: whole words, or words joined
    by hyphens and apostrophes, that begin with a capital and lie outside of what is ``used``."""
    known: dict[str, list[tuple[int, str]]] = {}
    for kind, entity, start, _ in sorted(names, key=lambda x: x[2]):
        known.setdefault(entity, []).append((start, kind))
    longest = max((len(regex.findall(r"['’-]", entity)) + 1 for entity in known), default=0)
    pieces = [m.span() for m in _PIECES.finditer(text)] if known else []
    out, i = [], 0
    while i < len(pieces):
        start, j = pieces[i][0], i + 1
        while j < len(pieces) and j - i < longest and pieces[j][0] - pieces[j - 1][1] == 1 and text[pieces[j][0] - 1] in _JOINED:
            j += 1
        while j > i:
            finish = pieces[j - 1][1]
            entity = canonical("name", text[start:finish])
            if entity in known and text[start].isupper() and not any(used[start:finish]):
                places = known[entity]
                at = bisect.bisect(places, start, key=lambda x: x[0])
                out.append((places[max(0, at - 1)][1], entity, start, finish))
                break
            j -= 1
        i = max(j, i + 1)
    return out


def _without_numbers(text: str) -> str:
    """The text with line feeds for dates and large numbers, at the same places."""
    for pattern in _NO_PHONE:
        text = pattern.sub(lambda m: "\n" * len(m.group()), text)
    return text


def find(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, entity, start, end) of a text, in order and without overlaps."""
    if not text or not _MAYBE.search(text):
        return []
    taken: list[tuple[str, str, int, int]] = []
    names: list[tuple[str, str, int, int]] = []
    used = bytearray(len(text))
    for kind, finder in _FINDERS.items():
        for m in finder.finditer(_without_numbers(text) if kind == "phone" else text):
            start, end = m.span()
            found = m.group()
            digits = sum(c.isdigit() for c in found)
            if any(used[start:end]) or kind == "card" and luhn(canonical(kind, found)) or kind == "phone" and not 7 <= digits <= 15:
                continue
            used[start:end] = b"\x01" * (end - start)
            if kind == "name":
                parts = list(regex.finditer(r"[\p{L}'’-]+", found))
                gender = "m" if parts[0].group() in MALE else "n" if parts[0].group() in NEUTRAL else "f"
                named = parts[1:] if len(parts) > 1 else []
                for k, part in enumerate(named):
                    what = "name-family" if k == len(named) - 1 else f"name-given-{gender}"
                    name = _ENDING.sub("", part.group())
                    names.append((what, canonical(what, name), start + part.start(), start + part.start() + len(name)))
            else:
                taken.append((kind, canonical(kind, found), start, end))
    return sorted(taken + names + later(text, names, used), key=lambda x: x[2])


def stream(key: bytes, kind: str, entity: str, attempt: int) -> Iterator[int]:
    """Endless keyed bytes."""
    block = 0
    while True:
        yield from hmac.new(key, f"{kind}\0{entity}\0{attempt}\0{block}".encode(), hashlib.sha256).digest()
        block += 1


def script_of(text: str) -> str:
    first = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"


def draw(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """A replacement in canonical form."""
    source = stream(key, kind, entity, attempt)
    pick = lambda letters: letters[(next(source) << 8 | next(source)) % len(letters)]
    if kind.startswith("name"):
        script = script_of(entity)
        syllables = max(3, (len(entity) + 1) // 2) + attempt // 8
        out = "".join(pick(CONSONANTS[script]) + pick(VOWELS[script]) for _ in range(syllables))
        return out[:-1] + {"latin": "a", "cyrillic": "а", "greek": "α"}[script] if kind.endswith("-f") else out + pick(CONSONANTS[script])
    if kind == "ip":
        return ".".join(str(1 + (next(source) << 8 | next(source)) % 254) for _ in range(4))
    keep = len(entity) - len(entity.rsplit("@", 1)[-1]) + entity.rsplit("@", 1)[-1].rfind(".") if kind == "email" else len(entity)
    fixed = 1 if kind == "card" else 2 if kind == "iban" else entity.find(" ") + 1 if kind == "phone" else 0  # the network's digit, the country
    low_hex = kind in ("mac", "ip6") or kind == "secret" and all(c in "0123456789abcdef" for c in entity)
    out = []
    for i, c in enumerate(entity):
        if i < fixed or i >= keep or not c.isalnum():
            out.append(c)
        elif low_hex:
            out.append(pick("0123456789abcdef"))
        elif c.isdigit():
            out.append(pick("0123456789"))
        else:
            letter = pick((VOWELS[script_of(c)] + CONSONANTS[script_of(c)]))
            out.append(letter.upper() if c.isupper() else letter)
    made = "".join(out) + "".join(pick("0123456789") for _ in range(attempt - DRAWS + 1))  # the format is full: longer
    if kind == "card":
        made = made[:-1] + next(d for d in "0123456789" if not luhn(made[:-1] + d))
    return made


def fitted(replacement: str, kind: str, mention: str) -> str:
    """A replacement in the format of one mention: its separators, its case."""
    if kind in ("card", "phone", "iban"):
        letters = iter([c for c in replacement if c.isalnum()])
        return "".join([next(letters, c) if c.isalnum() else c for c in mention]) + "".join(letters)
    if kind.startswith("name"):
        return replacement.upper() if mention.isupper() and len(mention) > 1 else replacement[:1].upper() + replacement[1:]
    return replacement.upper() if kind in ("email", "mac", "ip6") and mention.isupper() else replacement


def drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """Adds the replacement of each (kind, entity, attempt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, names, tries = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([draw(key, *x) for x in zip(kinds, names, tries)], pa.string())], names=[*b.schema.names, "replacement"])

    return entities.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, replacement string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, replacement): different replacements for different entities, none of them an entity itself."""
    entities = materialize(entities.select("kind", "entity").distinct(), "pii-entities")
    family = F.when(F.startswith("kind", F.lit("name")), "name").otherwise(F.col("kind")).alias("family")
    settled, todo = None, entities.withColumn("attempt", F.lit(0))
    for attempt in itertools.count(1):
        made = materialize(drawn(todo, key), "pii-drawn")
        ours = made.select(family, "replacement", F.struct("entity", "kind").alias("who"))
        first = ours.groupBy("family", "replacement").agg(F.min("who").alias("who"))
        free = first.join(entities.select(family, F.col("entity").alias("replacement")), ["family", "replacement"], "left_anti")
        if settled is not None:
            free = free.join(settled.select(family, "replacement"), ["family", "replacement"], "left_anti")
        free = materialize(free.select("who.kind", "who.entity", "replacement"), "pii-settled")
        settled = free if settled is None else settled.union(free)
        todo = materialize(made.select("kind", "entity").join(free, ["kind", "entity"], "left_anti").withColumn("attempt", F.lit(attempt)), "pii-todo")
        if todo.isEmpty():
            return settled


def _mentions(docs: DataFrame, name: str) -> DataFrame:
    """All columns, and the mentions of the text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, MENTION)])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(MENTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [[dict(zip(("kind", "entity", "start", "finish"), x)) for x in find((t or b"").decode())] for t in text_of(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``, the mentions replaced."""
    columns = docs.columns
    held, row, spans, row_of = free(docs, "_mentions", "_row", "_spans", "_row_of")
    found = _mentions(docs, held)
    touched = materialize(found.where(F.size(held) > 0).withColumn(row, F.monotonically_increasing_id()), "pii-texts")
    mentions = touched.select(F.col(row).alias("_row"), F.explode(held).alias("m")).select("_row", "m.*")
    settled = assign(mentions, key.encode())
    drawn_for = mentions.join(settled, ["kind", "entity"]).groupBy(F.col("_row").alias(row_of)).agg(F.collect_list(F.struct("start", "finish", "kind", "replacement")).alias(spans))
    joined = touched.drop(held).join(drawn_for, F.col(row) == F.col(row_of)).drop(row, row_of)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = []
            for text, spans_ in zip(part.column("text").to_pylist(), part.column(spans).to_pylist()):
                out, at = [], 0
                for s in sorted(spans_, key=lambda s: s["start"]):
                    out += [text[at : s["start"]], fitted(s["replacement"], s["kind"], text[s["start"] : s["finish"]])]
                    at = s["finish"]
                texts.append("".join([*out, text[at:]]))
            counts = pa.array([len(s) for s in part.column(spans).to_pylist()], pa.int64())
            arrays = [pa.array(texts, part.schema.field("text").type) if n == "text" else part.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays([*arrays, counts], names=[*columns, "n_entities"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType())])
    untouched: Column = F.lit(0).cast("long").alias("n_entities")
    return joined.mapInArrow(rewrite, schema).unionByName(found.where(F.size(held) == 0).select(*[F.col(c) for c in columns], untouched))
