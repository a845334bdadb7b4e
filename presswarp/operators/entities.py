"""Names of a lexicon in texts, and the guard that lets a copy name only what its input names.

Texts and names are compared in NFKC, in two forms: with runs of blanks as one space, where a name that begins or ends with an ASCII
letter or digit must not go on with one; and without blanks, for names that hold a letter beyond ASCII, since blanks put
into such a name do not make it another. Case matters.

All names are looked for in one pass over a text by an Aho-Corasick automaton, which goes to the tasks only below
``LEXICON_BYTES``, counted first. A larger lexicon is joined: a name's first characters are its key, a text's keys are the
pieces of that length that it has and that some name begins with (by a Bloom filter of fixed size), and containment is
tested for each pair that meets.

Defined results: null and blank texts name nothing; null, blank and repeated names of the lexicon are ignored; several names
may stand for one entity; rows are never joined with each other; repeated rows each get their result; of a text in which many
entities stand all are listed, sorted.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as ru
from ..functions import urls

LEXICON_BYTES = 24 << 20  # of names and ids that are broadcast
KEY = 4  # characters that join a longer lexicon
FILTER_BITS = 23  # of the filter of keys: 1 MB
BATCH = 256

_ASCII = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_BLANKS = re.compile(r"\s+")


def spaced(text: str) -> str:
    return _BLANKS.sub(" ", unicodedata.normalize("NFKC", text)).strip()


def unspaced(text: str) -> str:
    return _BLANKS.sub("", unicodedata.normalize("NFKC", text))


def beyond_ascii(name: str) -> bool:
    return any(ord(c) > 127 and c.isalpha() for c in name)


def stands(text: str, start: int, end: int) -> bool:
    """Does text[start:end] neither begin nor end inside a run of ASCII letters and digits."""
    return not (start > 0 and text[start] in _ASCII and text[start - 1] in _ASCII or end < len(text) and text[end - 1] in _ASCII and text[end] in _ASCII)


class Lexicon:
    """names: (entity, name), names in NFKC."""

    def __init__(self, names: list[tuple[str, str]]):
        self.whole, self.packed = ahocorasick.Automaton(), ahocorasick.Automaton()
        for entity, name in names:
            for automaton, form in ((self.whole, spaced(name)), (self.packed, unspaced(name) if beyond_ascii(name) else "")):
                if form:
                    automaton.get(form, None) or automaton.add_word(form, (len(form), set()))
                    automaton.get(form)[1].add(entity)
        for automaton in (self.whole, self.packed):
            if len(automaton):
                automaton.make_automaton()

    def entities(self, text: str | None) -> list[str]:
        found: set[str] = set()
        if text and len(self.whole):
            form = spaced(text)
            for end, (n, own) in self.whole.iter(form):
                if not own <= found and stands(form, end + 1 - n, end + 1):
                    found |= own
        if text and len(self.packed):
            for _, (_, own) in self.packed.iter(unspaced(text)):
                found |= own
        return sorted(found)


_built: dict[str, Lexicon] = {}


def _lexicon(name: str, names: list[tuple[str, str]]) -> Lexicon:
    if name not in _built:
        _built.clear()
        _built[name] = Lexicon(names)
    return _built[name]


def usable(lexicon: DataFrame) -> DataFrame:
    """(entity, name) without nulls, blanks and repeats."""
    return lexicon.select(F.col("entity").cast("string").alias("entity"), "name").filter(F.col("entity").isNotNull() & F.col("name").rlike(r"[^\s]")).distinct()


def named(df: DataFrame, lexicon: DataFrame, columns: dict[str, str], key: str | None = None) -> DataFrame:
    """df with, for each item (output, text column) of columns, the sorted ids of the entities that the text names. lexicon: (entity, name).
    key: a column that tells rows apart; only a lexicon too large to broadcast needs it."""
    df, lexicon = df.drop(*columns), usable(lexicon)
    size = lexicon.agg(F.coalesce(F.sum(F.octet_length("entity") + F.octet_length("name") + 16), F.lit(0))).first()[0]
    if size > LEXICON_BYTES:
        if key is None:
            raise ValueError("a lexicon of this size needs a column that tells rows apart")
        for out, text in columns.items():
            df = _joined(df, lexicon, key, text, out)
        return df
    names, version = df.columns, uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast([(r.entity, r.name) for r in lexicon.collect()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _lexicon(version, shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                new = [pa.array([found.entities(t) for t in part.column(names.index(c)).to_pylist()], pa.list_(pa.string())) for c in columns.values()]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, *columns])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, *(T.StructField(c, T.ArrayType(T.StringType())) for c in columns)]))


def _slots(piece: str) -> int:
    return xxhash.xxh3_64_intdigest(piece) >> (64 - FILTER_BITS)


def _forms(lexicon: DataFrame) -> DataFrame:
    """(entity, form, packed, piece): the forms of each name, and the characters by which they are joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for entity, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((entity, spaced(name), False))
                if beyond_ascii(name):
                    rows.append((entity, unspaced(name), True))
            rows = [(e, f, p, f[:KEY], _slots(f[:KEY])) for e, f, p in rows if f]
            yield pa.RecordBatch.from_pylist([dict(zip(("entity", "form", "packed", "piece", "slot"), r, strict=True)) for r in rows], pa.schema([("entity", pa.string()), ("form", pa.string()), ("packed", pa.bool_()), ("piece", pa.string()), ("slot", pa.int64())]))

    return lexicon.mapInArrow(work, "entity string, form string, packed boolean, piece string, slot bigint")


def _joined(df: DataFrame, lexicon: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """The join of texts and names by the names' first characters. The filter of these has a fixed size; texts are shuffled once, with the few
    pieces that pass it."""
    forms = _forms(lexicon).distinct()
    spark = df.sparkSession
    marks = np.zeros(1 << FILTER_BITS, bool)
    for r in forms.select("slot").distinct().toLocalIterator():
        marks[r.slot] = True
    shared, packed_marks = spark.sparkContext.broadcast(np.packbits(marks)), FILTER_BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(shared.value)[: 1 << packed_marks].astype(bool)
        kinds = pa.schema([("key", kind), ("packed", pa.bool_()), ("form", pa.string()), ("pieces", pa.list_(pa.string()))])
        for batch in batches:
            for row_key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for packed, form in ((False, spaced(t or "")), (True, unspaced(t or ""))):
                    pieces = {form[i : i + n] for n in range(1, KEY + 1) for i in range(len(form) - n + 1)}
                    pieces = [p for p in pieces if seen[_slots(p)]]
                    if pieces:
                        rows.append({"key": row_key, "packed": packed, "form": form, "pieces": pieces})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[df.schema[key].dataType.simpleString()]
    texts = df.select(F.col(key), F.col(text)).mapInArrow(work, f"key {df.schema[key].dataType.simpleString()}, packed boolean, form string, pieces array<string>")
    edge = lambda c: F.when(c.rlike("[A-Za-z0-9]"), "[A-Za-z0-9]")
    name = F.col("n.form")
    quoted = F.regexp_replace(name, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    pattern = F.concat(F.coalesce(F.concat(F.lit("(?<!"), edge(F.substring(name, 1, 1)), F.lit(")")), F.lit("")), quoted, F.coalesce(F.concat(F.lit("(?!"), edge(F.substring(name, -1, 1)), F.lit(")")), F.lit("")))
    pairs = texts.withColumn("piece", F.explode("pieces")).alias("t").join(forms.alias("n"), (F.col("t.piece") == F.col("n.piece")) & (F.col("t.packed") == F.col("n.packed")) & F.contains(F.col("t.form"), name))
    hits = pairs.filter(F.col("t.packed") | F.regexp_like(F.col("t.form"), pattern)).groupBy(F.col("t.key").alias("_key")).agg(F.array_sort(F.collect_set("n.entity")).alias(out))
    found = df.join(hits, df[key].eqNullSafe(hits["_key"]), "left").drop("_key")
    return found.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


# ---- the guard

#: Fixed value: names that a translation joins again, so that the input counts in both spellings.
REJOINED = r"(?i)\b(gpt|glm)\s+(?=[o\d])"


def publisher_entity(url: Column, domains: dict[str, str]) -> Column:
    """The entity whose domain the address's host is, or is below; the longest domain wins. domains: a pack's table, some hundreds at most."""
    parts = F.split(urls.host(url), "\\.")
    table = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair]) if domains else F.create_map().cast("map<string,string>")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.get(F.filter(F.transform(ends, lambda e: F.try_element_at(table, e)), lambda x: x.isNotNull()), F.lit(0))


def guarded(df: DataFrame, lexicon: DataFrame, inputs: list[str], title: str, summary: str, original: str, url: str | None = None, owner: str | None = None, domains: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Guards the copy (title, summary) of a material: entities that it names must be named in the inputs, be an alias's (pattern: entity), publish
    the address, or own the source. A title that names another one gives way to the original title if that is Chinese, else to
    nothing; a summary goes. Adds guarded_title, guarded_summary, outcome (pass or fallback), title_unsupported and summary_unsupported."""
    whole = F.concat_ws("\n", *inputs)
    both = F.concat_ws("\n", whole, F.regexp_replace(whole, REJOINED, "$1-"))
    names = df.columns
    rows = df.withColumn("_input", both)
    rows = named(rows, lexicon, {"_allowed": "_input", "_title": title, "_summary": summary})
    known = F.filter(F.array(*[F.when(whole.rlike(p), F.lit(e)) for p, e in (aliases or {}).items()], publisher_entity(F.col(url), domains or {}) if url else F.lit(None).cast("string"), F.col(owner) if owner else F.lit(None).cast("string")), lambda x: x.isNotNull())
    allowed = F.concat("_allowed", known)
    rows = rows.withColumns({"title_unsupported": F.array_except("_title", allowed), "summary_unsupported": F.array_except("_summary", allowed)})
    bad_title, bad_summary = F.size("title_unsupported") > 0, F.size("summary_unsupported") > 0
    kept = F.when(~bad_title, F.col(title)).when(ru.looks_chinese(F.col(original)), F.col(original)).otherwise("")
    return rows.select(*names, kept.alias("guarded_title"), F.when(bad_summary, "").otherwise(F.col(summary)).alias("guarded_summary"), F.when(bad_title | bad_summary, "fallback").otherwise("pass").alias("outcome"), "title_unsupported", "summary_unsupported")
