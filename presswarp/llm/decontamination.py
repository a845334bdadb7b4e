"""Benchmark decontamination: Wu-Manber search for the windows of benchmark items in whole documents.

A window is ``WINDOW`` consecutive words of an item, or all words of a shorter one. Texts and items are cut into words (A-Z
lower-cased); the search runs over words. For the windows of one length m, a table says for each block of two words how far
the search may move when that block ends at the place it looks at: the least distance of the block from the end of a
window, or m - 1 where no window has it. Places with a shift of 0 have the last block of some window; the bucket of that
block's hash has the windows, and comparing the words themselves decides. All documents of a batch are searched side by side:
long ones are cut into segments whose places overlap, so a step moves thousands of places at once.

Nothing of the documents is shuffled. The windows are broadcast in blocks of at most ``BLOCK_BYTES``, counted first; beyond one
block the documents are searched once a block, and what was found is put together by the texts' digests.

Defined results: null texts and texts without words have 0 words and no hits; null items and items without words have no
window; a null item_id is written as the empty string; rows of one item_id are one item; repeated documents each get the
same result; an empty table of documents gives an empty result, an empty benchmark hits nowhere; other columns are passed
through, but those of the output's names are replaced. Texts of any length are searched whole, ``BATCH_BYTES`` or one text at
a time.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, text_or_empty

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 48 << 20  # of windows and item ids that are broadcast at once
BATCH_BYTES = 1 << 20  # of texts that are searched side by side
SEGMENT = 256  # places of a window's end that one lane of the search looks at
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Not a word's byte: space. For ``bytes.translate``.
_SPACED = bytes(b if _IS_WORD[b] else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_R = 0xD6E8FEB86659FD93  # odd: it has an inverse modulo 2**64
_R_INVERSE = pow(_R, -1, 1 << 64)


def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a buffer of lower-cased UTF-8: where they start and end, and a 64-bit hash of each."""

    power, inverse = _powers(_R, 1 << 10), _powers(_R_INVERSE, 1 << 10)

    def __init__(self, data: np.ndarray):
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _IS_WORD[data]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, len(data) + BATCH_BYTES, BATCH_BYTES)))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.hashes[i:j] = self._hashed(data[self.starts[i] : self.ends[j - 1]], self.starts[i:j] - self.starts[i], self.ends[i:j] - self.starts[i])

    @staticmethod
    def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A word's hash is its part of one polynomial over the buffer, moved to the buffer's start."""
        if len(Words.power) < len(data):
            Words.power, Words.inverse = _powers(_R, len(data)), _powers(_R_INVERSE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Words.power[: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * Words.inverse[starts]


def _block_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left ^ (left >> np.uint64(29))) * _ODD + right
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
    return mixed ^ (mixed >> np.uint64(29))


class Patterns:
    """Wu-Manber tables for windows that all have m words. windows: the words, joined by spaces."""

    def __init__(self, m: int, windows: list[bytes]):
        self.m, self.block = m, min(2, m)
        data = np.frombuffer(b" ".join(windows), np.uint8)
        hashes = Words(data).hashes.reshape(len(windows), m)
        self.bits = max(10, math.ceil(math.log2(8 * len(windows) * m)))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint16)
        for end in range(self.block, m + 1):  # the nearest to a window's end is written last
            self.shift[self.slot(hashes[:, end - self.block], hashes[:, end - 1])] = m - end
        self.buckets: dict[int, dict[bytes, int]] = defaultdict(dict)
        for k, (slot, words) in enumerate(zip(self.slot(hashes[:, m - self.block], hashes[:, m - 1]).tolist(), windows, strict=True)):
            self.buckets[slot][words] = k

    def slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (_block_hash(left if self.block == 2 else np.zeros_like(right), right) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a last word where a window may end, and their slots. Texts are words first to last - 1."""
        first = first + self.m - 1
        n = np.maximum(0, -(-(last - first) // SEGMENT))
        lane = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
        stop = np.minimum(lane + SEGMENT, np.repeat(last, n))
        found, slots = [], []
        while len(lane):
            slot = self.slot(hashes[lane - 1] if self.block == 2 else hashes[lane], hashes[lane])
            shift = self.shift[slot]
            found.append(lane[shift == 0])
            slots.append(slot[shift == 0])
            lane = lane + np.maximum(shift, 1)
            left = lane < stop
            lane, stop = lane[left], stop[left]
        return (np.concatenate(found), np.concatenate(slots)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Searcher:
    """windows: (the words joined by spaces, the ids of the items that have it)."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        by_length = defaultdict(list)
        for words, items in windows:
            by_length[words.count(b" ") + 1].append((words, items))
        self.items = {m: [x[1] for x in found] for m, found in by_length.items()}
        self.patterns = [Patterns(m, [x[0] for x in found]) for m, found in sorted(by_length.items())]

    def search(self, texts: list[bytes]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
        """Of each text: the number of words, the runs of hit words, and the items found."""
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        words, raw = Words(data), data.tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(words.starts, ends)
        first = np.concatenate([[0], last[:-1]])
        spans, items = defaultdict(list), defaultdict(set)
        for p in self.patterns:
            places, slots = p.places(words.hashes, first, last)
            owners = np.searchsorted(last, places, side="right").tolist()
            begins, stops = words.starts[places - p.m + 1].tolist(), words.ends[places].tolist()
            for place, slot, owner, begin, stop in zip(places.tolist(), slots.tolist(), owners, begins, stops, strict=True):
                found = p.buckets[slot].get(b" ".join(raw[begin:stop].translate(_SPACED).split(b" "))) if slot in p.buckets else None
                if found is None and slot in p.buckets:  # several signs between two words
                    found = p.buckets[slot].get(b" ".join(raw[begin:stop].translate(_SPACED).split()))
                if found is not None:
                    spans[owner].append((place - p.m + 1, place))
                    items[owner].update(self.items[p.m][found])
        runs = [joined([(a - f, b - f) for a, b in spans[k]]) if k in spans else [] for k, f in enumerate(first.tolist())]
        return (last - first).tolist(), runs, [sorted(items[k]) if k in items else [] for k in range(len(texts))]


def joined(spans: list[tuple[int, int]]) -> list[dict]:
    """Runs of words, first and last, of spans that overlap or touch."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, items): each distinct window once, with the sorted ids of its items."""
    lowered = F.translate(text_or_empty(text), UPPER, LOWER)
    words = F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")
    cut = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = cut.select("item", F.explode(F.transform(places, lambda k: F.array_join(F.slice("w", k, window), " "))).alias("words"))
    return each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


#: The tables of the last broadcast that this worker has seen.
_built: dict[str, Searcher] = {}


def _searcher(name: str, windows: list[tuple[bytes, list[str]]]) -> Searcher:
    if name not in _built:
        _built.clear()
        _built[name] = Searcher(windows)
    return _built[name]


_FOUND = "n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"


def _searched(docs: DataFrame, text: str, windows: list[tuple[bytes, list[str]]]) -> DataFrame:
    names, shared, tables = docs.columns, docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex
    fields = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_FOUND).fields])
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(tables, shared.value)
        for batch in batches:
            column = batch.column(names.index(text)).fill_null("")
            sizes, at = pc.binary_length(column).to_pylist(), 0
            while at < len(sizes):
                end, total = at + 1, sizes[at]
                while end < len(sizes) and total + sizes[end] <= BATCH_BYTES:
                    total, end = total + sizes[end], end + 1
                part = batch.slice(at, end - at)
                found = searcher.search(column.slice(at, end - at).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found, kinds)], [*names, "n_words", "spans", "items"])
                at = end

    return docs.mapInArrow(work, fields)


def _bytes(windows: DataFrame) -> Column:
    return F.octet_length("words") + F.aggregate("items", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x) + 8) + 64


def find_windows(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, spans (the runs of hit words, places from 0) and items (sorted ids whose windows occur) to docs."""
    docs = docs.drop("n_words", "spans", "items")
    scratch = Scratch(docs.sparkSession, "windows")
    windows = scratch.put(windows.withColumn("part", F.xxhash64("words")))
    size = F.octet_length("words") + F.aggregate("items", F.lit(64).cast("bigint"), lambda n, x: n + F.octet_length(x) + 8)
    total = windows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= BLOCK_BYTES:
        found = _searched(docs, text, _collected(windows))
        scratch.drop_all()
        return found
    # more than one broadcast holds: each text is searched once for each block of windows
    key, blocks = free_name("digest", docs.columns), 2 * -(-total // BLOCK_BYTES)
    keyed = docs.withColumn(key, F.sha2(text_or_empty(text), 256))
    texts = scratch.put(keyed.select(key, F.col(text).alias("searched")).dropDuplicates([key]))
    parts = [_searched(texts, "searched", _collected(windows.filter(F.pmod("part", F.lit(blocks)) == k))).drop("searched") for k in range(blocks)]
    every = reduce(DataFrame.unionByName, parts).groupBy(key)
    whole = every.agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return keyed.join(_rejoined(whole), key).drop(key)


def _collected(windows: DataFrame) -> list[tuple[bytes, list[str]]]:
    return [(r.words.encode(), r.items) for r in windows.select("words", "items").collect()]


def _rejoined(found: DataFrame) -> DataFrame:
    """Spans that several searches found, as runs."""
    at = found.columns.index("spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [joined([(s["first"], s["last"]) for s in spans]) for spans in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.field(at), pa.array(runs, batch.field(at).type))

    return found.mapInArrow(work, found.schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for each document, and the runs of hit words."""
    found = find_windows(docs.select("doc_id", "text"), benchmark_windows(benchmark))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def remove_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a window of the benchmark, with their columns."""
    names = docs.columns
    taken = [c for c in names if c.lower() in ("n_words", "spans", "items")]
    safe = docs.select(F.struct(*names).alias("row"), F.col("text").alias("shown")) if taken else docs
    found = find_windows(safe, benchmark_windows(benchmark), "shown" if taken else "text").filter(F.size("spans") == 0)
    return found.select("row.*") if taken else found.select(*names)
