"""Token-id files: a concatenated id array for each shard, with document boundaries and document ids as Elias-Fano codes.

Documents are dealt into shards by ranges of doc_id, sorted inside a shard, and written as three files a shard:

    shard-00000.ids    ids, little-endian unsigned 16 or 32 bits
    shard-00000.ends   Elias-Fano: where each document begins, and the number of ids (n + 1 numbers)
    shard-00000.docs   Elias-Fano: doc_id less the shard's smallest doc_id (n numbers)

Elias-Fano keeps n ascending numbers below u in about 2 + log2(u / n) bits each: the low bits as they are, the high bits as
gaps in unary; every 256th set bit's place is kept, in as many bits as it needs, so ``select`` finds numbers without decoding
those before them; no file and no reader has a table of 64-bit numbers for all documents. A task
writes to a name of its own and renames, so repeated tasks do no harm. The manifest has one row a shard,
with the size of an id.

Defined results: null and empty texts consist of the end id; null doc_ids come first, before all others; rows of the same
doc_id are in the order of their ids' bytes; an empty table writes no shard and reads as empty; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, partitions

MAGIC = b"EF02"
_HEAD = "<QBBQQQ"
EVERY = 256
END_ID = 2
_MEMO = 400_000


def pack(values: np.ndarray, width: int) -> bytes:
    """Numbers below 2 ** width in so many bits each."""
    if not width:
        return b""
    return np.packbits(((np.asarray(values, np.int64)[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, first: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.int64)
    a, b = first * width, (first + count) * width
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
    return bits.reshape(count, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


class EliasFano:
    """A non-decreasing sequence of numbers from 0."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, place_bits: int, places: bytes):
        self.n, self.low_bits, self.low, self.high, self.place_bits, self.places = n, low_bits, low, high, place_bits, places

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (v >> bits) + np.arange(n)
        marks = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        marks[places] = 1
        width = len(marks).bit_length()
        return cls(n, bits, pack(v, bits), np.packbits(marks, bitorder="little").tobytes(), width, pack(places[::EVERY], width))

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """The numbers first, first + 1, ..., from 0, without those before: from the kept place of the last one before that has
        one, the set bits are counted on."""
        if not 0 <= first <= first + count <= self.n:
            raise IndexError(first)
        if not count:
            return np.zeros(0, np.int64)
        start, skip = int(unpack(self.places, self.place_bits, first // EVERY, 1)[0]), first % EVERY
        high, byte, found, have = np.frombuffer(self.high, np.uint8), start // 8, [], 0
        ahead = 64 + (skip + count) // 2
        while have < skip + count:
            places = np.flatnonzero(np.unpackbits(high[byte : byte + ahead], bitorder="little")) + byte * 8
            places = places[places >= start]
            found.append(places)
            have, byte = have + len(places), byte + ahead
        places = np.concatenate(found)[skip : skip + count]
        return ((places - np.arange(first, first + count)) << self.low_bits) + unpack(self.low, self.low_bits, first, count)

    def dumps(self) -> bytes:
        return MAGIC + struct.pack(_HEAD, self.n, self.low_bits, self.place_bits, len(self.low), len(self.high), len(self.places)) + self.low + self.high + self.places

    @classmethod
    def loads(cls, data: bytes) -> EliasFano:
        if data[:4] != MAGIC:
            raise ValueError("not an Elias-Fano file")
        n, bits, width, low, high, places = struct.unpack_from(_HEAD, data, 4)
        at = 4 + struct.calcsize(_HEAD)
        return cls(n, bits, data[at : at + low], data[at + low : at + low + high], width, data[at + low + high : at + low + high + places])


#: Letters and marks for which normalizing and splitting by the vocabulary's pattern are plain: a run of either is one
#: pre-token.
_PIECES = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*$#&%]*)")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next free
    one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class _Memo(dict):
    """Remembers what ``make`` gives; forgets all when full."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Encodes whole texts as the tokenizers library does, word by word, each distinct word once while it is remembered.

    The vocabulary's normalizer and pre-tokenizer never look across white space, so a text's ids are the ids of its words,
    one after another. A word of plain letters with plain marks after it is a pre-token of each, and goes to the library's
    model itself; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.alphabet = byte_alphabet()
        self.words = _Memo(self._word, _MEMO)
        self.letters = _Memo(self._letters, 2 * _MEMO)
        self.marks = _Memo(self.whole, _MEMO)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.alphabet.__getitem__, word.encode()))
        size = self.kind.itemsize
        return b"".join([t.id.to_bytes(size, "little") for t in self.model.tokenize(word)])

    def _word(self, word: str) -> bytes:
        m = _PIECES.fullmatch(word)
        if not m:
            return self.whole(word)
        letters = self.letters[m[1].lower()]
        return letters + self.marks[m[2]] if m[2] else letters

    def encode(self, text: str) -> bytes:
        """The ids' bytes."""
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, as workers are used again by later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, id_bytes): the ids' bytes, end id included, and the size of one: 2 where the vocabulary allows, else 4."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary)
        end = np.array([end_id], coder.kind).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).to_pylist()
                size = pa.array([coder.kind.itemsize] * part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([coder.encode(x) + end for x in texts], pa.binary()), size], ["doc_id", "ids", "id_bytes"])

    return rows.mapInArrow(work, "doc_id bigint, ids binary, id_bytes int")


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards below ``path`` (a URI) and returns the manifest: (shard, name, first_doc, n_nulls, n_docs, n_ids, id_bytes)."""
    spark = docs.sparkSession
    n = partitions(spark)
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), [k / n for k in range(1, n)], 20 * n).alias("q")).first().q if n > 1 else None
    cuts = F.array(*map(F.lit, sorted({*(found or [])}))).cast("array<bigint>")
    ids = tokenized(docs, vocabulary, end_id)
    shard = F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))), F.lit(0))
    dealt = ids.withColumn("shard", F.when(F.col("doc_id").isNull(), 0).otherwise(shard)).repartition(n, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        now, stream, mine, rows, width = None, None, uuid.uuid4().hex, [], 2

        def close():
            stream.close()
            name = f"{root}/shard-{now:05d}"
            known = np.array([x for x in keys if x is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            for suffix, values in (("ends", np.concatenate([[0], np.cumsum(sizes)])), ("docs", known - first)):
                with fs.open_output_stream(f"{name}.{suffix}.{mine}") as out:
                    out.write(EliasFano.encode(values).dumps())
            for suffix in ("ids", "ends", "docs"):
                fs.move(f"{name}.{suffix}.{mine}", f"{name}.{suffix}")
            rows.append((now, f"shard-{now:05d}", first, len(keys) - len(known), len(keys), int(sum(sizes)), width))

        keys: list = []
        sizes: list = []
        for batch in batches:
            for s, d, data, width in zip(batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if s != now:
                    if stream is not None:
                        close()
                    now, keys, sizes = s, [], []
                    stream = fs.open_output_stream(f"{root}/shard-{now:05d}.ids.{mine}")
                raw = data.as_buffer()
                stream.write(raw)
                keys.append(d)
                sizes.append(raw.size // width)
        if stream is not None:
            close()
        names = ["shard", "name", "first_doc", "n_nulls", "n_docs", "n_ids", "id_bytes"]
        if rows:
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.string() if c == "name" else pa.int64()) for k, c in enumerate(names)})

    manifest = dealt.mapInArrow(work, "shard bigint, name string, first_doc bigint, n_nulls bigint, n_docs bigint, n_ids bigint, id_bytes bigint")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, ids): from the files, each task a shard at a time, 256 documents by one ``select`` of each code. ids are little-endian unsigned 32-bit integers.

    The manifest has a row for each shard (as many as shuffle partitions), so the shards' own starts are summed at once.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("start", before).repartition(partitions(manifest.sparkSession), "shard")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                codes = []
                for suffix in ("ends", "docs"):
                    with fs.open_input_stream(f"{root}/{row['name']}.{suffix}") as f:
                        codes.append(EliasFano.loads(f.read()))
                ends, docs, nulls, size = *codes, row["n_nulls"], row["id_bytes"]
                with fs.open_input_file(f"{root}/{row['name']}.ids") as f:
                    for k in range(0, row["n_docs"], 256):
                        n = min(256, row["n_docs"] - k)
                        at = ends.select(k, n + 1)
                        data = np.frombuffer(f.read_at(int(at[-1] - at[0]) * size, int(at[0]) * size), f"<u{size}").astype("<u4")
                        cuts = (at - at[0]).tolist()
                        texts = [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                        known = docs.select(max(0, k - nulls), max(0, k + n - max(k, nulls))) + row["first_doc"]
                        keys = pa.array([None] * (n - len(known)) + known.tolist(), pa.int64())
                        yield pa.RecordBatch.from_arrays([keys, pa.array(at[:-1] + row["start"], pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "start", "ids"])

    return shards.mapInArrow(work, "doc_id bigint, start bigint, ids binary")


def find_document(path: str, name: str, i: int, id_bytes: int = 2) -> np.ndarray:
    """The ids of a shard's i-th document, by one ``select`` and one read. id_bytes: see the manifest."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}/{name}.ends") as f:
        ends = EliasFano.loads(f.read())
    a, b = ends.select(i, 2).tolist()
    with fs.open_input_file(f"{root}/{name}.ids") as f:
        return np.frombuffer(f.read_at((b - a) * id_bytes, a * id_bytes), f"<u{id_bytes}")


def token_file_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's columns for each document, from the files."""
    path = fresh_dir(docs.sparkSession, "token-files")
    read = read_token_files(write_token_files(docs, vocabulary, path), path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
