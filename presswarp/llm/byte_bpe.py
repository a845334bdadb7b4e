"""Byte-level BPE by a global shuffle of distinct words.

Texts are exploded into pre-tokens. Within a block of documents (a stretch of a partition, bounded in words) the pre-tokens
are numbered, so that a document becomes the sequence of its words' numbers, in order of position, and every word of a
block is one row. Those rows are shuffled by word; each distinct word is encoded once; the ids go back to the blocks by a
second shuffle and are put in the places of the words' numbers. Decoding joins the ids with the table of the tokens' bytes,
which the vocabulary bounds (about 50,000 rows), so that table goes to the tasks whole.

What a block has of words goes to the encoding in packets, one for each slot (a hash of the word, as many slots as shuffle
partitions), so the rows are few and small: a packet holds the words and their numbers, compressed. The numbered documents and
the packets are written once, as a table in the shared folder, bucketed by the block of a document and the slot of a packet. So
both ways start from the same blocks, neither documents nor words are shuffled before they are encoded, and a lost executor costs
only the tasks it had. A block ends after a bounded number of words, so memory follows the longest document at most, and a slot's
words are those of a shuffle partition.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows are encoded one by one; an empty
table gives an empty result; the columns named in ``keep`` are carried through, others not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_dir, partitions, tidy

BLOCK_WORDS = 100_000  # distinct words after which a block ends
BLOCK_PLACES = 800_000  # and words in all
ROWS = 128  # documents of one batch to Spark
REMEMBERED = 64  # bytes of a word up to which its ids are remembered; longer ones are encoded where they come


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary's table: on the driver if the file is there, else through Spark. A row for each token."""
    try:
        return load_ranks(path)
    except OSError:
        return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in spark.read.text(path).collect() if r.value.strip())}


class Block:
    """Numbers a block's words by first appearance.

    Stretches of words with single spaces are cut before the spaces, where no match goes across; the cuts' numbers are
    remembered, so most words cost one look-up. What is between such stretches is matched as it stands.
    """

    def __init__(self, pattern: regex.Pattern):
        self.pattern, self.words, self.cuts, self.places = pattern, {}, _Cuts(self), 0

    def numbers(self, text: str) -> bytes:
        words = self.words
        return b"".join([words.setdefault(w, len(words)).to_bytes(4, "little") for w in self.pattern.findall(text)])

    def add(self, text: str) -> bytes:
        """The numbers of the text's words, as bytes of 32 bits each."""
        out, cuts = [], self.cuts
        for first, rest in _stretches(text):
            if first:
                out.append(self.numbers(first))
            if rest:
                out.extend(map(cuts.__getitem__, rest))
        joined = b"".join(out)
        self.places += len(joined) // 4
        return joined

    def full(self) -> bool:
        return len(self.words) >= BLOCK_WORDS or self.places >= BLOCK_PLACES


class _Cuts(dict):
    """A word that stands after a single space: the numbers of what the two together are."""

    def __init__(self, block: Block):
        self.block = block

    def __missing__(self, word: str) -> bytes:
        value = self[word] = self.block.numbers(" " + word)
        return value


#: White space as the pattern's engine has it (Unicode's White_Space); Python's own has four control characters more.
_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"([{_W}]{{2,}}|[{_W.replace(' ', '')}])")


def _stretches(text: str) -> Iterator[tuple[str, list[str]]]:
    """Pieces that no match goes across: (a string to be matched whole, words that follow with a single space before each).

    White space other than a single space is a run of its own. A match that begins in a run ends in it, but that the run's
    last character, if it is a space, begins the word after it.
    """
    pieces = _RUN.split(text)
    lead = ""
    for k, piece in enumerate(pieces):
        if k % 2:
            last = k == len(pieces) - 2 and not pieces[-1]
            if piece[-1] == " " and not last:
                if len(piece) > 1:
                    yield piece[:-1], []
                lead = " "
            elif last or len(piece) == 1:
                yield piece, []
            else:  # all but the last character, then that: the pattern leaves one before a word
                yield piece[:-1], []
                yield piece[-1], []
        elif piece:
            first, *rest = piece.split(" ")
            if rest and first == "":  # a text that begins with one space
                first, rest = " " + rest[0], rest[1:]
            ends = bool(rest) and rest[-1] == ""
            yield lead + first, rest[:-1] if ends else rest
            if ends:
                yield " ", []
            lead = ""


def _blocks(docs: DataFrame, text: str, pattern: str, keep: list[str], slots: int) -> DataFrame:
    """Rows of two kinds: packets of words (place: the slot; block, numbers, sizes, words) and documents (place: the block;
    numbers, keep...; block is null)."""
    names = docs.columns
    kinds = {c: pa.binary() for c in ("numbers", "sizes", "words")}
    order = ["place", "block", *kinds, *keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, here, count = regex.compile(pattern), TaskContext.get().partitionId(), 0
        block, fields = Block(compiled), {}
        shrink = zstandard.ZstdCompressor(level=3).compress

        def rows(n: int, given: dict) -> pa.RecordBatch:
            blank = {"place": pa.int64(), "block": pa.int64(), **kinds, **fields}
            return pa.RecordBatch.from_arrays([given.get(c) if c in given else pa.nulls(n, blank[c]) for c in order], order)

        def name() -> int:
            return (here << 24) + count

        def packets() -> pa.RecordBatch:
            block.cuts.clear()
            raw = [w.encode("utf-8", "surrogatepass") for w in block.words]
            block.words.clear()
            slot = np.fromiter((zlib.crc32(w) % slots for w in raw), np.int32, len(raw))
            order_ = np.argsort(slot, kind="stable")
            used, first = np.unique(slot[order_], return_index=True)
            parts = {"numbers": [], "sizes": [], "words": []}
            for number in np.split(order_.astype(np.uint32), first[1:]):
                some = [raw[n] for n in number.tolist()]
                parts["numbers"].append(shrink(_packed(np.diff(number, prepend=np.uint32(0)).tobytes())))
                parts["sizes"].append(shrink(_packed(np.fromiter(map(len, some), np.uint32, len(some)).tobytes())))
                parts["words"].append(shrink(b"".join(some)))
            return rows(len(used), {"place": pa.array(used, pa.int64()), "block": pa.array([name()] * len(used), pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in parts.items()}})

        def documents(numbers: list[bytes], part: pa.RecordBatch) -> pa.RecordBatch:
            return rows(len(numbers), {"place": pa.array([name()] * len(numbers), pa.int64()), "numbers": pa.array(numbers, pa.binary()), **{c: part.column(names.index(c)) for c in keep}})

        for batch in batches:
            fields.update({c: batch.schema.field(c).type for c in keep})
            first, numbers = 0, []
            for k, x in enumerate(batch.column(names.index(text))):
                numbers.append(shrink(_packed(block.add(x.as_py() or ""))))
                if block.full() or len(numbers) == ROWS or k == batch.num_rows - 1:
                    yield documents(numbers, batch.slice(first, len(numbers)))
                    first, numbers = k + 1, []
                if block.full():
                    yield packets()
                    block, count = Block(compiled), count + 1
        if block.words:
            yield packets()

    head = [T.StructField("place", T.LongType()), T.StructField("block", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in kinds]]
    return docs.mapInArrow(tidy(work), T.StructType([*head, *[docs.schema[c] for c in keep]]))


def _packed(numbers: bytes) -> bytes:
    """Numbers in 7-bit groups: frequent words come early, so most take two bytes at most."""
    x = np.frombuffer(numbers, np.uint32)
    size = 1 + (x > 0x7F) + (x > 0x3FFF) + (x > 0x1FFFFF) + (x > 0xFFFFFFF)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        out[at[has] + k] = ((x[has] >> np.uint32(7 * k)) & 0x7F) | np.where(size[has] > k + 1, 0x80, 0)
    return out.tobytes()


def _unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 0x80)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        has = first + k <= last
        out[has] |= (data[(first + k)[has]].astype(np.int64) & 0x7F) << (7 * k)
    return out


def _encoded_words(packets: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, numbers, sizes, ids): packets with their words' ids. A slot's packets are one group, so all packets of a word are
    together, and it is encoded once."""
    shared = packets.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary's table

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        piece = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=shared.value, special_tokens={}).encode_ordinary  # takes a word whole
        shrink, grow = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        known: dict[bytes, bytes] = {}
        for batch in batches:
            sizes_out, ids_out = [], []
            for sizes, words in zip(batch.column(3), batch.column(4), strict=True):
                ends = np.cumsum(_unpacked(np.frombuffer(grow(sizes.as_py()), np.uint8))).tolist()
                flat, start, found = grow(words.as_py()), 0, []
                for end in ends:
                    w = flat[start:end]
                    if (ids := known.get(w)) is None:
                        ids = np.array(piece(w.decode()), "<u4").tobytes()
                        if len(w) <= REMEMBERED:
                            known[w] = ids
                    found.append(ids)
                    start = end
                sizes_out.append(shrink(_packed(np.array([len(x) // 4 for x in found], np.uint32).tobytes())))
                ids_out.append(shrink(_packed(b"".join(found))))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sizes_out, pa.binary()), pa.array(ids_out, pa.binary())], ["block", "numbers", "sizes", "ids"])

    return packets.groupBy("place").applyInArrow(work, "block bigint, numbers binary, sizes binary, ids binary")


def ragged_take(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """data[starts[i] : starts[i] + sizes[i]] for i in which, one after another."""
    n = sizes[which]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return data[:0]
    return data[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1])]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep``, and ``ids``: each whole text's token ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    n = partitions(spark)
    path = fresh_dir(spark, "bpe-blocks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    inner = [f"keep{k}" for k in range(len(keep))]  # so that no name of ``keep`` meets one of the blocks
    docs = docs.select(*[docs[c].alias(k) for c, k in zip(keep, inner, strict=True)], docs[text].alias("text"))
    _blocks(docs, "text", pattern, inner, n).write.option("compression", "none").option("path", path).bucketBy(n, "place").sortBy("place").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the frame has found them
    words = _encoded_words(table.filter("block is not null").select("place", "block", "numbers", "sizes", "words"), ranks)
    numbered = table.filter("block is null").select("place", "numbers", *inner)

    def work(documents: pa.Table, found: pa.Table) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        spread = lambda x: _unpacked(np.frombuffer(grow(x.as_py()), np.uint8))
        numbers = [np.cumsum(spread(x)) for x in found.column("numbers")]
        sizes, ids = [spread(x) for x in found.column("sizes")], [spread(x).astype("<u4") for x in found.column("ids")]
        number = np.concatenate([*numbers, np.zeros(0, np.int64)])
        size = np.concatenate([*sizes, np.zeros(0, np.int64)])
        data = np.concatenate([*ids, np.zeros(0, "<u4")])
        start, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        start[number], length[number] = np.cumsum(size) - size, size
        for batch in documents.to_batches(max_chunksize=256):
            out = [ragged_take(data, start, length, spread(x)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(2 + k) for k in range(len(inner))), pa.array(out, pa.binary())], [*inner, "ids"])

    def whole(documents: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema([*(documents.schema.field(c) for c in inner), pa.field("ids", pa.binary())])
        return pa.Table.from_batches(list(work(documents.select(["place", "numbers", *inner]), found)), schema)

    kept = T.StructType([*(docs.schema[c] for c in inner), T.StructField("ids", T.BinaryType())])
    return numbered.groupBy("place").cogroup(words.groupBy("block")).applyInArrow(whole, kept).toDF(*keep, "ids")


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""
    size = max(ranks.values()) + 1
    table = [b""] * size
    for piece, k in ranks.items():
        table[k] = piece
    edges = np.concatenate([[0], np.cumsum([len(x) for x in table])])
    shared = tokens.sparkSession.sparkContext.broadcast((b"".join(table), edges))
    names = tokens.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, at = shared.value
        data, starts, sizes = np.frombuffer(flat, np.uint8), at[:-1], np.diff(at)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for x in part.column(names.index(ids)):
                    raw = x.as_buffer()
                    out.append(ragged_take(data, starts, sizes, np.frombuffer(raw, "<u4")).tobytes() if raw is not None and raw.size else b"")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*names, name])

    return tokens.mapInArrow(tidy(work), T.StructType([*tokens.schema.fields, T.StructField(name, T.BinaryType())]))


def round_trip_report(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The contract's columns for each document."""
    ranks = read_ranks(docs.sparkSession, vocabulary)
    both = decode(encode(docs, ranks, pattern, [*keep]), ranks)
    return both.select(*keep, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
