"""Fill-in-middle transformation over seekable compressed frames.

A text is cut into tokens (space before a word belongs to it, space at the end is a token of its own) and stored as
independent zstandard frames of about ``FRAME_BYTES``, each with the number of tokens and characters before it and in it. To take
the text apart, only the frames in which a cut falls are decompressed; their halves are compressed anew, all other frames
are moved as they are. The output of a document thus is a list of frames in a new order, its marks among them, which is
streamed for digests or joined to a text.

``store`` writes the frames as a table in the shared folder. Nothing is shuffled, and every row is worked on by itself.

Defined results: a null text is stored as an empty one; empty texts and texts that have a mark in them stay plain; a null
doc_id has the hash of ``42:``; rows of equal doc_id and text have equal values; an empty table gives an empty result; other
columns are passed through, but those of the output's names are replaced. Texts of any length are stored whole, and a token
that is longer than a frame has a frame of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

FRAME_BYTES = 1 << 16
LEVEL = 6
SEED = "42:"
PLAIN_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_CODER, _DECODER = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A frame: tokens and characters before it, and its text as a zstandard frame.
FRAMES = "array<struct<units: bigint, chars: bigint, data: binary>>"
_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Where the tokens of a text's bytes end."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1  # a word ends before space
    return np.append(ends, len(data))  # the last word, or the space after it


def char_count(data: bytes | np.ndarray) -> int:
    """Characters of whole UTF-8: bytes that begin one."""
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def packed(text: bytes, size: int = FRAME_BYTES) -> tuple[list[dict], int, int]:
    """Frames of a text, and how many tokens and characters it has. A frame ends at the last token's end within size, or after its first token."""
    data = np.frombuffer(text, np.uint8)
    ends, frames, unit, at, chars = unit_ends(data), [], 0, 0, 0
    while unit < len(ends):
        after = max(unit + 1, int(np.searchsorted(ends, at + size, side="right")))
        end = int(ends[after - 1])
        frames.append({"units": unit, "chars": chars, "data": _CODER.compress(text[at:end])})
        chars += char_count(data[at:end])
        unit, at = after, end
    return frames, len(ends), chars


def unpacked(frames: list[dict]) -> Iterator[bytes]:
    """The frames' texts, one after another."""
    for f in frames:
        yield _DECODER.decompress(f["data"])


def parts(frames: list[dict], cuts: list[int]) -> tuple[list[list[dict]], list[int]]:
    """The frames of the pieces between cuts (ascending numbers of tokens), and the characters before each cut. Frames in which no
    cut falls are not decompressed."""
    pieces, rest, chars_before = [], list(frames), []
    for cut in cuts:
        own = next((i for i, f in enumerate(rest) if f["units"] >= cut), len(rest))
        before, after = rest[:own], rest[own:]
        if after and after[0]["units"] == cut:
            chars = after[0]["chars"]
        elif not before:  # again the end of the text
            chars = chars_before[-1]
        else:
            frame = before.pop()
            text = next(unpacked([frame]))
            at = int(unit_ends(np.frombuffer(text, np.uint8))[cut - frame["units"] - 1])
            chars = frame["chars"] + char_count(text[:at])
            before.append(frame | {"data": _CODER.compress(text[:at])})
            if at < len(text):
                after.insert(0, {"units": cut, "chars": chars, "data": _CODER.compress(text[at:])})
        pieces.append(before)
        chars_before.append(chars)
        rest = after
    return [*pieces, rest], chars_before


def _mark(mark: bytes) -> dict:
    return {"units": None, "chars": None, "data": _CODER.compress(mark)}


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table of docs in which ``frames``, ``units``, ``chars`` and ``marked`` (it has a mark in it) stand for the text."""
    docs = docs.drop("frames", "units", "chars", "marked")
    columns = docs.columns
    names = [n for n in columns if n != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [(x.as_py() or "").encode() for x in part.column(columns.index(text))]
                found = [packed(x) for x in texts]
                marked = [any(m in x for m in (PREFIX, SUFFIX, MIDDLE)) for x in texts]
                new = [pa.array([f[0] for f in found], _FRAMES), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array(marked, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(columns.index(n)) for n in names), *new], [*names, "frames", "units", "chars", "marked"])

    schema = T.StructType([*(docs.schema[n] for n in names), *T.StructType.fromDDL(f"frames {FRAMES}, units bigint, chars bigint, marked boolean").fields])
    return Scratch(docs.sparkSession, "frames").put(docs.mapInArrow(work, schema))


def draw(key: str, place: int) -> Column:
    """The place-th group of 8 hex digits of the key's hash, as a number."""
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("bigint")


def choose(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds form, and first_cut and second_cut in tokens (null for plain)."""
    plain = (F.col("units") == 0) | F.col("marked") | (draw(key, 2) % 100 >= PLAIN_PERCENT)
    a, b = draw(key, 0) % (F.col("units") + 1), draw(key, 1) % (F.col("units") + 1)
    form = F.when(plain, "plain").when(draw(key, 3) % 100 < SPM_PERCENT, "spm").otherwise("psm")
    return stored.withColumns({"form": form, "first_cut": F.when(~plain, F.least(a, b)), "second_cut": F.when(~plain, F.greatest(a, b))})


def fill_in_middle(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """stored: from ``store``. Adds form, prefix_chars, middle_chars and ``output``, the frames in the form's order; drops frames."""
    chosen = choose(stored.drop("form", "first_cut", "second_cut", "prefix_chars", "middle_chars", "output"), key)
    names = chosen.columns
    keep = [n for n in names if n not in ("frames", "first_cut", "second_cut")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                outputs, prefixes, middles = [], [], []
                for frames, form, a, b in zip(*(part.column(names.index(n)).to_pylist() for n in ("frames", "form", "first_cut", "second_cut")), strict=True):
                    if form == "plain":
                        outputs.append(frames)
                        prefixes.append(None)
                        middles.append(None)
                        continue
                    (prefix, middle, suffix), (before, upto) = parts(frames, [a, b])
                    p, s, m = [_mark(PREFIX), *prefix], [_mark(SUFFIX), *suffix], [_mark(MIDDLE), *middle]
                    outputs.append([*p, *s, *m] if form == "psm" else [*s, *p, *m])
                    prefixes.append(before)
                    middles.append(upto - before)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in keep), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, _FRAMES)], [*keep, "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([*(chosen.schema[n] for n in keep), *T.StructType.fromDDL(f"prefix_chars bigint, middle_chars bigint, output {FRAMES}").fields])
    return chosen.mapInArrow(work, schema)


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from. A mark can't arise where pieces meet, for none can begin inside another."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, rest = output[len(PREFIX) :].split(SUFFIX, 1)
        suffix, middle = rest.split(MIDDLE, 1)
    else:
        suffix, rest = output[len(SUFFIX) :].split(PREFIX, 1)
        prefix, middle = rest.split(MIDDLE, 1)
    return prefix + middle + suffix


def _mapped(df: DataFrame, drop: str, new: list[tuple[str, str, pa.DataType]], f) -> DataFrame:
    """Puts columns, which f makes of a row's output and form, in the place of column drop."""
    names = df.columns
    keep = [n for n in names if n not in (drop, *(n for n, _, _ in new))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [f(o, x) for o, x in zip(part.column(names.index("output")).to_pylist(), part.column(names.index("form")).to_pylist(), strict=True)]
                arrays = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in keep), *arrays], [*keep, *(n for n, _, _ in new)])

    return df.mapInArrow(work, T.StructType([*(df.schema[n] for n in keep), *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in new)).fields]))


def texts(transformed: DataFrame) -> DataFrame:
    """``output`` as a text."""
    return _mapped(transformed, "output", [("output", "string", pa.string())], lambda o, _: [b"".join(unpacked(o)).decode()])


def restore(transformed: DataFrame) -> DataFrame:
    """``text``, rebuilt from output and form, in the place of output."""
    return _mapped(transformed, "output", [("text", "string", pa.string())], lambda o, form: [restored(b"".join(unpacked(o)), form).decode()])


def digests(transformed: DataFrame) -> DataFrame:
    """output_sha256 and restored_sha256 in the place of output: frames are streamed in order, the text is rebuilt from what they say."""

    def both(output: list[dict], form: str) -> list[str]:
        sha, whole = hashlib.sha256(), []
        for piece in unpacked(output):
            sha.update(piece)
            whole.append(piece)
        return [sha.hexdigest(), hashlib.sha256(restored(b"".join(whole), form)).hexdigest()]

    return _mapped(transformed, "output", [("output_sha256", "string", pa.string()), ("restored_sha256", "string", pa.string())], both)


def fim_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    found = digests(fill_in_middle(store(docs.select("doc_id", "text"))))
    return found.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
