"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of character n-grams (1 to 4 characters,
hashed) that both have, over the root of the product of how many each has. Nyström landmarks are texts of the training
sample; a text's features are its kernel values with them, whitened by the landmarks' own kernel matrix; one ridge
regression for each language against the rest is fit to the features. Because every step after the n-grams is linear, the
score of a batch of texts is one product of its presence matrix with an (n-grams x languages) matrix.

The model is fit on a bounded sample, chosen by a hash of the id: about SAMPLE_PER_LANGUAGE texts of each language, fewer but no fewer
than LEAST_PER_LANGUAGE where that would be more than SAMPLE in all (each time at most 1.5 times as many, but for chance), and
LANDMARKS of them. The driver gets the sample's n-grams as bits, 4 KB a text however long it is. Every language is learned, and every
whole text is classified.

Defined results: null texts and texts without a letter are ``und`` with score 0; ids with the held-out remainder, null ids
and null languages are never learned from; if nothing can be learned all is ``und``; ties go to the language that sorts
first; an empty table gives an empty result; other columns are passed through, but those of the output's names are replaced; rows that
agree in id, text and language are learned from once. A letter is what Unicode's categories L* have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, free_name, tidy

SAMPLE_PER_LANGUAGE = 250
LEAST_PER_LANGUAGE = 10
SAMPLE = 25_000  # texts in all, unless there are so many languages that LEAST_PER_LANGUAGE of each are more
LANDMARKS = 240
ORDERS = (1, 2, 3, 4)
BITS = 15  # of hashed n-grams
RIDGE = 0.1
BATCH = 64
LEAST_VALUE = 0.2  # texts of a language are near 1, gibberish and languages not learned mostly below
EVIDENCE = 100  # n-grams that say all; with fewer, less is asked for in proportion
BROADCAST_LANGUAGES = 100_000
_M = np.uint64(0x9E3779B97F4A7C15)


def presence(texts: list[str]) -> np.ndarray:
    """texts x 2**BITS: does the text have the n-gram. Lower case; runs of space count as one."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for k, text in enumerate(texts):
        x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        blank = x <= np.uint64(32)
        x = np.where(blank, np.uint64(32), x)[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
        code = np.zeros(len(x), np.uint64)
        for n in ORDERS:
            if len(x) < n:
                break
            code = (code[: len(x) - n + 1] + x[n - 1 :] + np.uint64(n)) * _M
            code ^= code >> np.uint64(32)
            out[k, ((code * _M) >> np.uint64(64 - BITS)).astype(np.int64)] = 1.0
    return out


def normed(seen: np.ndarray) -> np.ndarray:
    return seen / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1.0))


def fit(texts: list[str], langs: list[str]) -> dict:
    return fit_bits(np.packbits(presence(texts) > 0, axis=1), langs)


def fit_bits(bits: np.ndarray, langs: list[str]) -> dict:
    """bits: texts x 2**BITS / 8, the presence matrix packed."""
    names, at = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else (np.zeros(0), np.zeros(0, np.int64))
    if not len(names):
        return {"names": [], "matrix": np.zeros((1 << BITS, 0), np.float32), "right": None, "bias": np.zeros(0), "base": 0.0}
    seen = lambda rows: normed(np.unpackbits(rows, axis=1).astype(np.float32))
    # rows come in hash order; landmarks are spread over the languages, each row by its number within its own
    count = np.bincount(at)
    own = np.argsort(at, kind="stable")
    turn = np.empty(len(at), np.int64)
    turn[own] = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    landmark = seen(bits[np.argsort(turn, kind="stable")[:LANDMARKS]])
    inner = landmark @ landmark.T
    value, vector = np.linalg.eigh(inner.astype(np.float64))
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    features = np.concatenate([(seen(bits[k : k + BATCH]) @ landmark.T) @ whiten for k in range(0, len(bits), BATCH)])
    weight = (1 / count / len(names))[at][:, None]  # each language weighs the same; 1 in all
    mean, base = (weight * features).sum(axis=0), 2 / len(names) - 1
    centred = features - mean
    # targets are 1 for a text's own language and -1 for the others: by language, twice its own texts' sum, less what all texts have
    sums = np.zeros((len(names), centred.shape[1]))
    np.add.at(sums, at, weight * centred)
    sums = 2 * sums - (1 + base) * sums.sum(axis=0)
    a = np.linalg.solve(centred.T @ (weight * centred) + RIDGE / len(bits) * np.eye(centred.shape[1]), sums.T)
    right = (whiten @ a).astype(np.float32)
    few = len(names) <= len(landmark)  # one matrix then is smaller than two
    return {"names": names.tolist(), "matrix": landmark.T @ right if few else landmark.T.copy(), "right": None if few else right, "bias": base - mean @ a, "base": base}


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """docs: (doc_id, text, lang). Learns only from ids whose crc32 modulo 3 is not 1."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    least = max(LEAST_PER_LANGUAGE, min(per_language, SAMPLE // max(1, languages)))
    counts = counts.select(F.col("lang").alias("counted"), (1.5 * least / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    chosen = known.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, (F.col("lang") == F.col("counted")) & (draw < F.col("share")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                bits = np.packbits(presence(part.column(3).to_pylist()) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([r.tobytes() for r in bits], pa.binary())], ["doc_id", "digest", "lang", "bits"])

    rows = chosen.select("doc_id", F.xxhash64("text").alias("digest"), "lang", "text").mapInArrow(tidy(work), "doc_id bigint, digest bigint, lang string, bits binary")
    table = rows.dropDuplicates(["doc_id", "digest", "lang"]).orderBy(F.xxhash64("doc_id"), "doc_id", "digest", "lang").select("lang", "bits").toArrow()
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, 1 << BITS - 3)
    return fit_bits(bits, table.column("lang").to_pylist())


def predict(docs: DataFrame, model: dict, text: str = "text", lang: str = "lang_pred", score: str = "score", value: str = "value", evidence: str = "evidence") -> DataFrame:
    """Adds the predicted language, a score from 0 to 1 (softmax of the languages' values), the best language's own value, scaled
    so that it does not depend on how many languages there are: 1 is the target, 0 the mean of all texts (null for ``und``; 1 where
    only one language is learned), and how much the text says: its n-grams over EVIDENCE, 1 at most. Columns of these names are
    replaced."""
    docs = docs.drop(*{lang, score, value, evidence})
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)  # n-grams x languages floats

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                texts = part.column(names.index(text)).to_pylist()
                letters = np.array([bool(x) and any(map(str.isalpha, x)) for x in texts])
                seen = presence([x or "" for x in texts])
                grams = np.minimum(1.0, seen.sum(axis=1) / EVIDENCE)
                if m["names"]:
                    values = normed(seen) @ m["matrix"]
                    values = (values if m["right"] is None else values @ m["right"]) + m["bias"]
                    best, top = values.argmax(axis=1), values.max(axis=1)
                    sure = np.where(letters, 1 / np.exp(4 * (values - top[:, None])).sum(axis=1), 0.0)
                    top = (top - m["base"]) / (1 - m["base"]) if m["base"] < 1 else np.ones(len(texts))
                    found = [m["names"][b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                else:
                    letters, found, sure, top = np.zeros(len(texts), bool), ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                new = [pa.array(found, pa.string()), pa.array(sure, pa.float64()), pa.array(top, pa.float64(), mask=~letters), pa.array(grams, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, lang, score, value, evidence])

    return docs.mapInArrow(tidy(work), T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), *(T.StructField(c, T.DoubleType()) for c in (score, value, evidence))]))


def language_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "value", "evidence")


def keep_identified(docs: DataFrame, least: float = LEAST_VALUE) -> DataFrame:
    """Documents in a known language, with their columns: ``und`` is rejected, and texts whose best language's value is below
    ``least``, as that of gibberish and of languages not learned is; of texts that say little the same part of it is asked for."""
    names = [free_name(c, docs.columns) for c in ("lang_pred", "lang_score", "lang_value", "lang_evidence")]
    found = predict(docs, train(docs), "text", *names)
    return found.filter((F.col(names[0]) != "und") & (F.col(names[2]) >= least * F.col(names[3]))).drop(*names)
