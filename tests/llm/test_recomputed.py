"""Quality scores and fingerprints computed anew, one row and one number at a time."""

import math
import re
import struct

import xxhash

from presswarp.llm import fingerprints, quality

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    return x ^ (x >> 29)


def shape(word):
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


def score_by_hand(text, model):
    m = 0x9E3779B97F4A7C15
    words = text.split()
    w = [xxhash.xxh32_intdigest(x.lower().encode()) for x in words]
    s = [(xxhash.xxh32_intdigest(shape(x).encode()) * 2 + (i > 0 and w[i] == w[i - 1])) & MASK for i, x in enumerate(words)]
    grams = {mixed((x * m + 1) & MASK) for x in w} | {mixed((x * m + 3) & MASK) for x in s}
    grams |= {mixed((((a * m + b) & MASK) * m + 2) & MASK) for a, b in zip(w, w[1:])}
    pairs = [(a * m + b) & MASK for a, b in zip(s, s[1:])]
    grams |= {mixed((p * m + 4) & MASK) for p in pairs} | {mixed((((p * m + c) & MASK) * m + 5) & MASK) for p, c in zip(pairs, s[2:])}
    places = {g >> 46 for g in grams}
    total, square = sum(float(model["weight"][p]) for p in places), sum(float(model["square"][p]) for p in places)
    return 1 / (1 + math.exp(-max(-30, min(30, model["slope"] * (total + model["b"]) / math.sqrt(square + 1) + model["offset"]))))


def test_quality_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    extra = spark.createDataFrame([(10**6, ""), (10**6 + 1, None), (10**6 + 2, "one"), (10**6 + 3, "a a A  a\n42 Über-x!")], "doc_id bigint, text string")
    rows = quality.score(docs.select("doc_id", "text").unionByName(extra), model).collect()
    assert len(rows) == docs.count() + 4
    assert all(abs(r.score - score_by_hand(r.text or "", model)) < 1e-5 for r in rows)
    assert len({round(r.score, 3) for r in rows}) > 20


def hashed(word, k):
    """The engine's hash of (hash of the word, k)."""
    term = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<i", k), seed=xxhash.xxh64_intdigest(struct.pack("<Q", term), seed=42))


def samples_by_hand(text):
    """Consistent weighted sampling: of each sample the word with the least a = c / (y e^r), where ln y = r (t - b) and t = floor(ln weight / r + b); r and c are
    gamma variates of two uniform ones each."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = []
    for k in range(fingerprints.SAMPLES):
        best = None
        for word in set(words):
            h, g = hashed(word, k), hashed(word, -1 - k)
            uniform = lambda x, shift: ((x >> shift & (1 << 25) - 1) + 0.5) / (1 << 25)
            r, c = -math.log(uniform(h, 0) * uniform(h, 25)), -math.log(uniform(g, 0) * uniform(g, 25))
            b = ((h >> 50 & 16383) + 0.5) / 16384
            t = math.floor(math.log(words.count(word)) / r + b)
            a = math.log(c) - r * (t - b + 1)
            best = min(best or (math.inf, 0), (a, (g ^ t & MASK) & 0xFFFFFFFF))
        out.append(best[1] if best else 0)
    return out


def test_fingerprints(spark):
    rows = [(r.doc_id, " ".join(r.text.split()[:150])) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect() if r.text]
    rows += [(10**6, "a a a b"), (10**6 + 1, "one"), (10**6 + 2, ""), (10**6 + 3, "Ü ü\n中 中 x")]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "k bigint, text string"), ["k"], "text").collect()
    texts = dict(rows)
    same = [x == y for r in found for x, y in zip(r.sample, samples_by_hand(texts[r.k]))]
    assert len(same) == len(rows) * fingerprints.SAMPLES and sum(same) >= len(same) - 2  # two logarithms may differ in their last bit
