"""Every operator against brute force, on small fixtures and the smallest test tables."""

import hashlib
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from presswarp.llm import byte_bpe, fingerprints, language, licenses, media, mixing, near_dup, quality, queries, token_files, url_filter
from presswarp.llm.common import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, `range` int, size int, block string, component_id int"
TEXTS = [
    None, "", " ", "one", "Gnu General  Public-License, version 3 or later. gnu general public license", "a b c d e f g h i j", "A b c d e f g h i j", "cc by cc by mit license Apache license",
    "naïve café — 中文 words\tand\x0bmore\n\n  spaces \u00a0x", "the " * 3000, "x" * 5000, "!!! ??? ...", "12 34", "it's I'LL <|endoftext|> we're ﬁ İ ß Σας",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None, "x", 1, 2, "b", 3) for k, t in enumerate(TEXTS)]
    rows += [rows[5], rows[4], (None, "null id", "en", "s1", 1, "x", 1, 2, "b", 3), (None, None, None, None, 1, "x", 1, 2, "b", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(df):
    return [r.asDict() for r in df.collect()]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.quality_report(empty, labels).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert media.tile_digests(media.media_tiles(media.text_media(empty), "image")).count() == 0
    assert licenses.license_report(empty).count() == 0
    assert token_files.token_file_report(empty, queries.WORD_VOCABULARY).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), url_filter.contract_rules(spark)).count() == 0
    assert byte_bpe.round_trip_report(empty, queries.BYTE_VOCABULARY, public_tokenizers.PATTERN).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert fingerprints.edited_likeness(empty).count() == 0
    assert language.language_report(empty).count() == 0


def test_quality_learns_and_keeps_odd_rows(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_report(docs, labels)
    assert found.count() == docs.count()
    held = found.filter("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    assert all((zlib.crc32(str(k).encode()) % 4 == 2) == h for k, h in found.select("doc_id", "held_out").collect())
    assert quality.quality_report(odd, labels).filter("score between 0 and 1").count() == odd.count()
    one_class = labels.filter("quality = 1")
    assert quality.quality_report(odd, one_class).filter("predicted = 1").count() == odd.count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.7 < kept.count() / docs.count() < 1


def test_dual_coordinate_descent_reaches_the_optimum():
    """No step away from its weights lowers the hinge-loss objective."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(80)]
    y = np.array([1 if (r < 12).sum() > (r > 28).sum() else -1 for r in rows])
    ratio = quality.log_count_ratios(rows, y)
    w, b = quality.dual_coordinate_descent(rows, ratio, y, epochs=400)
    cost = np.where(y == 1, 1.0, max(1.0, (y == 1).sum() / (y == -1).sum())) * quality.C * 100

    def objective(v, c):
        return 0.5 * (v @ v + c * c) + (cost * np.maximum(0, 1 - y * quality.margins(rows, v * ratio, ratio * ratio, c))).sum()

    best = objective(w, b)
    for _ in range(300):
        step = np.zeros(quality.SPACE)
        step[:40] = rng.normal(size=40) * rng.choice([1e-3, 1e-2, 1e-1])
        assert objective(w + step, b + rng.normal() * 1e-2) > best - 1e-3 * best
    assert best < objective(np.zeros(quality.SPACE), 0.0) / 2


def mix_by_hand(rows, weights=(1, 2, 3)):
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    left, open_, target = float(sum(size.values())), set(sources), {}
    while open_:  # what is above the cap is shared again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    return size, target


def test_mix_targets_and_budgets(docs, odd):
    for frame in (docs, odd):
        rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in frame.collect()]
        size, target = mix_by_hand(rows)
        found = table(mixing.mix(frame))
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter(rows)
        for s in size:
            mine = [r for r in found if r["source"] == s]
            assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in mine)
            assert 0 <= target[s] - sum(r["taken"] for r in mine) < 1 + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
        assert sorted(map(str, found)) == sorted(map(str, table(mixing.mix(frame))))


def test_mixed_documents_have_the_taken_words(docs):
    taken = {r["doc_id"]: r["taken"] for r in table(mixing.mix(docs))}
    got = Counter()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == Counter({k: n for k, n in taken.items() if n})


def test_mix_cuts_one_row_of_equal_keys(spark):
    schema = "doc_id bigint, text string, source string"
    rows = [(None, " ".join(f"{source}{k}w{j}" for j in range(10)), source) for source, n in (("s0", 50), ("s1", 7), ("s2", 5)) for k in range(n)]
    docs = spark.createDataFrame(rows + [(1, "one two three", "s1")], schema)
    out, words = {}, {}
    for r in mixing.mixed_documents(docs).collect():
        out.setdefault(r.source, []).append(len(r.text.split()))
    for r in mixing.mix(docs).collect():
        words[r.source] = words.get(r.source, 0) + r.taken
    assert {k: sum(v) for k, v in out.items()} == words
    assert all(sum(n not in (3, 10) for n in v) <= 1 for v in out.values()) and words["s0"] % 10


def test_media_round_trip(odd, docs):
    for frame in (odd, docs):
        tiles = media.media_tiles(media.text_media(frame), "image")
        found = table(media.tile_digests(media.stored_tiles(tiles)))
        want = Counter()
        for r in frame.collect():
            raw = (r.text or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            want[(r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == want
        assert all(r["media_bytes"] >= r["payload_bytes"] and len(r["dhash"]) == 16 for r in found)


def test_images():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (37, 21, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all()
    flat = image[:, :, 0]
    assert (media.decode(media.encode_pgm(flat.tobytes(), 21)) == flat).all()
    text = b"P2\n# comment\n21 37\n255\n" + b" ".join(b"%d" % x for x in flat.ravel())
    assert (media.decode(text) == flat).all()
    assert (media.decode(b"P6 21 37 255\n" + image.tobytes()) == image).all()
    big = np.kron(flat, np.ones((8, 9)))  # each cell of the small image covers whole samples
    want = big.reshape(8, 37, 9, 21).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(flat, 8, 9), want)
    tall = rng.integers(0, 256, (media.BAND + 700, 3), dtype=np.uint8)
    assert np.allclose(media.area_resize(tall, 1, 1), tall.mean())
    assert (media.npy_array(media.npy_bytes(image)) == image).all()


def test_undecodable_media(spark):
    good = [media.encode_pgm(bytes(24 * 24), 24), b"P2 2 1 65535 65535 0", b"P5 2 1 100 \x64\x00"]
    flat = media.encode_bmp(np.zeros((2, 3, 3), np.uint8))
    bad = [
        b"junk", None, b"", b"P5 2 2 0 abcd", b"P5 0 2 255 ", b"P2 1 1 65535 70000", b"P2 1 1 255 -5", b"P2 1 1 255 99999999999999999999999", b"P2 2 1 255 7", b"P2 1 1 255 x", b"P5 99999999999999999999999 1 255 x", b"P5 1 1 100 \xc8", b"P5 4000000000 4000000000 255 x",
        flat[:18] + bytes(4) + flat[22:], flat[:22] + bytes(4) + flat[26:], flat[:40], flat[:18] + b"\xff\xff\xff\x7f" + flat[22:], flat[:18] + b"\xff\xff\xff\xff" + flat[22:],
    ]
    df = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate([*good, *bad])], "k int, image binary")
    for size in ((4, 4), (0, 0)):
        got = {r.k: (r.tile is None, r.dhash) for r in media.media_tiles(df, "image", *size).collect()}
        assert all(got[k][0] is False and len(got[k][1]) == 16 for k in range(len(good)))
        assert all(got[len(good) + k] == (True, None) for k in range(len(bad)))


def standing(found):
    """By the words of the rule, over sets of word positions."""
    kept = []
    for d in sorted(found, key=lambda d: (d[2], d[0])):
        mine = set(range(d[0], -d[1]))
        touching = [k for k in kept if mine & set(range(k[0], -k[1]))]
        if all(set(range(k[0], -k[1])) < mine for k in touching):
            kept = [k for k in kept if k not in touching] + [d]
    return sorted(kept)


def test_license_suppression(spark):
    rng = np.random.default_rng(9)
    cases = [[(0, -10, 5), (1, -4, 1), (8, -15, 2)], [(0, -10, 5), (1, -4, 1)], [(0, -4, 1), (0, -4, 2)], []]
    for _ in range(300):
        cases.append([(int(a), -int(a + n), k) for k, (a, n) in enumerate(zip(rng.integers(0, 30, rng.integers(1, 12)), rng.integers(1, 9, 12)))])
        rng.shuffle(cases[-1])
    full = [[(a, b, place, str(place), 1.0) for a, b, place in (map(int, x) for x in case)] for case in cases]
    frame = spark.createDataFrame(list(enumerate(full)), f"k int, d {licenses._KEPT}")
    got = {r.k: [tuple(x)[:3] for x in r.d] for r in frame.select("k", licenses.suppressed(F.col("d")).alias("d")).collect()}
    assert got[0] == [(1, -4, 1), (8, -15, 2)] and got[1] == [(0, -10, 5)] and got[2] == [(0, -4, 1)]
    assert all(got[k] == [x[:3] for x in standing(d)] for k, d in enumerate(full))
    assert not [r for r in licenses.license_rules() if "," in re.sub(r"\{\d+,\d+\}", "", r.regex) or "\\(" in r.regex]


def test_many_licenses_in_one_text(spark):
    lines = ["the MIT License", "Apache License, Version 2.0", "licensed under the GNU GPL v3 or later"]
    text = "\n".join(lines[k % 3] for k in range(60_000))
    began = time.time()
    r = licenses.license_report(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r.n_base, r.n_detections) == (40_000, 60_000) and time.time() - began < 30


def scan_by_hand(text):
    lowered = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    flat = " " + "".join(w + " " for w in words)
    found = []
    for place, rule in enumerate(licenses.license_rules()):
        if rule.keyword in flat:
            found += [(m.start(), -m.end(), place, rule.label) for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", flat)]
    kept = standing(found)
    every = labels | {d[3] for d in kept}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every))


def test_license_scan(odd, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len(licenses.license_rules()) > 200
    more = spark.createDataFrame([(900 + k, t) for k, t in enumerate(["Licensed under the Apache License, Version 2.0 or later", "cc-by-nc-sa 4.0, CC BY", "SPDX-License-Identifier: MIT", "BSD 3-clause license. Copyright (c) 2020 All rights reserved.", "the gnu gpl v3"])], "doc_id bigint, text string")
    for frame in (odd, docs, more):
        found = table(licenses.license_report(frame))
        want = Counter((r.doc_id, *scan_by_hand(r.text)) for r in frame.collect())
        assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) for r in found) == want
        assert all(0 <= r["score"] <= 1 for r in found)


def test_token_files(odd, docs):
    tokenizer = Tokenizer.from_file(queries.WORD_VOCABULARY)
    for frame in (odd, docs):
        want, start = [], 0
        rows = [(r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in frame.collect()]
        for k, ids in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes())):
            want.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            start += len(ids)
        found = table(token_files.token_file_report(frame, queries.WORD_VOCABULARY))
        assert sorted((tuple(r.values()) for r in found), key=lambda r: r[1]) == want


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (5, 10**12), (3000, 3000), (3000, 10**9)):
        v = np.sort(rng.integers(0, top, n))
        code = token_files.EliasFano.loads(token_files.EliasFano.encode(v).dumps())
        assert (code.select(0, n) == v).all() and all((code.select(k, min(5, n - k)) == v[k : k + 5]).all() for k in range(0, n, 11))
        assert code.n == n and (not n or len(code.places) <= (n // 256 + 1) * 8)
    assert len(token_files.EliasFano.encode(np.arange(0, 10**6, 100)).dumps()) < 10**4 * 1.4


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://COM/en/x?q", "http://a.Example.com/en/71#f", "http://xcom/en/", "http://x.com", "http://de.example.net/de/8/", "http://net/de/", "a://b://c.net/de/1", "http://a.org/es/?x", "http://a.org/es/?x", "http://a.org:80/es/", "http://a.org/\nes/"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)] + [(None, "http://a.org/es/", 1)], "page_id bigint, url string, host int")

    def by_hand(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), v == "block", h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    want = Counter((r.page_id, *by_hand(r.url)) for r in pages.collect())
    for most in (url_filter.MOST_LITERAL_BLOCKS, 0):
        url_filter.MOST_LITERAL_BLOCKS, kept = most, url_filter.MOST_LITERAL_BLOCKS
        try:
            found = url_filter.judge_urls(pages, url_filter.contract_rules(spark)).collect()
        finally:
            url_filter.MOST_LITERAL_BLOCKS = kept
        assert Counter(tuple(r) for r in found) == want
    none = url_filter.judge_urls(pages, url_filter.contract_rules(spark).limit(0)).collect()
    assert len(none) == pages.count() and all(r.rule is None for r in none)


def test_many_url_rules(spark):
    """A hundred thousand rules: the filter is one value of the plan."""
    rules = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("rule_verdict"), F.concat(F.lit("h"), "id", F.lit(".com")).alias("rule_host"), F.concat(F.lit("/p"), F.col("id") % 7).alias("rule_path"))
    pages = spark.createDataFrame([(k, f"http://www.h{50 * k}.com/p{50 * k % 7 if k % 3 else 8}/x") for k in range(3000)], "page_id bigint, url string")
    began = time.time()
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert time.time() - began < 60
    for k in range(3000):
        n = 50 * k
        assert found[k] == ((f"h{n}.com/p{n % 7}", "block" if n % 2 == 0 else "allow") if k % 3 and n < 100_000 else (None, "allow"))


def test_byte_bpe(odd, docs):
    ranks = byte_bpe.load_ranks(queries.BYTE_VOCABULARY)
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame in (odd, docs):
        want = Counter()
        for r in frame.collect():
            ids = coder.encode_ordinary(r.text or "")
            want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in byte_bpe.round_trip_report(frame, queries.BYTE_VOCABULARY, public_tokenizers.PATTERN).collect()) == want


def test_byte_bpe_cuts_are_matches(monkeypatch):
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = np.random.default_rng(4)
    pieces = ["a", "b1", " ", "  ", "\n", "\t", ".", "é", "'s", "\u00a0", "\u3000", "\x1c", "\r\n", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 9)))
        block = byte_bpe.Block(pattern)
        numbers = np.frombuffer(block.add(text), np.uint32)
        words = list(block.words)
        assert [words[k] for k in numbers] == pattern.findall(text)
        assert (byte_bpe._unpacked(np.frombuffer(byte_bpe._packed(numbers.tobytes()), np.uint8)) == numbers).all()


def test_byte_bpe_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 50)
    few = docs.limit(40).coalesce(1)
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(queries.BYTE_VOCABULARY), special_tokens={})
    want = {r.doc_id: len(coder.encode_ordinary(r.text)) for r in few.collect()}
    assert {r.doc_id: r.n_tokens for r in byte_bpe.round_trip_report(few, queries.BYTE_VOCABULARY, public_tokenizers.PATTERN).collect()} == want


def sets_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_by_hand(rows):
    sets = [(k, sets_by_hand(t)) for k, t in rows]
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return Counter((k, len(s), root(k), root(k) == k) for k, s in sets)


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    base = list(rng.choice(words, 120))
    rows = []
    for k in range(60):  # variants of one text, chains of small changes, and short texts
        text = list(base)
        for at in rng.integers(0, len(text), rng.integers(0, 6)):
            text[at] = "changed" + str(rng.integers(0, 1000))
        rows.append((k, " ".join(text)))
    for k in range(60, 90):
        base = base[2:] + [f"new{k}", f"newer{k}"]
        rows.append((k, " ".join(base)))
    rows += [(90, "a b"), (91, "A  b"), (92, "a b c d e f"), (93, ""), (94, None), (95, "\t"), (96, "a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in near_dup.near_duplicates(frame).collect()) == near_by_hand(rows)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == near_by_hand(rows)
    kept = near_dup.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in near_dup.near_duplicates(docs).collect())


def test_near_duplicates_in_a_bucket_of_a_template(spark):
    template = [f"t{k}" for k in range(88)]  # 84 of each text's 100 shingles: any two texts are at 84 / 116
    tails = [[f"u{k}x{j}" for j in range(16)] for k in range(600)]
    for k in range(10):  # but the texts of ten pairs, at 87 / 113
        tails[590 - 7 * k][:3] = tails[101 + 13 * k][:3]
    rows = [(k, " ".join(template + tail)) for k, tail in enumerate(tails)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = Counter(tuple(r) for r in near_dup.near_duplicates(frame).collect())
    assert sum(not kept for *_, kept in found) == 10
    assert found == near_by_hand(rows)


def test_near_duplicates_of_one_text_edited_at_random(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(2000)]
    base = list(rng.choice(words, 120))
    rows = []
    for k in range(600):  # few of them are alike, and all share buckets
        text = list(base)
        for at in rng.choice(120, 4, replace=False):
            text[at] = "edit" + str(rng.integers(0, 10**9))
        rows.append((k, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in near_dup.near_duplicates(frame).collect()) == near_by_hand(rows)


def test_rare_pairs_have_every_similar_pair(spark):
    rng = np.random.default_rng(8)
    sets = [rng.choice(40, size=rng.integers(1, 31), replace=False) for _ in range(150)]
    sets += [np.union1d(x, [500 + k])[1:] for k, x in enumerate(sets[:100])]
    rows = [(k, [int(v) for v in x], k % 7) for k, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "doc_id bigint, shingles array<bigint>, component bigint")
    got = {(r.a, r.b) for r in near_dup.rare_pairs(frame.select("doc_id", "shingles"), frame.select("doc_id", "component"), Scratch(spark, "rare-pairs")).collect()}
    similar = {(a, b) for (a, x, c), (b, y, d) in combinations(rows, 2) if c != d and 100 * len({*x} & {*y}) >= 75 * len({*x} | {*y})}
    assert similar and similar <= got and all(a % 7 != b % 7 for a, b in got)


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = ("the first text of several words here", "a second text that is quite unlike it", "yet another text that stands alone now")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, None), (9, ""), (7, c), (7, None), (7, c), (11, None), (11, ""), (None, b), (None, None), (12, "new words"), (13, "new words"), (2, "own text of two"), (2, "other text of two")]
    found = sorted(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "component_id", "kept").collect(), key=str)
    want = [(k, 3 if k in (3, 5, 9) else 12 if k == 13 else k, k not in (5, 9, 13)) for k, _ in rows if k is not None] + [(None, 3, False), (None, None, True)]
    assert [tuple(r) for r in found] == sorted(want, key=lambda x: f"Row(doc_id={x[0]}, component_id={x[1]}, kept={x[2]})")


def test_near_duplicates_of_odd_rows(odd):
    found = table(near_dup.near_duplicates(odd))
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found}
    assert by[6]["component_id"] == 5 and not by[6]["kept"]
    assert all(r["n_shingles"] == 0 and r["kept"] for k, r in by.items() if k in (0, 1, 2))


def test_keep_one_each_of_null_ids(spark):
    rows = [(1, "a b c d e f g"), (None, "A b c  d e f g"), (None, "clean text of its own"), (None, None), (None, ""), (2, "a b c d e f g"), (3, "another one")]
    kept = near_dup.keep_one_each(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows[k] for k in (0, 2, 3, 4, 6))


def test_fingerprints(odd, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (docs, odd.filter("doc_id is not null")):
        rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (-r[0], r[1].encode()))
        want, errors, edges = Counter(), [], {}
        for k, (i, text) in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
            a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (text, edited))
            edges.setdefault(i, []).append(sum((a & b).values()) / max(1, sum((a | b).values())))
        found = table(fingerprints.edited_likeness(frame))
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
        errors = [r["near_edited"] - edges[r["doc_id"]][0] for r in found if len(edges[r["doc_id"]]) == 1 and r["n_chars"] > 40]
        assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 2.5 * (0.25 / fingerprints.SAMPLES) ** 0.5
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    copies = table(fingerprints.edited_likeness(spark.createDataFrame([(k, "same text here again again") for k in range(9)], "doc_id bigint, text string")))
    assert len({r["fingerprint"] for r in copies}) == 1 and all(r["near_next"] == 1 for r in copies)
    assert fingerprints.edited_likeness(odd).count() == odd.count()


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.language_report(docs)
    held = found.filter("held_out").join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert (held.lang_pred == held.truth).mean() > 0.97
    got = {r.doc_id: r for r in language.language_report(odd).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 11, 12))
    assert got[9].lang_pred == "en"
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() > 0.98 * docs.count()


def test_language_rejects_gibberish_and_marks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(6)
    rows = [(10**6 + k, "".join(rng.choice(list("qxzjkvwpbgfhmdclrsnioate      "), 200)), None, "s") for k in range(50)]
    rows += [(2 * 10**6 + k, t, None, "s") for k, t in enumerate(["½", "②", "١٢", "___", "ª 1"])]
    more = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    kept = {r.doc_id for r in language.keep_identified(more).select("doc_id").collect()}
    assert len([k for k in kept if k < 10**6]) > 0.99 * docs.filter("text rlike '[a-z]'").count()
    assert len([k for k in kept if 10**6 <= k < 2 * 10**6]) <= 5 and not [k for k in kept if 2 * 10**6 <= k < 2 * 10**6 + 4]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.language_report(more).filter("doc_id >= 2000000").collect()}
    assert all(got[2 * 10**6 + k] == ("und", 0.0) for k in range(4)) and got[2 * 10**6 + 4][0] != "und"


def ridge_by_hand(model_texts, langs, texts):
    """Plain n-gram sets for the kernel, and the ridge's normal equations over the Nyström features."""
    bits = lambda t: {int(k) for k in np.flatnonzero(language.presence([t])[0])}
    kernel = lambda x, y: len(x & y) / max(1, len(x)) ** 0.5 / max(1, len(y)) ** 0.5
    turn = np.argsort([langs[:k].count(x) for k, x in enumerate(langs)], kind="stable")
    marks = [bits(model_texts[k]) for k in turn[: language.LANDMARKS]]
    inner = np.array([[kernel(x, y) for y in marks] for x in marks])
    value, vector = np.linalg.eigh(inner)
    good = value > 1e-6 * value.max()
    feature = lambda t: np.array([kernel(bits(t), y) for y in marks]) @ vector[:, good] / np.sqrt(value[good])
    x, names = np.array([feature(t) for t in model_texts]), sorted(set(langs))
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    w = np.diag([1 / langs.count(k) / len(names) for k in langs])
    mean, base = w.diagonal() @ x, w.diagonal() @ y
    a = np.linalg.inv((x - mean).T @ w @ (x - mean) + language.RIDGE / len(x) * np.eye(x.shape[1])) @ (x - mean).T @ w @ (y - base)
    return names, np.array([(feature(t) - mean) @ a + base for t in texts])


def test_language_values_by_hand(docs):
    rows = [r for r in docs.select("text", "lang").collect() if r.text and r.lang][:40]
    texts, langs = [r.text[:400] for r in rows], [r.lang for r in rows]
    names, want = ridge_by_hand(texts[:30], langs[:30], texts[30:])
    model = language.fit(texts[:30], langs[:30])
    got = language.normed(language.presence(texts[30:])) @ model["matrix"] + model["bias"]
    assert model["names"] == names and np.allclose(got, want, atol=2e-3)


def test_clashing_columns(spark):
    """Columns of an output's name are replaced, all others passed through."""
    extra = ["score", "Value", "lang_pred", "flat", "detections", "tile", "dhash", "__score", "__lang", "gone", "mix_size", "cut", "place", "block"]
    rows = [(k, f"the cat number {k} sat on the mat and the dog ran to the house", "en" if k % 2 else "de", "s", *extra) for k in range(8)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *extra])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id bigint, quality int, toxic int")
    others = lambda df, *out: {tuple(r) for r in df.select(*[c for c in extra if c.lower() not in out]).collect()} == {tuple(c for c in extra if c.lower() not in out)}
    model = quality.train(frame, labels)
    assert others(quality.score(frame, model), "score") and quality.score(frame, model).filter("score between 0 and 1").count() == 8
    assert quality.keep_good(frame, labels, 0.0).columns == frame.columns and quality.keep_good(frame, labels, 0.0).count() == 8
    found = language.predict(frame, language.train(frame))
    assert others(found, "score", "value", "lang_pred") and found.filter("lang_pred in ('de', 'en')").count() == 8
    assert language.keep_identified(frame, -9.0).columns == frame.columns
    assert others(near_dup.keep_one_each(frame)) and near_dup.keep_one_each(frame).columns == frame.columns
    assert others(mixing.mixed_documents(frame)) and mixing.mixed_documents(frame).columns == frame.columns
    assert others(licenses.scan_licenses(frame), "flat", "detections")
    image = frame.withColumn("image", F.lit(bytearray(media.encode_pgm(bytes(576), 24))))
    assert others(media.media_tiles(image, "image"), "tile", "dhash")
    tokens = byte_bpe.encode(frame, byte_bpe.load_ranks(queries.BYTE_VOCABULARY), public_tokenizers.PATTERN, ["doc_id", "place", "block", "score"])
    assert {tuple(r)[1:4] for r in tokens.collect()} == {("place", "block", "score")}


def test_every_language_is_learned(spark, monkeypatch):
    """Three hundred languages, more than there are landmarks; short texts are judged by what they say, without a limit of length."""
    rng = np.random.default_rng(8)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüñçé"), 5)) for _ in range(12)] for _ in range(300)]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    rows = [(1000 * k + j, text(k, 30), f"l{k:03}") for k in range(300) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs)
    assert len(model["names"]) == 300 and model["right"] is not None
    found = language.predict(docs, model).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.9
    assert language.predict(spark.createDataFrame([(None,)], "text string"), model).first().lang_pred == "und"
    monkeypatch.setattr(language, "SAMPLE", 30)
    monkeypatch.setattr(language, "LEAST_PER_LANGUAGE", 2)
    assert len(language.train(docs)["names"]) > 200


def test_short_texts_are_judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    some = [r.text.split()[:n] for r in docs.filter("text is not null").limit(100).collect() for n in (1, 2, 3, 5, 8)]
    short = spark.createDataFrame([(10**6 + k, " ".join(w), None) for k, w in enumerate(some)], docs.schema)
    kept = language.keep_identified(docs.unionByName(short)).filter("doc_id >= 1000000").count()
    assert kept > 0.97 * short.filter("text rlike '[a-zA-Z]'").count()


def test_kernel_is_the_blended_spectrum():
    texts = ["abcab", "abd  x", "zz"]
    seen = language.presence(texts)

    def grams(t):
        t = re.sub(r"\s+", " ", f" {t} ")
        return {t[k : k + n] for n in language.ORDERS for k in range(len(t) - n + 1)}

    inner = seen @ seen.T
    for a, x in enumerate(texts):
        for b, y in enumerate(texts):
            assert inner[a, b] == len(grams(x) & grams(y))
