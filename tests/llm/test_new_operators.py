"""Fill-in-middle, whitening and decontamination against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswarp.llm import decontamination, fill_in_middle, whitening

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
NOT_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " ", "\t\n", "one", " one", "one ", "a b c d e f g h i j k l", "naïve — 中文 words\x0bmore\n\n  x y 😀 ", "has <P> in it", "<S>", "a <M", "M> b", "x" * 5000, "word " * 3000, "<P", "a<S b<S c<S d<P e<M f< g"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(TEXTS * 4)] + [(None, None, "x", 1, "y"), (None, "a b c", "x", 1, "y"), (7, TEXTS[7], "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, form string, n_words int, frames string")


def fim_by_hand(doc_id, text):
    text = text or ""
    tokens, h = TOKEN.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    n, (h1, h2, h3, h4) = len(tokens), (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text)), out


@pytest.mark.parametrize("size", [3, 200, fill_in_middle.FRAME_BYTES])
def test_fill_in_middle(odd, docs, size, monkeypatch):
    monkeypatch.setattr(fill_in_middle.packed, "__defaults__", (size,))
    for frame in (odd, docs) if size == fill_in_middle.FRAME_BYTES else (odd,):
        want = [fim_by_hand(r.doc_id, r.text) for r in frame.collect()]
        found = fill_in_middle.fim_report(frame)
        assert Counter(map(tuple, found.collect())) == Counter(w for w, _ in want)
        assert {w[2] for w, _ in want} == {"plain", "psm", "spm"}
        whole = fill_in_middle.fill_in_middle(fill_in_middle.store(frame))
        assert Counter(r.output for r in fill_in_middle.texts(whole).collect()) == Counter(o for _, o in want)
        assert Counter(r.text for r in fill_in_middle.restore(whole).collect()) == Counter(r.text or "" for r in frame.collect())


def test_frames_are_moved_and_only_cut_ones_rewritten():
    """A text of many frames: all but two of them are in the output byte by byte."""
    text = " ".join(f"w{k}" for k in range(5000)).encode()
    frames, n, chars = fill_in_middle.packed(text, 500)
    assert n == 5000 and chars == len(text) and len(frames) > 50
    assert all(f["units"] == len(TOKEN.findall(b"".join(fill_in_middle.unpacked(frames[:k])).decode())) for k, f in enumerate(frames[:5]))
    pieces, before = fill_in_middle.parts(frames, [1234, 3456])
    kept = {f["data"] for p in pieces for f in p} & {f["data"] for f in frames}
    assert len(kept) == len(frames) - 2
    got = [b"".join(fill_in_middle.unpacked(p)).decode() for p in pieces]
    assert "".join(got) == text.decode() and [len(TOKEN.findall(g)) for g in got] == [1234, 3456 - 1234, 5000 - 3456]
    assert before == [len(got[0]), len(got[0]) + len(got[1])]


def test_parts_of_odd_texts():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "é", " ", "\n", "bc", "中", "<", "S>", "\x1c", "\x85"], rng.integers(1, 14)))
        tokens = TOKEN.findall(text)
        frames, n, chars = fill_in_middle.packed(text.encode(), int(rng.integers(1, 9)))
        assert (n, chars) == (len(tokens), len(text))
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        got = [b"".join(fill_in_middle.unpacked(p)).decode() for p in fill_in_middle.parts(frames, [a, b])[0]]
        assert got == ["".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])]


def test_fill_in_middle_passes_columns(odd):
    found = fill_in_middle.texts(fill_in_middle.fill_in_middle(fill_in_middle.store(odd)))
    assert found.columns == ["doc_id", "n_words", "units", "chars", "marked", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_in_middle.fim_report(odd.limit(0)).count() == 0


# ---- whitening


def whiten_by_hand(rows):
    """rows: (vec_id, list). By the dense eigensolver, over exact sums."""
    usable = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    length = Counter(len(v) for _, v in usable)
    d = min(length, key=lambda n: (-length[n], n))
    x = [(k, [math.floor(256 * c) for c in v]) for k, v in usable if len(v) == d]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    e, u = np.linalg.eigh(np.cov(np.array(fit, float).T, bias=True).reshape(d, d))
    return x, n, sums, e[::-1], u[:, ::-1]


def check_whitening(frame):
    x, n, sums, e, u = whiten_by_hand([(r.vec_id, r.embedding) for r in frame.collect()])
    found = whitening.whitening_report(frame)
    rows = found.collect()
    k = min(4, int((e > 1e-12 * max(e[0], 1e-300)).sum()))
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, c) for i, _ in x for c in range(1, k + 1))
    signs, by = {}, {}
    for i, v in x:
        by.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(v, sums)), (np.array(v) - np.array(sums) / n) @ u[:, :k] / np.sqrt(e[:k])))
    for r in rows:
        near = [w for dev, w in by[r.vec_id] if dev == (r.deviation if r.deviation is not None else dev)]
        c = r.component - 1
        sign = signs.setdefault(c, None) or (1 if any(abs(w[c] - r.whitened) < 1e-8 * max(1, abs(w[c])) for w in near) else -1)
        if max(abs(w[c]) for w in near) > 1e-6:
            signs[c] = sign
        assert any(abs(sign * w[c] - r.whitened) < 1e-7 * max(1, abs(w[c])) for w in near)
        assert r.n == n and abs(r.explained - e[c] / e.sum()) < 1e-10 and r.identity_error < 1e-9
    return rows


def test_whitening(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert len(check_whitening(frame)) == 4 * frame.count()


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]).tolist()) for k in range(200)]
    rows += [(k, rows[0][1]) for k in range(1000, 1300)] + [(0, rows[0][1]), (None, rows[1][1]), (None, rows[2][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [math.nan] * 6), (2004, [1.0, 2.0, math.inf, 0.0, 0.0, 0.0]), (2005, [1.0, 2.0]), (2006, [-math.inf] * 6), (2007, [300.0, -300.0, 0.0, 1e-9, -1e-9, 0.0]), (2008, [9e3, 0.0, 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id bigint, embedding array<double>, component string, n string"
    found = check_whitening(spark.createDataFrame([(*r, "x", "y") for r in rows], schema))
    assert not {r.vec_id for r in found} & set(range(2000, 2007)) and {2007, 2008} < {r.vec_id for r in found}
    assert whitening.whitening_report(spark.createDataFrame([(1, None), (2, [])], "vec_id bigint, embedding array<float>")).count() == 0
    assert whitening.whitening_report(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    same = spark.createDataFrame([(1, [0.5, 1.5]), (2, [0.5, 1.5])], "vec_id bigint, embedding array<float>")
    assert whitening.whitening_report(same).count() == 0  # no variance
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(10)], "vec_id bigint, embedding array<float>")
    assert {r.component for r in check_whitening(line)} == {1}


def test_whitening_of_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=3) * 1e7).tolist()) for k in range(300)] + [(999, [1e30, 0.0, 0.0])]
    found = whitening.whitening_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(found) == 301 * 3 and all((r.deviation is None) == (r.vec_id == 999 or r.deviation is None) for r in found)
    small = [(k, [float(v) for v in rng.integers(-9, 9, 2) * 2.0**18]) for k in range(60)]
    for r in whitening.whitening_report(spark.createDataFrame(small, "vec_id bigint, embedding array<double>")).collect():
        fit = sorted({tuple(int(256 * c) for c in v) for _, v in small})
        exact = sum((len(fit) * int(256 * c) - s) ** 2 for c, s in zip(small[r.vec_id][1], (sum(c) for c in zip(*fit))))
        assert r.deviation == (exact if exact < 1 << 63 else None)


@pytest.mark.parametrize("kind", range(6))
def test_feast_finds_the_top_of_any_spectrum(kind):
    rng = np.random.default_rng(kind)
    for _ in range(40):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 6))
        e = np.sort(rng.exponential(size=n) * 10.0 ** rng.integers(-6, 6))[::-1]
        e = [e, np.round(e), np.where(np.arange(n) < n // 2, e, 0), 10.0 ** rng.uniform(-9, 3, n), np.full(n, e[0]), 1 + 1e-6 * e / e[0]][kind]
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        v = q @ np.diag(e) @ q.T
        v = (v + v.T) / 2
        values, vectors = whitening.top_components(v, k)
        want = np.linalg.eigvalsh(v)[::-1]
        top = max(abs(want).max(), 1e-300)
        want = want[want > np.abs(v).sum(axis=1).max(initial=0) * n * np.finfo(float).eps][:k]
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-13 * top)
        assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
        assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-11 * top


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        v = rng.normal(size=(n, n))
        v = v + v.T - (np.diag(np.diag(v + v.T)) if rng.random() < 0.3 else 0)
        e = np.linalg.eigvalsh(v)
        for a in (0.0, float(rng.normal()), (e[0] + e[-1]) / 2):
            if np.abs(e - a).min() > 1e-9:
                assert whitening.inertia_above(v, a) == int((e > a).sum())


# ---- decontamination


def hits_by_hand(rows, items):
    words = lambda t: NOT_WORD.findall((t or "").translate(str.maketrans(decontamination.UPPER, decontamination.LOWER)))
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(6)
    vocabulary = ["a", "b", "c", "dé", "中文", "x1", "word", "longer", "ab", "ba"]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(8, 40)))) for k in range(30)]
    items += [(30, "short one"), (31, "Word"), (32, ""), (33, None), (None, "null-item has an ID"), (34, items[0][1]), (5, "a second row of five"), (35, "!!!"), (36, "a a a a a a a a a a a a a a")]
    rows = [(None, None), (0, ""), (1, "?!"), (2, "a " * 700), (3, "word"), (4, "SHORT, one"), (4, "SHORT, one"), (None, "null item has an id")]
    for k in range(10, 150):
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 400)))
        if k % 3 == 0:
            text += rng.choice([" ", "\n--\n", ", "]) + re.sub(" ", lambda m: str(rng.choice([" ", "  ", ", ", "\n"])), items[k % 30][1]).upper().replace("DÉ", "Dé")
        rows.append((k, text + " " + " ".join(rng.choice(vocabulary, 5))))
    return rows, items


def test_decontamination(spark, docs, passages):
    for rows, items in (passages, ([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])):
        frame, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        found = Counter(map(tuple, decontamination.contamination_report(frame, benchmark).collect()))
        assert found == hits_by_hand(rows, items) and any(r[5] for r in found) and not all(r[5] for r in found)


def test_decontamination_in_blocks(spark, passages, monkeypatch):
    """More windows than one broadcast holds, small batches, and segments that end anywhere."""
    rows, items = passages
    frame, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40_000)
    assert Counter(map(tuple, decontamination.contamination_report(frame, benchmark).collect())) == hits_by_hand(rows, items)


def test_search_of_any_segment_and_batch(passages, monkeypatch):
    rows, items = passages
    windows = {}
    for k, t in items:
        w = NOT_WORD.findall((t or "").lower())
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(" ".join(w[i : i + 10]).encode(), []).append(str(k))
    searcher = decontamination.Searcher(list(windows.items()))
    texts = [(t or "").encode() for _, t in rows]
    want = searcher.search(texts)
    for segment, size in ((1, 7), (3, 50), (17, 1000)):
        monkeypatch.setattr(decontamination, "SEGMENT", segment)
        monkeypatch.setattr(decontamination, "BATCH_BYTES", size)
        assert searcher.search(texts) == want
    spans = [(s["first"], s["last"]) for runs in want[1] for s in runs]
    assert all(b - a + 1 >= 1 for a, b in spans) and max(b - a + 1 for a, b in spans) >= 20


def test_shifts_are_safe_and_skip():
    """No shift passes the end of a window; most places of a text without hits are never looked at."""
    rng = np.random.default_rng(7)
    windows = [" ".join(rng.choice([f"w{k}" for k in range(500)], 10)).encode() for _ in range(50)]
    p = decontamination.Patterns(10, windows)
    hashes = decontamination.Words(np.frombuffer(b" ".join(windows), np.uint8)).hashes.reshape(50, 10)
    for end in range(2, 11):
        assert (p.shift[p.slot(hashes[:, end - 2], hashes[:, end - 1])] <= 10 - end).all()
    other = decontamination.Words(np.frombuffer(" ".join(f"v{k}" for k in range(20_000)).encode(), np.uint8)).hashes
    looked = []
    slot = decontamination.Patterns.slot
    p.slot = lambda a, b: looked.append(len(b)) or slot(p, a, b)
    places, _ = p.places(other, np.array([0]), np.array([20_000]))
    assert sum(looked) < 20_000 / 5 and len(places) < 60


def test_removal_and_columns(spark, passages):
    rows, items = passages
    frame = spark.createDataFrame([(*r, "keep", 5) for r in rows], "doc_id bigint, text string, n_words string, Items int")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    left = decontamination.remove_hits(frame, benchmark)
    assert left.columns == frame.columns and all(r.n_words == "keep" for r in left.collect())
    clean = Counter()
    for r, n in hits_by_hand(rows, items).items():
        clean[r[0]] += n * (not r[5])
    assert Counter(r.doc_id for r in left.collect()) == +clean
    assert decontamination.contamination_report(frame.limit(0), benchmark).count() == 0
    assert decontamination.contamination_report(frame, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontamination.find_windows(frame.select("doc_id", "text", F.lit(1).alias("spans")), decontamination.benchmark_windows(benchmark)).columns == ["doc_id", "text", "n_words", "spans", "items"]
