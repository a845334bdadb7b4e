"""Recall by vectors and by shared character pairs; resolving identities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswarp.operators.graph import shared_dir

BLOCK, CHUNK = 4096, 8192  # query vectors of a block, rows that a task takes with them, about
TEXT_BLOCK, TEXT_CHUNK = 16384, 32768  # the same of texts: packed bigrams, a few hundred bytes each
LEAST_TASKS = 24
PART, ROW_PART = 512, 1024  # queries and rows whose scores are one matrix
FIRST_PART = 64  # rows of a task's first one, while queries have no edge
SINGLE, FOLDED = 256, 256  # bigrams that are a group each, groups of the others
FIRST_ROWS = 32768  # of the first range of facts, about
MOST_CODES = 1 << 21  # n-grams of items whose codes go to the tasks: 16 MB
MEMO = 60_000  # words whose hashes a task remembers


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _best(found: dict[str, np.ndarray], most: int) -> dict[str, np.ndarray]:
    """Of (query, id, fact, score) the best row of each query's fact, then the best ``most`` facts of each query, in order."""
    query, key, fact, score = found.values()
    order = np.lexsort((key, -score, fact, query))
    query, fact = query[order], fact[order]
    order = order[np.concatenate([[True], (query[1:] != query[:-1]) | (fact[1:] != fact[:-1])])] if len(order) else order
    query, fact, score = (found[c][order] for c in ("query", "fact", "score"))
    place = np.lexsort((fact, -score, query))
    query = query[place]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < most
    return {c: v[order[place[keep]]] for c, v in found.items()}


def _recall(queries: DataFrame, rows: DataFrame, what: str, scorer: Callable, least: float, most: int, blocks: int, chunks: int, top: float = np.inf) -> DataFrame:
    """queries: (id, what, edge), rows: (id, what, fact). The best row of each fact that scores ``least`` or more and more than the query's edge, the
    best ``most`` facts of a query: (query, id, fact, score). scorer(queries' values, rows' values) gives a function of queries' places, a range of rows
    and floors, which returns pairs (place among these queries, row, score), all those above both the least score and the query's floor. No pair
    scores more than ``top``.

    The queries are stated and meet all rows in blocks: queries are dealt into blocks and rows into chunks, and each task takes
    one block with one chunk, as arrays. Only the best ``most`` facts of a query leave a task: one that is among the best of all is among those of
    its chunk. Rows come in the order of facts, so that a later one must score more than the last of the best so far; a query whose last one
    has the top score is done.
    """
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("id", what, "edge").withColumn("block", deal(blocks)).withColumn("chunk", every(chunks))
    r = rows.select("id", what, "fact").withColumn("chunk", deal(chunks)).withColumn("block", every(blocks))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query": np.int64, "id": np.int64, "fact": np.int64, "score": np.float64}
        best = {c: np.zeros((left.num_rows, most), t) for c, t in kinds.items()}
        best["score"][:] = -np.inf
        if left.num_rows and right.num_rows:
            right = right.sort_by([("fact", "ascending"), ("id", "ascending")])
            own, ids, facts = (t.column(c).to_numpy() for t, c in ((left, "id"), (right, "id"), (right, "fact")))
            best["query"][:] = np.arange(len(own))[:, None]
            edge = left.column("edge").to_numpy().copy()
            score, first, size = scorer(left.column(what), right.column(what)), 0, FIRST_PART
            while first < len(ids):
                live, other = np.flatnonzero(edge < top), slice(first, min(first + size, len(ids)))
                if not len(live):
                    break
                for k in range(0, len(live), PART):
                    mine = live[k : k + PART]
                    i, j, s = score(mine, other, edge[mine])
                    i = mine[i]
                    keep = own[i] != ids[j]
                    i, j, s = i[keep], j[keep], s[keep]
                    if len(i):
                        hit = np.unique(i)
                        there = best["score"][hit] > -np.inf
                        new = {"query": i, "id": ids[j], "fact": facts[j], "score": s}
                        new = _best({c: np.concatenate([best[c][hit][there], new[c]]) for c in kinds}, most)
                        at = new["query"], np.arange(len(new["query"])) - np.searchsorted(new["query"], new["query"])
                        for c in ("id", "fact", "score"):
                            best[c][at] = new[c]
                        edge[hit] = np.maximum(edge[hit], best["score"][hit, -1])
                first, size = other.stop, min(2 * size, ROW_PART)
            best["query"] = own[best["query"]]
        there = best["score"] > -np.inf
        return pa.table({c: pa.array(best[c][there]) for c in kinds})

    found = q.groupBy("block", "chunk").cogroup(r.groupBy("block", "chunk")).applyInArrow(work, "query bigint, id bigint, fact bigint, score double")
    return _placed(found, most)


def _placed(found: DataFrame, most: int) -> DataFrame:
    """Of (query, id, fact, score) the best row of each fact and the best ``most`` facts of a query."""
    best = found.groupBy("query", "fact").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("b"))
    best = best.select("query", "fact", F.col("b.score").alias("score"), (-F.col("b.m")).alias("id"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "fact")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _dealt(queries: int, rows: int, block: int, chunk: int) -> tuple[int, int]:
    """Into how many blocks and chunks: of so many queries and rows at most, and enough tasks for the cores. Rows that fit one chunk stay together: a
    task that has seen more of them needs fewer of the rest."""
    blocks, chunks = max(1, -(-queries // block)), max(1, -(-rows // chunk))
    return (max(blocks, LEAST_TASKS), 1) if chunks == 1 else (blocks, max(chunks, -(-LEAST_TASKS // blocks)))


def vector_recall(queries: DataFrame, rows: DataFrame, least: float = 0.6, most: int = 10) -> DataFrame:
    """Recall by the cosine of vectors of one length: see _recall. Null vectors are left out."""

    def cosines(a: pa.ChunkedArray, b: pa.ChunkedArray) -> Callable:
        x, y = (c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) for c in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))

        def score(mine: np.ndarray, other: slice, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found = x[mine] @ y[other].T
            i, j = np.nonzero((found >= least) & (found > floor[:, None]))
            return i, j + other.start, found[i, j]

        return score

    queries, rows = (d.filter("vector is not null") for d in (queries, rows))
    deal = _dealt(queries.count(), rows.count(), BLOCK, CHUNK)
    return _recall(queries.withColumn("edge", F.lit(float("-inf"))), rows, "vector", cosines, least, most, *deal)


def _bigrams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rising codes of each text's bigrams one text after another, and how many each has."""
    for blank in " \n\t\r\f":
        texts = [t.replace(blank, "") for t in texts]
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code = ((owner[:-1] << 42) | (x[:-1] << 21) | x[1:])[owner[:-1] == owner[1:]]
    code.sort()
    if len(code):
        code = code[np.concatenate([[True], code[1:] != code[:-1]])]
    return code & ((1 << 42) - 1), np.bincount(code >> 42, minlength=len(texts))


def _bigram_codes(text: str) -> np.ndarray:
    return _bigrams_of([text])[0]


def _packed(codes: np.ndarray, starts: np.ndarray | None = None) -> bytes:
    """Rising numbers as their differences, seven bits a byte, the last of each below 128; they begin anew at starts."""
    gaps = np.diff(codes, prepend=0)
    if starts is not None:
        gaps[starts] = codes[starts]
    width = np.searchsorted(1 << np.arange(7, 42, 7), gaps, "right")
    last = np.cumsum(width + 1) - 1
    out = np.empty(len(gaps) + int(width.sum()), np.uint8)
    out[last] = gaps & 127
    for k in range(1, 6):  # the k-th byte from the end
        has = np.flatnonzero(width >= k)
        out[last[has] - k] = ((gaps[has] >> (7 * k)) & 127) | 128
    return out.tobytes()


def _unpacked(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows one after another, and how many each row has."""
    column = packed.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    last = np.flatnonzero(data < 128)
    width = np.diff(last, prepend=-1)
    gaps = data[last].astype(np.int64)
    for k in range(1, 6):  # the k-th byte from the end
        has = np.flatnonzero(width > k)
        gaps[has] |= (data[last[has] - k] & 127).astype(np.int64) << (7 * k)
    counts = np.diff(np.searchsorted(last, ends - ends[0]))
    total = np.concatenate([[0], np.cumsum(gaps)])
    starts = np.concatenate([[0], np.cumsum(counts)])
    return total[1:] - np.repeat(total[starts[:-1]], counts), counts


def _with_bigrams(texts: DataFrame) -> DataFrame:
    """(id, fact, grams): the packed bigrams of texts that have one; a fifth of the text or less, and all that is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = []
            for first in range(0, batch.num_rows, 32):  # few enough for the processor's cache
                codes, counts = _bigrams_of([x or "" for x in batch.column(2).slice(first, 32).to_pylist()])
                ends = np.cumsum(counts)
                packed = _packed(codes, (ends - counts)[counts > 0])
                at = np.concatenate([[0], np.flatnonzero(np.frombuffer(packed, np.uint8) < 128) + 1])[np.concatenate([[0], ends])]
                grams += [packed[a:b] for a, b in zip(at, at[1:])]
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.binary())], ["id", "fact", "grams"])
            yield whole.filter(pa.array([bool(g) for g in grams], pa.bool_()))

    return texts.select("id", "fact", "text").mapInArrow(work, "id bigint, fact bigint, grams binary")


def _bits(owner: np.ndarray, place: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Sets of numbers below width as words of 64 bits, a row each."""
    out = np.zeros((rows, -(-width // 64) * 8), np.uint8)
    np.add.at(out.ravel(), owner * out.shape[1] + (place >> 3), np.left_shift(1, place & 7).astype(np.uint8))
    return out.view(np.uint64)


def _shares(a: pa.ChunkedArray, b: pa.ChunkedArray, least: float) -> Callable:
    """Shared bigrams over the smaller set, for _recall. What two sets share can't be more than the sum over groups of bigrams of those of a row whose
    group the query has: the groups are the bigrams that tell rows apart best, one each, and the others dealt into FOLDED. One product of
    matrices so leaves out most pairs; the sets of the others are compared whole."""
    (left, n), (right, m) = _unpacked(a), _unpacked(b)
    known, left = np.unique(left, return_inverse=True)
    x = np.concatenate([[0], np.cumsum(n)])
    at = np.minimum(np.searchsorted(known, right), len(known) - 1)
    has = known[at] == right  # other bigrams no query has
    owner, right = np.repeat(np.arange(len(m)), m)[has], at[has].astype(np.int32)
    y = np.searchsorted(owner, np.arange(len(m) + 1))
    share = np.bincount(right, minlength=len(known)) / len(m)
    width = min(len(known), SINGLE + FOLDED)
    group = np.empty(len(known), np.int32)
    group[np.argsort(-share * (1 - share), kind="stable")] = np.where(np.arange(len(known)) < width, np.arange(len(known)), SINGLE + np.arange(len(known)) % FOLDED)
    sides = np.zeros((len(n), width), np.float32)
    sides[np.repeat(np.arange(len(n)), n), group[left]] = 1
    last: list = [None, None]

    def score(mine: np.ndarray, other: slice, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, rows, count = right[y[other.start] : y[other.stop]], owner[y[other.start] : y[other.stop]] - other.start, other.stop - other.start
        if last[0] != other:
            last[:] = other, np.bincount(rows * width + group[codes], minlength=count * width).reshape(count, width).astype(np.float32)
        size = np.minimum(n[mine].astype(np.float32)[:, None], m[other].astype(np.float32)[None, :])
        size *= (np.maximum(floor, least) * (1 - 1e-6)).astype(np.float32)[:, None]
        i, j = np.nonzero(sides[mine] @ last[1].T >= size)
        if not len(i):
            return i, j, np.zeros(0)
        own = np.concatenate([left[x[k] : x[k + 1]] for k in mine])
        used = np.unique(own)
        place = np.full(len(known), -1, np.int32)
        place[used] = np.arange(len(used))
        mask = place[codes] >= 0
        p = _bits(np.repeat(np.arange(len(mine)), n[mine]), place[own], len(mine), len(used))
        q = _bits(rows[mask], place[codes[mask]], count, len(used))
        step = max(1, (1 << 19) // p.shape[1])
        shared = np.concatenate([np.bitwise_count(p[i[k : k + step]] & q[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)])
        found = shared / np.minimum(n[mine][i], m[other][j])
        keep = (found >= least) & (found > floor[i])
        return i[keep], j[keep] + other.start, found[keep]

    return score


def _ranges(rows: DataFrame) -> list[tuple[int | None, int | None]]:
    """Ranges of facts, one after another: the first has about FIRST_ROWS rows, and each further one makes them four times as many."""
    total, ends = rows.count(), []
    while (size := FIRST_ROWS * 4 ** len(ends)) < total / 2:
        ends.append(size / total)
    cuts = sorted(set(rows.agg(F.percentile_approx("fact", ends, F.lit(100_000))).first()[0])) if ends else []
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def lexical_recall(queries: DataFrame, rows: DataFrame, least: float = 0.25, most: int = 10) -> DataFrame:
    """Recall by character bigrams of texts: shared ones over the smaller set. See _recall. Texts without a bigram are left out, and rows without an id or a fact.

    Rows are taken by ranges of facts. What is found in one gives the queries' edges for the next, and a query is done as soon as it has ``most`` facts
    that share all: no later fact comes before them.
    """
    shared_dir(queries.sparkSession)
    rows = rows.select("id", "fact", "text").filter("id is not null and fact is not null")
    asked = _with_bigrams(queries.filter("id is not null").select("id", F.lit(0).cast("bigint").alias("fact"), "text")).select("id", "grams").checkpoint()
    live, found = asked.withColumn("edge", F.lit(float("-inf"))), None
    for low, high in _ranges(rows):
        part = rows if low is None else rows.filter(F.col("fact") > low)
        part = part if high is None else part.filter(F.col("fact") <= high)
        waiting = live.count()
        if found is not None and not waiting:
            break
        deal = _dealt(waiting, part.count(), TEXT_BLOCK, TEXT_CHUNK)
        new = _recall(live, _with_bigrams(part), "grams", lambda a, b: _shares(a, b, least), least, most, *deal, top=1.0)
        found = new if found is None else _placed(found.drop("place").unionByName(new.drop("place")), most)
        if high is None:
            break
        found = found.checkpoint()
        edges = found.filter(F.col("place") == most).select(F.col("query").alias("id"), "score")
        live = asked.join(edges, "id", "left").select("id", "grams", F.coalesce("score", F.lit(float("-inf"))).alias("edge")).filter("edge < 1")
    return found


class _WordHashes(dict):
    """word -> 64 bits. Forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _gram_codes(words: list[bytes], n: int, memo: _WordHashes) -> np.ndarray:
    """A 64-bit code of each n words that follow one another."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    code = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k]
    return code


def _gram_rows(df: DataFrame, name: str, n: int, known: np.ndarray | None) -> DataFrame:
    """(name, g): the distinct n-grams of each row's words; known: codes, of which a gram must have one (others with the same code may pass too)."""
    rows = df.select(F.col("id").alias(name), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    kind, shared = rows.schema[name], df.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, codes = _WordHashes(), None if shared is None else shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, owners, grams = batch.slice(k, 256), [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = re.findall(rb"[a-z0-9]+", text.encode())
                    own = _gram_codes(words, n, memo)
                    at = range(len(own))
                    if codes is not None:
                        place = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
                        at = np.flatnonzero(codes[place] == own).tolist() if len(codes) else []
                    found = {b" ".join(words[j : j + n]) for j in at}
                    owners += [i] * len(found)
                    grams += found
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners, pa.int64())), pa.array(grams, pa.binary()).cast(pa.string())], [name, "g"])

    return rows.mapInArrow(work, T.StructType([kind, T.StructField("g", T.StringType())]))


def ngram_contamination(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """docs, items: (id, text). (id, item, shared, share): n-grams of words that a document and an item have in common.

    The codes of the items' n-grams go to the tasks up to MOST_CODES, counted first; so of the documents' n-grams only those are made into rows that
    some item has, or that agree with one in 64 bits, and the join on the words themselves decides. Beyond that bound all are joined.
    """
    own = _gram_rows(items, "item", n, None)
    sizes = own.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    known = None
    if own.count() <= MOST_CODES:
        memo = _WordHashes()
        grams = own.select("g").distinct().toArrow().column(0).to_pylist()
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_gram_codes(g.encode().split(b" "), n, memo) for g in grams]]))
    shared = _gram_rows(docs, "id", n, known).join(own, "g").groupBy("id", "item").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, "item").select("id", "item", "shared", (F.col("shared") / F.col("size")).alias("share"))


def first_by_identity(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first arrival of each identity, and how many there were."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("x"), F.count(F.lit(1)).alias("arrivals")).select(key, "x.*", "arrivals")


def resolve_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows: (id, keys array); aliases: (alias, target). target where the keys agree on one, ``conflict`` where they do not."""
    hits = rows.select("id", F.explode("keys").alias("alias")).join(aliases, "alias")
    each = hits.groupBy("id").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    out = rows.select("id").join(each, "id", "left")
    return out.select("id", F.when(F.col("n") == 1, F.col("target")).alias("target"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("conflict"))


def revisions(arrivals: DataFrame, key: str, order: list, content: str) -> DataFrame:
    """Arrivals whose content differs from all earlier ones of their identity, numbered: a version seen before is no revision."""
    first = arrivals.groupBy(key, content).agg(F.min(F.struct(*order)).alias("at"))
    return first.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy("at")))


def thresholds(scored: DataFrame, candidates: list[int]) -> DataFrame:
    """scored: (score, truth 0/1). Confusion counts at each threshold, from one pass over the scores' histogram."""
    hist = scored.groupBy("score").agg(F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg"))
    each = hist.withColumn("threshold", F.explode(F.array(*map(F.lit, candidates))))
    hit = F.col("score") >= F.col("threshold")
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    out = each.groupBy("threshold").agg(total(hit, "pos").alias("tp"), total(hit, "neg").alias("fp"), total(~hit, "pos").alias("fn"), total(~hit, "neg").alias("tn"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return out.withColumns({"precision": precision, "recall": recall, "f1": 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))})
