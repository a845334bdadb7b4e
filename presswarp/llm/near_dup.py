"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's set is that of its distinct shingles (five words; the whole sequence where there are fewer), as 64-bit hashes.
One permutation deals the hashes into BINS bins and keeps the least of each; an empty bin borrows from the bin that a fixed
random order of its own finds first. BANDS bands of ROWS bins give bucket keys. Documents with the same set are one class
from the start. In a bucket, every class is paired with the bucket's centre only (a star), so the pairs grow with the
entries of buckets, not with their squares. Pairs are confirmed on the full sets, and confirmed links are joined to
components by passing the smallest id along links, with pointer jumping. Only buckets that still hold several components enter
the next round.

A star misses a link of two members that are both unlike its centre. So buckets whose members are in more than one component
afterwards form stars around other centres, drawn by hash, in STAR_ROUNDS rounds at most, which join the large groups cheaply.
The classes of all buckets that still hold several components then go through an exact join: shingles are put in one order,
those that are rare among these classes first, and any two sets that are similar enough have their first common shingle near
the start of both (see rare_pairs). Every pair of two components is tested there or excluded by that bound, so nothing that
shares a bucket is left to the luck of a draw.

Every similar pair shares a bucket but for chance: at a similarity of 0.75, (1 - 0.75 ** 4) ** 32 = 0.000005.

Defined results: documents without words (null and empty texts too) are linked with nothing and are kept; a null doc_id
stands for no node: such a row takes the component of the other rows with its set, if there are any, and is then not kept,
else its component is null and it is kept; rows with the same doc_id are one node, whatever their texts: their sets are
linked, and a row of theirs without words has their component; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Scratch, free_name, tidy

WORDS = 5
BINS = 128
ROWS = 4
BANDS = BINS // ROWS
STAR_ROUNDS = 2
SLOTS = 1 << 20  # of the shingle counts that give the order of rarity; 4 MB
CELL = 4096  # entries of one shingle that a task pairs with as many others
BROADCAST_IDS = 1 << 20  # ids; 8 MB
_MEMO = 60_000
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, memo: _Words) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text (UTF-8). bytes.lower and bytes.split know ASCII only, as is asked for."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    code = h[: n - size + 1].copy()
    for k in range(1, size):
        code = code * _M1 + h[k : n - size + 1 + k]
    return np.unique(mixed(code + _U(size)))


_PROBE: dict[int, np.ndarray] = {}


def _probe(attempt: int) -> np.ndarray:
    """For each bin, the bin that its own random order tries at this attempt."""
    if attempt not in _PROBE:
        _PROBE[attempt] = (mixed(np.arange(BINS, dtype=np.uint64) * _M1 + _U(attempt)) % _U(BINS)).astype(np.int64)
    return _PROBE[attempt]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin, densified."""
    edges = np.arange(BINS, dtype=np.uint64) << _U(57)
    at = np.minimum(np.searchsorted(shingles, edges), len(shingles) - 1)
    least = shingles[at]
    full = (least >> _U(57)) == np.arange(BINS, dtype=np.uint64)
    out, need, attempt = least.copy(), ~full, 0
    while need.any():
        attempt += 1
        to = _probe(attempt)
        take = need & full[to]
        out[take] = least[to[take]]
        need &= ~take
    return out


_BAND = mixed(np.arange(BANDS, dtype=np.uint64) + _U(77))


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    code = _BAND.copy()
    for k in range(ROWS):
        code = mixed(code * _M1 + rows[:, k])
    return code.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, buckets); set_id and buckets are null for documents without words."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                sizes, ids, buckets = [], [], []
                for x in part.column(1):
                    s = shingle_set(x.as_py(), memo)
                    sizes.append(len(s))
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    buckets.append(bucket_keys(signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "buckets"])

    return rows.mapInArrow(tidy(work), "doc_id bigint, n_shingles bigint, set_id binary, buckets array<bigint>")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents in ids, a frame of distinct doc_id. It goes to the tasks whole only below BROADCAST_IDS."""
    small = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingle_set(x.as_py(), memo).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return rows.mapInArrow(tidy(work), "doc_id bigint, shingles array<bigint>")


def rare_pairs(sets: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """sets: (doc_id, shingles), labels: (doc_id, component). Pairs (a, b) of different components, among them all that are similar.

    Sets of n <= m shingles are similar if they share s >= 3 (n + m) / 7. If their first common shingle in a fixed order is at
    the places i and j (from 0), then s <= min(n - i, m - j); so i <= n - 6 n / 7 and j <= m - 3 m / 4. Each set's start of
    that length is its entries, and the bound itself is checked for each pair. Any order is right; that by rarity keeps what
    many sets share out of the starts. A shingle's entries all of one component make no pairs, nor do those of its commonest
    component among themselves; the entries of a common shingle are paired in cells.
    """
    counts = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    common = np.zeros(SLOTS, np.int64)
    common[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(common.clip(max=2**31 - 1).astype(np.int32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids, parts = part.column(0).to_numpy(), []
                for rep, x in zip(ids, part.column(1)):
                    s = x.values.to_numpy()
                    n = len(s)
                    if not n:
                        continue
                    start = s[np.lexsort((s, common[s & (SLOTS - 1)]))[: n - (3 * n + 3) // 4 + 1]]
                    place = np.arange(len(start))
                    parts.append((np.full(len(start), rep), np.full(len(start), n), start, place, place <= n - (6 * n + 6) // 7))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["doc_id", "n", "s", "place", "early"])

    entries = sets.select("doc_id", "shingles").mapInArrow(tidy(work), "doc_id bigint, n bigint, s bigint, place bigint, early boolean")
    entries = scratch.put(entries.join(labels, "doc_id"))
    groups = entries.groupBy("s", "component").agg(F.count(F.lit(1)).alias("size"))
    groups = groups.groupBy("s").agg(F.max_by("component", "size").alias("main"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    entries = entries.join(groups.select("s", "main", F.ceil(F.col("size") / CELL).cast("int").alias("cells")), "s")
    own, every = F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    other = F.col("component") != F.col("main")
    less = entries.filter("early").select("s", F.when(other, 0).otherwise(1).alias("side"), own.alias("row"), every.alias("column"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("i"), F.col("component").alias("ca"))
    more = entries.select("s", "component", own.alias("column"), every.alias("row"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("j"), F.when(other, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("sides"))
    more = more.select("s", F.explode("sides").alias("side"), "row", "column", "b", "nb", "j", F.col("component").alias("cb"))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    bound = 7 * F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) >= 3 * (F.col("na") + F.col("nb"))
    keys = ["s", "side", "row", "column"]
    less, more = less.alias("x"), more.alias("y")
    on = order & bound & (F.col("ca") != F.col("cb"))
    for key in keys:
        on = on & (F.col(f"x.{key}") == F.col(f"y.{key}"))
    return less.join(more, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= 75 * union. sets: (doc_id, shingles), where there are some already."""
    if sets is None:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = shingle_sets(docs, ids)
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("shared", shared).filter(100 * F.col("shared") >= 75 * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component, moved): the smallest id reachable along the links (a, b), for every node of a link.

    Each round takes the least label of a node's neighbours and then the label of that label (pointer jumping), so the
    rounds grow with the logarithm of the longest path.
    """
    ends = scratch.put(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.put(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = ends.join(labels, ends.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "least").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        step = step.join(jump, step.new == jump["at"], "left").select("node", F.least("new", F.coalesce("further", "new")).alias("component"), (F.least("new", F.coalesce("further", "new")) != F.col("component")).alias("moved"))
        step = scratch.put(step)
        scratch.drop(labels)
        moved, labels = step.filter("moved").limit(1).count(), step
        if not moved:
            scratch.drop(ends)
            return labels


def alike_in_size(n: str, m: str):
    return 4 * F.least(F.col(n), F.col(m)) >= 3 * F.greatest(F.col(n), F.col(m))


def unsettled(entries: DataFrame, components_now: DataFrame | None) -> DataFrame:
    """The entries of buckets that hold several components, with their components of now."""
    if components_now is not None:
        now = components_now.select(F.col("node").alias("rep"), F.col("component").alias("label"))
        entries = entries.join(now, "rep", "left").select("bucket", "rep", "n", F.coalesce("label", "component").alias("component"))
    several = entries.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    return entries.join(several, "bucket")


def one_node(found: DataFrame, classes: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """doc_ids that stand for several sets (or for one and for rows without words), and the links from each to its sets' representatives."""
    by_id = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.count("set_id").alias("worded"), F.count(F.lit(1)).alias("rows"))
    several = scratch.put(by_id.filter("lo <> hi or worded > 0 and worded < rows").select("doc_id"))
    if not several.take(1):
        return None, None
    own = found.filter("set_id is not null").join(several, "doc_id").select("doc_id", "set_id").distinct()
    return several, scratch.put(own.join(classes.select("set_id", "rep"), "set_id").filter("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct())


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, n_shingles, component_id, kept) for each document."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    found = scratch.put(features(docs))
    classes = found.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = scratch.put(classes)
    entries = classes.filter("rep is not null").select("rep", "n", F.explode("buckets").alias("bucket"))
    entries = scratch.put(unsettled(entries.withColumn("component", F.col("rep")), None))  # of buckets with company
    links = components_now = tested = None
    for turn in range(STAR_ROUNDS):
        order = F.col("rep") if turn == 0 else F.xxhash64(F.lit(turn), F.col("bucket"), F.col("rep"))
        centre = entries.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("centre"), F.col("n").alias("centre_n"), F.col("component").alias("centre_component"))).alias("c"))
        centre = centre.select("bucket", "c.centre", "c.centre_n", "c.centre_component")
        pairs = entries.join(centre, "bucket").filter((F.col("component") != F.col("centre_component")) & alike_in_size("n", "centre_n"))
        pairs = pairs.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.put(pairs)
        new = scratch.put(confirmed(pairs, docs))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not new.take(1):
            break
        links = new if links is None else links.unionByName(new)
        before, components_now = components_now, components(links, scratch)
        wider, entries = entries, scratch.put(unsettled(entries, components_now))
        scratch.drop(wider, before)
    open_now = scratch.put(entries.select(F.col("rep").alias("doc_id"), "component").distinct())
    if open_now.take(1):
        sets = scratch.put(shingle_sets(docs, open_now.select("doc_id").distinct()))
        pairs = scratch.put(rare_pairs(sets, open_now, scratch).join(tested, ["a", "b"], "left_anti"))
        new = scratch.put(confirmed(pairs, docs, sets))
        if new.take(1):
            links = new if links is None else links.unionByName(new)
            components_now = components(links, scratch)
    several, same = one_node(found, classes, scratch)
    if same is not None:
        components_now = components(same if links is None else links.unionByName(same), scratch)
    labels = classes.select("set_id", "rep")
    if components_now is not None:
        labels = labels.join(components_now, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    else:
        labels = labels.select("set_id", F.col("rep").alias("component_id"))
    labels = scratch.put(labels)
    out = found.select("doc_id", "n_shingles", "set_id").join(labels, "set_id", "left")
    if same is not None:  # rows without words whose doc_id has words elsewhere
        nodes = scratch.put(several.join(components_now, F.col("doc_id") == F.col("node")).select("node", F.col("component").alias("node_component")))
        out = out.join(nodes, F.col("set_id").isNull() & (F.col("doc_id") == F.col("node")), "left").withColumn("component_id", F.coalesce("component_id", "node_component"))
        scratch.drop(*[frame for frame, _ in scratch.tables if frame is not found and frame is not labels and frame is not nodes])
    else:
        scratch.drop(*[frame for frame, _ in scratch.tables if frame is not found and frame is not labels])
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "set_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document: (doc_id, n_shingles, component_id, kept)."""
    return judged(docs).drop("set_id")


def with_set_id(docs: DataFrame, name: str) -> DataFrame:
    """docs and the column ``name``: the set_id of each text, null without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            sets = [shingle_set(x.as_py(), memo) for x in batch.column(batch.num_columns - 1)]
            ids = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], name])

    rows = docs.withColumn(name, F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.mapInArrow(tidy(work), StructType([StructField(f.name, f.dataType) for f in rows.schema]))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``. Rows of one doc_id are one document; each row without
    doc_id is judged by its own set."""
    id_name, set_name = free_name("gone", docs.columns), free_name("gone_set", docs.columns)
    gone = judged(docs).filter("not kept").select(F.col("doc_id").alias(id_name), F.when(F.col("doc_id").isNull(), F.col("set_id")).alias(set_name)).distinct()
    gone = Scratch(docs.sparkSession, "near-dup-gone").put(gone)
    null = F.col("doc_id").cast("bigint").isNull()
    ids = gone.filter(F.col(id_name).isNotNull()).select(id_name)
    left = docs.filter(~null).join(ids, F.col("doc_id") == F.col(id_name), "left_anti")
    sets = gone.filter(F.col(id_name).isNull()).select(F.col(set_name).alias(f"{set_name}_"))
    nameless = with_set_id(docs.filter(null), set_name).join(sets, F.col(set_name) == F.col(f"{set_name}_"), "left_anti").drop(set_name)
    return left.unionByName(nameless)
