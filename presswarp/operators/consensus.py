"""Consensus boards from incomplete weighted comparisons.

scores: (unit, model, score, lower, upper); units: (unit, weight, operator, family, direction, interval_sd). Models are few;
comparisons are joins and sums in Spark, and only the board's order is solved in one task, from a matrix of its models.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EXACT = 22  # models of a strong component up to which the order is proven best
WINDOW = 9  # models beside one another that are put in their best order at once, beyond
ANCHORLESS = 50.0
SERIES_TO = 2.0  # where the series of the error function gives way to its continued fraction


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Spark has no error function."""
    return pd.Series(0.5 * erfc(-x.to_numpy(np.float64) / math.sqrt(2)))


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function: its series near 0, its continued fraction beyond, a few dozen steps over whole arrays. NaN stays NaN."""
    a = np.minimum(np.abs(x), 27.0)  # it is 0 beyond
    near = np.minimum(a, SERIES_TO)
    term = total = near
    for k in range(1, 90):  # erf(a) = 2 / sqrt(pi) * exp(-a * a) * sum of 2^k a^(2k+1) / (1 * 3 * ... * (2k+1))
        term = term * (2 * near * near / (2 * k + 1))
        total = total + term
    inner = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far = np.maximum(a, SERIES_TO)
    below = far
    for k in range(120, 0, -1):
        below = far + k / 2 / below
    outer = np.exp(-far * far) / (math.sqrt(math.pi) * below)
    value = np.where(a <= SERIES_TO, inner, outer)
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 2 - value, value))


def pair_support(scores: DataFrame, units: DataFrame, ordinal: bool = False) -> DataFrame:
    """(unit, a, b, p, weight), a < b: how far a is supported over b, in [-1, 1]. With published bounds on both sides it is
    2 Phi(difference / error) - 1, else the sign of the difference."""
    a = scores.select("unit", *[F.col(c).alias(f"{c}_a") for c in ("model", "score", "lower", "upper")])
    b = scores.select("unit", *[F.col(c).alias(f"{c}_b") for c in ("model", "score", "lower", "upper")])
    pairs = a.join(b, "unit").filter("model_a < model_b").join(units, "unit").filter("weight <> 0")
    diff = (F.col("score_a") - F.col("score_b")) * F.when(F.col("direction") == "LOWER", -1).otherwise(1)
    sign = F.signum(diff)
    if ordinal:
        p = sign
    else:
        error = lambda s: (F.col(f"upper_{s}") - F.col(f"lower_{s}")) / (2 * F.col("interval_sd"))
        se = F.sqrt(error("a") * error("a") + error("b") * error("b"))
        p = F.when(se > 0, 2 * normal_cdf(diff / se) - 1).otherwise(sign)
    return pairs.select("unit", F.col("model_a").alias("a"), F.col("model_b").alias("b"), p.alias("p"), "weight")


def net_support(pairs: DataFrame) -> DataFrame:
    """(a, b, net, weight, shared), a < b; the other half is its negative."""
    return pairs.groupBy("a", "b").agg(F.sum(F.col("weight") * F.col("p")).alias("net"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("shared"))


def agreement(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(unit, agreement): the weighted share of a unit's support that goes with the order."""
    at = lambda s: ranks.select(F.col("model").alias(s), F.col("rank").alias(f"rank_{s}"))
    both = pairs.join(at("a"), "a").join(at("b"), "b")
    s = F.when(F.col("rank_a") < F.col("rank_b"), 1).otherwise(-1)
    return both.groupBy("unit").agg((F.sum(F.col("weight") * (1 + F.col("p") * s) / 2) / F.sum("weight")).alias("agreement"))


def reversal_cost(matrix: np.ndarray, order: list[int]) -> float:
    """Support that points from a later to an earlier place."""
    m = matrix[np.ix_(order, order)]
    return float(np.maximum(np.tril(m, -1), 0).sum())


def strong_parts(edge: np.ndarray) -> list[list[int]]:
    """The strong components of a directed graph, each sorted, in an order that no edge goes against; of components that may come next that of the
    smallest index comes first."""
    n = len(edge)
    reach = edge | np.eye(n, dtype=bool)
    for k in range(n):
        reach |= reach[:, k : k + 1] & reach[k]
    both = reach & reach.T
    parts = {int(np.flatnonzero(both[x])[0]): np.flatnonzero(both[x]).tolist() for x in range(n)}
    before = {p: {q for q in parts if q != p and reach[q, p]} for p in parts}
    out: list[list[int]] = []
    done: set[int] = set()
    while len(done) < len(parts):
        ready = min(p for p in parts if p not in done and before[p] <= done)
        done.add(ready)
        out.append(parts[ready])
    return out


def _exact_order(lose: np.ndarray) -> list[int]:
    """Dynamic programming over the sets of leading models; of equal orders the first in lexicographic order. tail[s]: the least cost of ordering what is
    not in s. Sets are taken by size, a size at once; what a model is owed by a set is the sum of two table look-ups, for the set's halves."""
    n = len(lose)
    half = (n + 1) // 2

    def sums(part: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 1 << len(part)))
        for k, y in enumerate(part):
            out[:, 1 << k : 2 << k] = out[:, : 1 << k] + lose[y][:, None]
        return out

    low, high = sums(np.arange(half)), sums(np.arange(half, n))
    full, mask = (1 << n) - 1, (1 << half) - 1
    sets = np.arange(1 << n, dtype=np.int64)
    size = np.zeros(1 << n, np.int8)
    for k in range(n):
        size[1 << k : 2 << k] = size[: 1 << k] + 1
    tail = np.full(1 << n, np.inf)
    tail[full] = 0.0

    def cost(x: int, s: np.ndarray) -> np.ndarray:
        rest = full & ~s & ~(1 << x)
        return tail[s | 1 << x] + low[x, rest & mask] + high[x, rest >> half]

    for k in range(n - 1, -1, -1):
        level = sets[size == k]
        best = np.full(len(level), np.inf)
        for x in range(n):
            free = (level >> x & 1) == 0
            best[free] = np.minimum(best[free], cost(x, level[free]))
        tail[level] = best
    s, order = 0, []
    while s != full:
        x = next(x for x in range(n) if not s >> x & 1 and cost(x, np.array([s]))[0] <= tail[s] + 1e-12)
        order.append(x)
        s |= 1 << x
    return order


def lower_bound(matrix: np.ndarray) -> float:
    """No order reverses less: the lesser direction of every pair, and of cycles of three that share no pair the least of their sides, since one side of
    each is reversed. Cycles are taken greedily, the largest first."""
    lose = np.maximum(matrix, 0)
    total, left = float(np.minimum(lose, lose.T)[np.triu_indices(len(matrix), 1)].sum()), np.maximum(matrix, 0) - np.minimum(lose, lose.T)
    while True:
        # through[x, z]: the best of min(x beats y, y beats z) over y
        through = np.minimum(left[:, :, None], left[None, :, :])
        worth = np.minimum(through, left.T[:, None, :])
        x, y, z = np.unravel_index(int(worth.argmax()), worth.shape)
        if worth[x, y, z] <= 1e-12:
            return total
        least = float(worth[x, y, z])
        total += least
        for a, b in ((x, y), (y, z), (z, x)):
            left[a, b] = max(0.0, left[a, b] - least)


def best_order(matrix: np.ndarray) -> tuple[list[int], bool]:
    """The order with the least reversed support; ties go to the smaller index first. Whether that is proven.

    The graph of who is not beaten falls into strong components, whose order among each other every best order keeps; each is solved by itself. Up to
    EXACT models of a component by dynamic programming. A larger one is split again where models only tie; what is left of it is moved about, one
    model and one stretch at a time, while that helps, and is proven only if it meets ``lower_bound``.
    """
    order: list[int] = []
    proven = True
    for part in strong_parts(matrix >= 0):
        own = matrix[np.ix_(part, part)]
        if len(part) <= EXACT:
            order += [part[k] for k in _exact_order(np.maximum(own, 0))]
            continue
        for inner in strong_parts(own > 0):
            piece = [part[k] for k in inner]
            deep = matrix[np.ix_(piece, piece)]
            if len(piece) <= EXACT:
                order += [piece[k] for k in _exact_order(np.maximum(deep, 0))]
                continue
            found = _moved_order(deep)
            proven = proven and reversal_cost(deep, found) <= lower_bound(deep) + 1e-9
            order += [piece[k] for k in found]
    return order, proven


def _moved_order(matrix: np.ndarray) -> list[int]:
    """A good order: windows of WINDOW models are put in their best order, one after another, and models moved to their best place, until neither helps."""
    n = len(matrix)
    lose = np.maximum(matrix, 0)
    order = sorted(range(n), key=lambda x: (-matrix[x].sum(), x))
    cost = reversal_cost(matrix, order)
    while True:
        before = cost
        for x in range(n):
            rest = [y for y in order if y != x]
            # at the front x is owed by all after it; each step back it pays for one and is owed by one less
            gain = np.concatenate([[0.0], np.cumsum([lose[x, y] - lose[y, x] for y in rest])])
            at = int(np.argmin(gain))
            moved = rest[:at] + [x] + rest[at:]
            if (now := reversal_cost(matrix, moved)) < cost - 1e-12:
                order, cost = moved, now
        for start in range(0, n - WINDOW + 1):
            piece = order[start : start + WINDOW]
            best = [piece[k] for k in _exact_order(lose[np.ix_(piece, piece)])]
            moved = order[:start] + best + order[start + WINDOW :]
            if (now := reversal_cost(matrix, moved)) < cost - 1e-12:
                order, cost = moved, now
        if cost >= before - 1e-12:
            return order


def kemeny(net: DataFrame, board: list[str] | None = None) -> DataFrame:
    """(board..., model, rank, index, optimal) for each board. index: support from the bottom up, 50 without anchors."""
    keys = board or []
    rows = net if keys else net.withColumn("__board", F.lit(0))
    keys = keys or ["__board"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        models = sorted({*pdf.a, *pdf.b})
        at = {m: k for k, m in enumerate(models)}
        m = np.zeros((len(models), len(models)))
        i, j = pdf.a.map(at).to_numpy(), pdf.b.map(at).to_numpy()
        m[i, j], m[j, i] = pdf.net, -pdf.net
        order, proven = best_order(m)
        base = reversal_cost(m, order)
        gaps = [max(0.0, reversal_cost(m, [*order[:p], order[p + 1], order[p], *order[p + 2 :]]) - base) for p in range(len(order) - 1)]
        height = np.concatenate([np.cumsum(gaps[::-1])[::-1], [0.0]])
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(models) for k in keys})
        return out.assign(model=[models[x] for x in order], rank=np.arange(1, len(models) + 1), height=height, optimal=proven)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", model {kinds['a']}, rank bigint, height double, optimal boolean"
    out = rows.groupBy(*keys).applyInPandas(solve, schema)
    return out if board else out.drop("__board")


def index_values(ranked: DataFrame, anchors: list) -> DataFrame:
    """Adds index: 100 times the mean logistic of the height above each anchor, one decimal."""
    heights = [r.height for r in ranked.filter(F.col("model").isin(anchors)).collect()] if anchors else []  # the anchors
    if not heights:
        return ranked.withColumn("index", F.lit(ANCHORLESS))
    mean = sum((1 / (1 + F.exp(F.lit(h) - F.col("height"))) for h in heights), F.lit(0.0)) / len(heights)
    return ranked.withColumn("index", F.round(100 * mean, 1))


def scenarios(pairs: DataFrame, units: list[str], operators: dict[str, str] | None = None, ordinal: DataFrame | None = None) -> DataFrame:
    """(scenario, a, b, net): without each unit, without all units of each operator (operators: unit to operator), with each unit's weight moved by a fifth
    either way, and with every comparison as a sign (ordinal: the pairs by sign)."""
    own = operators or {}
    gone = {f"without:{u}": [u] for u in units} | {f"operator:{o}": [u for u in units if own.get(u) == o] for o in sorted(set(own.values()))}
    each = [(name, out, 0.0) for name, out in gone.items()] + [(f"{kind}:{u}", [u], scale) for u in units for kind, scale in (("less", 0.8), ("more", 1.2))]
    spread = pairs.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.array(*map(F.lit, out)).alias("out"), F.lit(scale).alias("scale")) for n, out, scale in each])))
    w = F.col("weight") * F.when(F.array_contains("s.out", F.col("unit")), F.col("s.scale")).otherwise(1.0)
    found = spread.groupBy(F.col("s.scenario").alias("scenario"), "a", "b").agg(F.sum(w * F.col("p")).alias("net"))
    if ordinal is not None:
        found = found.unionByName(ordinal.groupBy("a", "b").agg(F.sum(F.col("weight") * F.col("p")).alias("net")).withColumn("scenario", F.lit("ordinal")))
    return found


def stability(ranks: DataFrame, base: DataFrame, span: int = 3) -> DataFrame:
    """(model, best, worst, sensitive) over all scenarios and the base order."""
    every = ranks.select("model", "rank").unionByName(base.select("model", "rank"))
    out = every.groupBy("model").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))
    return out.withColumn("sensitive", F.col("worst") - F.col("best") >= span)


def qualified(scores: DataFrame, units: DataFrame, sources: int, operators: int, families: int) -> DataFrame:
    """Models with enough evidence: distinct units, operators and families."""
    seen = scores.filter(F.col("score").isNotNull()).join(units, "unit").groupBy("model").agg(F.count_distinct("unit").alias("sources"), F.count_distinct("operator").alias("operators"), F.count_distinct("family").alias("families"), F.sum("weight").alias("coverage"))
    return seen.filter((F.col("sources") >= sources) & (F.col("operators") >= operators) & (F.col("families") >= families))


def competition(order: list[Column]):
    from pyspark.sql import Window

    return F.rank().over(Window.orderBy(*order))
