"""Near-zero distance joins by projection buckets, and nearest neighbours in an index cut into cells.

Two vectors within eps of each other have projections on any unit vector within eps, so
they fall in the same bucket of that width or in adjoining ones. The asking side takes
three buckets, an equi-join on the bucket finds all candidates, and their exact
distance decides. Equal vectors are one row with its counts before anything is joined,
so repeated rows cannot make a bucket large; candidates in a bucket are those that
already lie within eps on the projection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite_or_zero, is_numeric
from ..functions.lineage import ship

NEAR = 1e-6


#: Doubles that a value which is no number becomes: 20 bits of its hash each, so two values that differ are apart by far
#: more than NEAR after scaling, and no two of even many millions share all of them.
CODES = 3


def numeric_view(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as doubles: a number with infinities and gaps as 0, another value as CODES codes that equal values share."""
    out = []
    for c in columns:
        if is_numeric(df, c):
            out.append(finite_or_zero(F.col(c)))
        else:
            part = lambda k, c=c: F.shiftrightunsigned(F.xxhash64(F.col(c).cast("string")), 20 * k).bitwiseAND(F.lit((1 << 20) - 1))
            out += [F.when(F.col(c).isNull(), -1.0).otherwise(part(k).cast("double")) for k in range(CODES)]
    return out


def width(df: DataFrame, columns: list[str]) -> int:
    """How many doubles the columns become."""
    return sum(1 if is_numeric(df, c) else CODES for c in columns)


def scaler(df: DataFrame, columns: list[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation of the numeric view, 1 for a deviation of 0."""
    xs = numeric_view(df, columns)
    row = df.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(xs)], *[F.stddev_pop(x).alias(f"s{k}") for k, x in enumerate(xs)]).first()
    n = range(len(xs))
    return [row[f"m{k}"] or 0.0 for k in n], [row[f"s{k}"] or 1.0 for k in n]


def scaled(df: DataFrame, columns: list[str], scale: tuple[list[float], list[float]], out: str = "v") -> DataFrame:
    xs = numeric_view(df, columns)
    return df.withColumn(out, F.array(*[(x - F.lit(m)) / F.lit(s) for x, m, s in zip(xs, *scale, strict=True)]))


def _buckets(v: Column, dims: int, seed: int, eps: float) -> Column:
    w = np.random.default_rng(seed).standard_normal(dims)
    w /= np.linalg.norm(w)
    dot = F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    # the width leaves room for rounding of the projection
    return F.floor(dot / max(eps, 1e-9) / 1.001).cast("long")


def _distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def near_pairs(asking: DataFrame, index: DataFrame, dims: int, eps: float = NEAR, seed: int = 0) -> DataFrame:
    """Pairs of distinct vectors (v of asking as `v`, v of index as `u`) closer than eps, equal ones included, with d2 and index's other columns."""
    a = asking.select("v").distinct().withColumn("b", _buckets(F.col("v"), dims, seed, eps)).select("v", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    i = index.withColumnRenamed("v", "u").withColumn("b", _buckets(F.col("u"), dims, seed, eps))
    joined = i.join(a, "b").withColumn("d2", _distance2(F.col("u"), F.col("v")))
    return joined.where(F.col("d2") < eps * eps).drop("b")


def near_zero(asking: DataFrame, index: DataFrame, dims: int, row_id: str, eps: float = NEAR, seed: int = 0) -> DataFrame:
    """asking (v, row_id, ...) with `near`: whether index holds another row (by row_id) closer than eps."""
    by = index.groupBy("v").agg(F.count("*").alias("n"), F.min(row_id).alias("lo"), F.max(row_id).alias("hi"))
    pairs = near_pairs(asking, by, dims, eps, seed).groupBy("v").agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    # some id among the near ones is not the asking row's own unless all of them are
    x = asking.join(pairs, "v", "left")
    other = (F.col("__lo") != F.col(row_id)) | (F.col("__hi") != F.col(row_id))
    return x.withColumn("near", F.coalesce(other, F.lit(False))).drop("__lo", "__hi")


def confused_rows(rows: DataFrame, dims: int, label: str, row_id: str, eps: float = NEAR, seed: int = 0) -> DataFrame:
    """(row_id, label, other): rows with another label closer than eps, unless a row of their own label is strictly nearer."""
    by = rows.groupBy("v", F.col(label).alias("u_label")).agg(F.count("*").alias("n"))
    pairs = near_pairs(rows, by, dims, eps, seed)
    same = F.col("u_label") == F.col(label)
    own = same & (F.col("d2") == 0)
    # equal rows of the label, less the row itself
    x = rows.join(pairs, "v").withColumn("m", F.col("n") - F.when(own, 1).otherwise(0)).where("m > 0")
    best = x.groupBy(row_id, label).agg(F.min(F.when(same, F.col("d2"))).alias("mine"), F.min(F.when(~same, F.struct("d2", "u_label"))).alias("theirs"))
    return best.where(F.col("theirs").isNotNull() & (F.col("mine").isNull() | (F.col("theirs.d2") <= F.col("mine")))).select(row_id, label, F.col("theirs.u_label").alias("other"))


#: Points of a cell of the index, and points that its cuts are chosen from, for each cell.
CELL, CUT_ON = 8192, 64


def _cell_of(tree: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    """The cell of each row. tree: (dimension, cut, where the lower and the upper part go on), a part below 0 being the cell -1 - part."""
    at = np.zeros(len(x), int) if tree else np.full(len(x), -1)
    if tree:
        dim, cut, low, high = (np.array(c) for c in zip(*tree, strict=True))
        while len(go := np.flatnonzero(at >= 0)):
            k = at[go]
            at[go] = np.where(x[go, dim[k]] <= cut[k], low[k], high[k])
    return -1 - at


def _cut(x: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree that cuts the points in halves, across their widest dimension, until there are so many cells."""
    tree: list[tuple[int, float, int, int]] = []
    made = 0

    def part(x: np.ndarray, cells: int) -> int:
        nonlocal made
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        if cells < 2 or not spread.max() > 0:
            made += 1
            return -made
        d, here = int(spread.argmax()), len(tree)
        cut = float(np.median(x[:, d]))
        cut = cut if cut < x[:, d].max() else float(x[x[:, d] < cut, d].max())
        tree.append((d, cut, 0, 0))
        low = x[:, d] <= cut
        tree[here] = (d, cut, part(x[low], cells // 2), part(x[~low], cells - cells // 2))
        return here

    part(x, cells)
    return tree


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _nearest_in(q: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, k: int) -> Iterator[list[tuple[float, int, int]]]:
    """For each q the nearest of the points x that hold k rows together, as (distance^2, class, rows), by distance and class."""
    norm, few = (x**2).sum(axis=1), min(k, len(x))
    step = max(1, (1 << 21) // max(1, len(x)))
    for s in range(0, len(q), step):
        a = q[s : s + step]
        own = (a**2).sum(axis=1)
        d = own[:, None] + norm[None, :] - 2 * a @ x.T  # finds candidates; its rounding is allowed for, and they are measured exactly
        reach = np.partition(d, few - 1, axis=1)[:, few - 1] + 1e-12 * x.shape[1] * (own + norm.max() + 1)
        i, j = np.nonzero(d <= reach[:, None])
        exact = ((a[i] - x[j]) ** 2).sum(axis=1)
        order = np.lexsort((y[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(a) + 1))
        sums = np.r_[0, np.cumsum(m[j])]
        before = sums[:-1] - sums[first[i]]
        for r in range(len(a)):
            at = slice(first[r], first[r] + int(np.searchsorted(before[first[r] : first[r + 1]], k)))
            yield list(zip(exact[at].tolist(), y[j[at]].tolist(), m[j[at]].tolist(), strict=True))


class Nearest:
    """Votes of the k nearest rows (v, y) of an index, which is exact, of any size, and lies on no single machine.

    Equal rows of one class are one point with their number. A tree chosen on some of the
    points cuts the space into cells of some CELL points each. A row is first answered in
    its own cell, then in the cells whose box is no farther than the k-th row found there.
    Cells are sorted streams of their points and then the rows that ask, so a task holds
    the points of one cell. Of equally near rows those of the lower class go first.
    """

    def __init__(self, rows: DataFrame, k: int) -> None:
        self.k = k
        ship(rows.sparkSession)
        points = rows.groupBy("v", "y").agg(F.count("*").alias("m"))
        found = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        self.cells, self.dims = max(1, -(-found["n"] // max(CELL, 4 * k))), found["d"] or 0
        share = F.lit(min(1.0, self.cells * CUT_ON / max(1, found["n"])))
        some = points.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < share * (1 << 20)).select("v").toPandas() if self.cells > 1 else None  # CUT_ON a cell
        self.tree = tree = _cut(_matrix(some["v"]), self.cells) if some is not None and len(some) else []

        def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(cell=_cell_of(tree, _matrix(f["v"])).astype(np.int32))

        self.placed = placed
        self.points = points.select("v", F.col("y").cast("int").alias("y"), F.col("m").cast("long").alias("m")).mapInPandas(placed, "v array<double>, y int, m long, cell int")
        edges = [f(F.get("v", F.lit(j))).alias(f"{n}{j}") for j in range(self.dims) for n, f in (("lo", F.min), ("hi", F.max))]
        boxes = self.points.groupBy("cell").agg(*edges).orderBy("cell").collect() if self.tree else []  # a row a cell
        self.boxes = (np.array([r["cell"] for r in boxes]), *(np.array([[r[f"{n}{j}"] for j in range(self.dims)] for r in boxes]) for n in ("lo", "hi")))

    def _met(self, asking: DataFrame, first: bool) -> DataFrame:
        """asking (v, cell, near) with `near` found in its cell, and in the first round rows without it for other cells to be asked; a row that has its answer stays."""
        k, (cells, lo, hi) = self.k, self.boxes
        schema = "v array<double>, cell int, near array<struct<d: double, y: int, m: long>>"
        index = self.points.select("cell", F.lit(0).alias("ask"), "v", "y", "m", F.lit(None).cast("array<struct<d: double, y: int, m: long>>").alias("near"))
        ask = asking.select("cell", F.lit(1).alias("ask"), "v", F.lit(0).alias("y"), F.lit(0).cast("long").alias("m"), "near")

        def answer(f: pd.DataFrame, points: tuple[np.ndarray, np.ndarray, np.ndarray] | None, cell: int) -> pd.DataFrame:
            todo = f["near"].isna().to_numpy()
            done, f = f[~todo], f[todo]
            q = _matrix(f["v"]) if len(f) else np.zeros((0, 1))
            near = list(_nearest_in(q, *points, k)) if points is not None and len(q) else [[] for _ in q]
            out = [(v, cell, n) for v, n in zip(f["v"], near, strict=True)]
            if first and len(cells) and len(q):
                reach = np.array([n[-1][0] if sum(x[2] for x in n) >= k else np.inf for n in near])
                for s in range(0, len(q), 1024):
                    a = q[s : s + 1024]
                    away = sum((np.maximum(np.maximum(lo[None, :, j] - a[:, None, j], a[:, None, j] - hi[None, :, j]), 0) ** 2 for j in range(a.shape[1])), np.zeros((len(a), len(cells))))
                    for r, c in zip(*np.nonzero((away <= reach[s : s + 1024, None]) & (cells != cell)[None, :]), strict=True):
                        out.append((f["v"].iloc[s + r], int(cells[c]), None))
            return pd.concat([done[["v", "cell", "near"]], pd.DataFrame(out, columns=["v", "cell", "near"])]) if len(done) else pd.DataFrame(out, columns=["v", "cell", "near"])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cell, parts, points = None, [], None
            for f in frames:
                for c, g in f.groupby("cell", sort=True):
                    if c != cell:
                        cell, parts, points = c, [], None
                    mine, asked = g[g["ask"] == 0], g[g["ask"] == 1]
                    if len(mine):
                        parts.append((_matrix(mine["v"]), mine["y"].to_numpy(), mine["m"].to_numpy()))
                    if len(asked):
                        if points is None and parts:
                            points, parts = tuple(np.concatenate(p) for p in zip(*parts, strict=True)), []
                        yield answer(asked, points, int(c))

        return index.unionByName(ask).repartition("cell").sortWithinPartitions("cell", "ask").mapInPandas(run, schema)

    def votes(self, asking: DataFrame, classes: int) -> DataFrame:
        """asking (v, ...) with `votes`: how many of the k nearest rows are of each class."""
        asked = asking.select("v").where(F.col("v").isNotNull()).distinct().mapInPandas(self.placed, "v array<double>, cell int")
        found = self._met(asked.withColumn("near", F.lit(None).cast("array<struct<d: double, y: int, m: long>>")), True)
        if len(self.boxes[0]) > 1:
            found = self._met(found, False)
        near = found.groupBy("v").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
        start = F.struct(F.lit(self.k).cast("long").alias("left"), F.array_repeat(F.lit(0.0), classes).alias("votes"))

        def taken(have: Column, x: Column) -> Column:
            n = F.least(have["left"], x["m"])
            return F.struct((have["left"] - n).alias("left"), F.transform(have["votes"], lambda v, i: v + F.when(i == x["y"], n).otherwise(0)).alias("votes"))

        return asking.join(near.select("v", F.aggregate("near", start, taken)["votes"].alias("votes")), "v", "left")
