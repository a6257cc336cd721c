"""Cosine near-duplicates of vectors by an epsilon grid order join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, lean, materialize, range_prefix

LEADING = 8
ORDERED = 4
FAN = 8  # intervals under a node of the tree
SIDE = 4  # intervals of a side that meet in one task
SLACK = 1e-6  # more than rounding moves any of the axes


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack(column.to_numpy()).astype(np.float64).reshape(-1, dim)
    # scaled first, so that squares of very large or small components neither overflow nor vanish
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """The leading principal axes of all unit vectors, from sums of dim x dim numbers, one set for each partition."""

    def sums(batches):
        total, count = np.zeros((dim + 1, dim)), 0
        for batch in batches:
            if len(batch):
                x = _vectors(batch["embedding"], dim)
                total[:dim] += x.T @ x
                total[dim] += x.sum(axis=0)
                count += len(x)
        if count:
            yield pd.DataFrame({"place": np.arange((dim + 1) * dim), "value": total.ravel(), "n": count})

    parts = classes.select("embedding").mapInPandas(lean(sums), "place int, value double, n long")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).toPandas().sort_values("place")
    total = rows["value"].to_numpy().reshape(dim + 1, dim)
    n = int(rows["n"].iloc[0])
    covariance = total[:dim] / n - np.outer(total[dim], total[dim]) / n**2
    _, axes = np.linalg.eigh(covariance)
    return np.ascontiguousarray(axes[:, ::-1][:, : min(LEADING, dim)])


class _Groups:
    """Union-find over local row numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def join_intervals(x: np.ndarray, lead: np.ndarray, weight: np.ndarray, split: int, same: bool, least: float, leaf: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join rows [0, split) with [split, n), or all rows with themselves (same), in grid order.

    Intervals are halved until they are leaves; a pair of intervals whose boxes on the leading axes lie further apart
    than the distance of the least cosine is skipped. Returns the weight of the linked rows of each row, and edges that
    keep the components, at most one for each row.
    """
    n = len(x)
    far = (np.sqrt(2 - 2 * least) + SLACK) ** 2  # squared distance of unit vectors
    counts, groups = np.zeros(n, np.int64), _Groups(n)
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in boxes:
            boxes[a, b] = lead[a:b].min(axis=0), lead[a:b].max(axis=0)
        return boxes[a, b]

    todo = [(0, n, 0, n)] if same else [(0, split, split, n)]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        if (a, b) != (c, d):
            (lo, hi), (low, high) = box(a, b), box(c, d)
            gap = np.maximum(0, np.maximum(lo - high, low - hi))
            if gap @ gap > far:
                continue
        if b - a > leaf or d - c > leaf:
            if (a, b) == (c, d):
                m = (a + b) // 2
                todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            elif b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        hit = x[a:b] @ x[c:d].T >= least
        own = (a, b) == (c, d)
        if own:
            np.fill_diagonal(hit, False)
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            continue
        counts[a:b] += hit @ weight[c:d]
        if not own:
            counts[c:d] += weight[a:b] @ hit
        # a row's first link, and each column's first row: enough once rows that share a column are joined
        cols = np.flatnonzero(hit.any(axis=0))
        firsts = hit[:, cols].argmax(axis=0)
        for j, i in zip(cols.tolist(), firsts.tolist()):
            groups.link(a + i, c + j)
        first_col = hit[rows].argmax(axis=1)
        for i, j in zip(rows.tolist(), first_col.tolist()):
            groups.link(a + i, c + j)
        label = np.array([groups.find(v) for v in range(c, d)])
        for i in rows.tolist():
            for r in np.unique(label[hit[i]]).tolist():
                groups.link(a + i, r)
    roots = np.array([groups.find(v) for v in range(n)], np.int64)
    child = np.flatnonzero(roots != np.arange(n))
    return counts, child, roots[child]


def close_intervals(boxes: DataFrame, axes: int, far: float) -> DataFrame:
    """Pairs (i, j), i <= j, of intervals whose boxes lie no further apart than the squared distance `far`.

    boxes: interval, lo0.. and hi0.. by axis. The intervals are the leaves of a tree; from its root on, pairs of nodes
    that lie near enough give the pairs of their children, so intervals under distant nodes never meet.
    """
    ends = [f"{e}{k}" for k in range(axes) for e in ("lo", "hi")]
    last = boxes.agg(F.max("interval")).first()[0] or 0
    levels = [boxes.select("interval", *ends)]
    while last:
        last //= FAN
        up = levels[-1].groupBy(F.expr(f"interval div {FAN}").alias("interval"))
        levels.append(materialize(up.agg(*[(F.min if e.startswith("lo") else F.max)(e).alias(e) for e in ends]), "nodes"))
    pairs = levels[-1].select(F.col("interval").alias("i"), F.col("interval").alias("j"))
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")), 2) for k in range(axes)), F.lit(0.0))
    for nodes in levels[-2::-1]:
        boxed = nodes.select(F.expr(f"interval div {FAN}").alias("up"), F.struct("interval", *ends).alias("box"))
        met = pairs.join(boxed.select(F.col("up").alias("i"), F.col("box").alias("a")), "i").join(boxed.select(F.col("up").alias("j"), F.col("box").alias("b")), "j")
        met = met.where((F.col("a.interval") <= F.col("b.interval")) & (apart <= far))
        pairs = materialize(met.select(F.col("a.interval").alias("i"), F.col("b.interval").alias("j")), "pairs")
    return pairs


def _joined_classes(classes: DataFrame, dim: int, least: float, interval_rows: int) -> tuple[DataFrame, DataFrame]:
    """(links, edges) of the classes of one dimension: (rank, n) and (u, v), by rank in grid order."""
    axes = principal_axes(classes, dim)
    eps = float(np.sqrt(2 - 2 * least))
    k = axes.shape[1] + 1
    lead_type = ", ".join(f"l{i} double" for i in range(k))
    kind = classes.schema["embedding"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            if not len(batch):
                continue
            lead = _vectors(batch["embedding"], dim) @ axes
            # the length of what the axes leave over is one more axis: it differs by no more than the vectors do
            rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1, keepdims=True)))
            out = pd.DataFrame(np.concatenate([lead, rest], axis=1), columns=[f"l{i}" for i in range(k)])
            out.insert(0, "cell_id", batch["cell_id"].to_numpy())
            out["embedding"] = batch["embedding"].to_numpy()
            out["copies"] = batch["copies"].to_numpy()
            yield out

    projected = classes.select("cell_id", "embedding", "copies").mapInPandas(lean(project), f"cell_id long, {lead_type}, embedding {kind}, copies long")
    order = [F.floor(F.col(f"l{i}") / eps) for i in range(min(ORDERED, k))] + [F.col("l0"), F.col("cell_id")]
    ranked = range_prefix(projected.withColumn("one", F.lit(1)), order, {"rank": "one"})
    ranked = materialize(ranked.withColumn("interval", F.expr(f"(rank - 1) div {interval_rows}")), "ranked")
    boxes = ranked.groupBy("interval").agg(*[f(f"l{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))])
    # the rest's square root loses digits near zero, so boxes may be off by its rounding
    pairs = close_intervals(materialize(boxes, "boxes"), k, (eps + SLACK) ** 2)
    # a task joins up to SIDE intervals with as many others: each is shipped once for all of them that are near
    meets = pairs.select("i", "j", F.expr(f"i div {SIDE}").alias("p"), F.expr(f"j div {SIDE}").alias("q"))
    sides = meets.select("p", "q", F.explode(F.array("i", "j")).alias("interval")).distinct()

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rank", kind="stable")
        x, lead = _vectors(df["embedding"], dim), df[[f"l{i}" for i in range(k)]].to_numpy()
        p, q = int(df["p"].iloc[0]), int(df["q"].iloc[0])
        split = int((df["interval"] // SIDE == p).sum())
        rank, weight = df["rank"].to_numpy(np.int64), df["copies"].to_numpy(np.int64)
        counts, child, root = join_intervals(x, lead, weight, split, p == q, least)
        full = np.flatnonzero(counts)
        return pd.concat([
            pd.DataFrame({"u": rank[full], "v": -1, "n": counts[full]}),
            pd.DataFrame({"u": rank[child], "v": rank[root], "n": 0}),
        ])

    rows = ranked.select("rank", "interval", "embedding", "copies", *[f"l{i}" for i in range(k)]).join(sides, "interval")
    out = materialize(rows.groupBy("p", "q").applyInPandas(compare, "u long, v long, n long"), "links")
    links = out.where("v < 0").groupBy("u").agg(F.sum("n").alias("n"))
    label = ranked.select("rank", "cell_id")
    links = links.join(label, F.col("u") == F.col("rank")).select("cell_id", "n")
    edges = out.where("v >= 0").select("u", "v")
    name = lambda d, c: d.join(label.withColumnRenamed("rank", c), c).drop(c).withColumnRenamed("cell_id", c)
    return links, name(name(edges, "u"), "v")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95, interval_rows: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a cosine of at least `least`), component_id (least vec_id
    reachable by links), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    lengths don't link. Components of type float stay floats, any other number is a double; cosines are doubles. Equal
    vectors are held once with their number, so copies cost nothing. Null vec_id: a row, never
    kept. Repeated vec_id: each row is a vector of its own. No rows: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    vectors = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    clean = F.transform("embedding", lambda v: v + F.lit(0.0).cast(kind))
    good = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, clean).alias("embedding"))
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    grouped = rows.where("embedding is not null").groupBy("h", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(grouped.withColumn("cell_id", F.monotonically_increasing_id()), "classes")
    links, edges = spark.createDataFrame([], "cell_id long, n long"), spark.createDataFrame([], "u long, v long")
    for r in classes.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect():
        # long vectors come in shorter intervals, so that a task's matrices keep their size
        rows_each = min(interval_rows, max(128, (1 << 21) // r["dim"]))
        one = _joined_classes(classes.where(F.size("embedding") == r["dim"]), r["dim"], least, rows_each)
        links, edges = links.unionByName(one[0]), edges.unionByName(one[1])
    labels = connected_components(edges).withColumnRenamed("node", "cell_id")
    known = classes.join(labels, "cell_id", "left").withColumn("component", F.coalesce("component", "cell_id"))
    first = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(first, "component").join(links, "cell_id", "left")
    known = materialize(known.select("h", "embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    # vectors that link with nothing get keys of their own, so that they don't meet
    left = rows.withColumn("h", F.when(F.col("embedding").isNull(), F.xxhash64("vec_id")).otherwise(F.col("h")))
    out = left.join(known, ["h", "embedding"], "left")
    component = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
