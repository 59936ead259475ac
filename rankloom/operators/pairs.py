"""All pairs of a query's rows under a pairwise logistic loss: its value, gradient and curvature, summed in blocks.

No pair ever is a row of a table. A query of up to `BLOCK` rows meets itself in one task, together with others of that kind; the
rows of a larger one are dealt to blocks, and each pair of blocks is a group of its own, so no task gets a whole query. Work is
as many as the pairs, memory as the rows of two blocks; what comes to the driver grows with the features alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.sources.folders import small_tasks, stored

#: Rows of a query that meet in one piece, about, and rows that are set against the others at a time.
BLOCK, AT_A_TIME = 4096, 32
GROUP = ["_large", "_bundle", "_a", "_b"]


def dealt(rows: DataFrame) -> DataFrame:
    """`rows` (_query, _gain, _x) with where they belong: _large (the query, if it takes several blocks) or _bundle (where small
    queries meet), the number of blocks, _n, and the row's own, _p. Rows without a query are one query."""
    large = rows.groupBy(F.col("_query").alias("_large")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")).where("_n > 1")
    # A large query has more than `BLOCK` rows, so there are far fewer of them than rows.
    held = rows.join(F.broadcast(large), rows["_query"].eqNullSafe(large["_large"]), "left").na.fill(1, ["_n"])
    bundles = -(-rows.count() // BLOCK) or 1
    return held.withColumns({
        "_bundle": F.when(F.col("_n") == 1, F.pmod(F.xxhash64("_query"), F.lit(bundles))).otherwise(-1),
        "_p": F.pmod(F.monotonically_increasing_id(), F.col("_n")).cast("int")})


def grouped(rows: DataFrame) -> DataFrame:
    """Rows as `dealt` gives them, once for each group that they are in, with the group's blocks, _a <= _b."""
    each = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return each.select("_large", "_bundle", F.least("_p", "_q").alias("_a"), F.greatest("_p", "_q").alias("_b"), "_p", "_query", "_gain", "_x")


def block(x: np.ndarray, gain: np.ndarray, other: np.ndarray, theirs: np.ndarray, weights: np.ndarray, once: bool) -> np.ndarray:
    """Weight, loss, gradient and curvature (in one array) of all pairs of a row with an other. With `once` both sides are the same
    rows, and a row meets those after it."""
    d = len(weights)
    weight, loss, slope, bend = 0.0, 0.0, np.zeros(d), np.zeros((d, d))
    s, t = x @ weights, other @ weights
    for at in range(0, len(x), AT_A_TIME):
        part, rest = slice(at, at + AT_A_TIME), slice(at if once else 0, None)
        gap = gain[part, None] - theirs[None, rest]
        margin = (s[part, None] - t[None, rest]) * np.sign(gap)
        size = np.abs(gap)
        if once:
            size[:, : len(size)] = np.triu(size[:, : len(size)], 1)
        less = np.exp(-np.abs(margin))
        miss = np.where(margin < 0, 1.0, less) / (1 + less)
        pull = size * miss
        h = pull * (1 - miss)
        weight, loss = weight + size.sum(), loss + np.vdot(size, np.log1p(less) - np.minimum(margin, 0.0))
        pull, a, b = np.copysign(pull, gap), x[part], other[rest]
        cross = a.T @ h @ b
        slope += b.T @ pull.sum(0) - a.T @ pull.sum(1)
        bend += (a.T * h.sum(1)) @ a + (b.T * h.sum(0)) @ b - cross - cross.T
    return np.concatenate([[weight, loss], slope, bend.ravel()])


def measured(rows: DataFrame, weights: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Sums over all pairs of unequal gain, each times its gap in gain: 1, the loss log(1 + exp(-margin)) of the linear scores'
    margin, and its gradient and curvature by the weights. `rows` are as `dealt` gives them."""
    d = len(weights)

    def run(table: pa.Table) -> pa.Table:
        x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, d)
        # Only differences count; without the mean they lose no digits.
        x, gain = x - x.mean(0), table.column("_gain").to_numpy()
        out = np.zeros(2 + d + d * d)
        if table.column("_a")[0].as_py() < table.column("_b")[0].as_py():
            left = table.column("_p").to_numpy() == table.column("_a")[0].as_py()
            out += block(x[left], gain[left], x[~left], gain[~left], weights, False)
        else:
            of = table.column("_query").combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(of, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                out += block(x[own], gain[own], x[own], gain[own], weights, True)
        return pa.table({"sums": pa.array([out.tolist()], pa.list_(pa.float64()))})

    parts = grouped(rows).groupBy(*GROUP).applyInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    sums = np.zeros(2 + d + d * d)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        sums[r["at"]] = r.x
    return float(sums[0]), float(sums[1]), sums[2 : 2 + d], sums[2 + d :].reshape(d, d)


def fitted(rows: DataFrame, features: int, ridge: float, steps: int, enough: float) -> list[float]:
    """Weights of the least mean loss of `rows` (_query, _gain, _x) over all pairs, plus half of `ridge` times their squares, by
    Newton steps, each a job; a step that doesn't bring the loss down is halved. Without a pair all weights are 0."""
    w = np.zeros(features)
    # Rows are numbered as they come, so they are dealt once.
    held = stored(dealt(rows), "pair-blocks")

    def at(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        weight, loss, slope, bend = measured(held, w)
        n = weight or 1.0
        return weight, loss / n + ridge / 2 * w @ w, slope / n + ridge * w, bend / n + ridge * np.eye(features)

    with small_tasks(rows.sparkSession, held.agg(F.sum("_n")).first()[0] or 0):
        weight, loss, slope, bend = at(w)
        for _ in range(steps if weight else 0):
            size = 1 / np.sqrt(np.diag(bend))
            step = -size * np.linalg.solve(bend * size[:, None] * size[None, :], size * slope)
            fall, part = float(-slope @ step), 1.0
            if fall < enough:
                break
            new = at(w + step)
            while not new[1] <= loss - 1e-4 * part * fall and part > 1e-6:
                part /= 2
                new = at(w + part * step)
            if not new[1] <= loss:
                break
            w, (_, loss, slope, bend) = w + part * step, new
    return [float(c) for c in w]
