"""Exact nearest rows within groups: pivots, cells and the triangle inequality.

Rows lie in the cell of their nearest pivot. Neighbours inside a block of its own cell bound how far
a row must look; it visits just the cells that could hold something nearer, that is whose pivot is no farther than that bound and
the cell's radius together. Cells and their visitors are cut into blocks, so a task never holds more than two of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.operators import summaries as S
from tallywatch.session import stored

#: Distinct rows to a cell while there are pivots for it, pivots of a group at most, and rows of a block.
CELL, PIVOTS, BLOCK = 1024, 1024, 2048
#: Cells of all groups that the driver may know at once.
CELLS = 100_000


def _distances(a, b):
    """Euclidean distances of all rows of two tables, features added in order."""
    import numpy as np

    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j : j + 1] - b[None, :, j]) ** 2
    return np.sqrt(out)


def nearest_rows(df: DataFrame, group: str, key: str, features: Sequence[str], k: int) -> DataFrame:
    """(group, key, x, near): every row's ``k`` nearest other rows of its group, as structs far, key, x by distance and then key.

    Distances are Euclidean over the features as they stand. Rows without a group or a key, or with a missing or
    non-finite feature, take no part; a group of fewer than k + 1 rows has fewer neighbours. ``key`` names one row.
    Equal rows are looked up once, with the k + 1 smallest of their keys, so copies cost no more than one row; the
    join that hands them their neighbours has one row per distinct vector on its other side.
    """
    import numpy as np
    import pyarrow as pa

    d = len(features)
    whole = F.array(*[F.col(f).cast("double") for f in features])
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(key).alias("key"), whole.alias("x")).where(fine & F.col("g").isNotNull() & F.col("key").isNotNull())
    rows = rows.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    kind = rows.schema["key"].dataType.simpleString()
    keys = S.top_rows(rows, ["g", "x"], [F.col("key")], k + 1)
    vectors = stored(keys.groupBy("g", "x").agg(F.sort_array(F.collect_list("key")).alias("keys")), "vectors")

    sizes = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.ceil(F.col("n") / CELL), F.lit(PIVOTS))
    picked = S.top_rows(vectors.select("g", "x", F.xxhash64("x").alias("h")), ["g"], [F.col("h"), F.col("x")], PIVOTS).join(sizes, "g").where(F.col("rank") <= wanted)
    pivots: dict[str, np.ndarray] = {}
    table = picked.orderBy("g", "rank").select("g", "x").limit(CELLS + 1).toArrow()
    if table.num_rows > CELLS:
        raise ValueError(f"more than {CELLS} cells: too many groups for a table of pivots")
    for g, x in zip(table.column("g").to_pylist(), table.column("x").to_pylist()):
        pivots.setdefault(g, []).append(x)
    pivots = {g: np.array(x, float).reshape(-1, d) for g, x in pivots.items()}

    def placed(batches):
        for batch in batches:
            g = np.array(batch.column(0).to_pylist(), object)
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            cell, far = np.zeros(len(g), np.int32), np.zeros(len(g))
            for name in dict.fromkeys(g.tolist()):
                at = np.nonzero(g == name)[0]
                for a in range(0, len(at), 4096):
                    some = at[a : a + 4096]
                    away = _distances(x[some], pivots[name])
                    cell[some] = away.argmin(1)
                    far[some] = away.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "off"])

    cells = stored(vectors.mapInArrow(placed, f"g string, x array<double>, keys array<{kind}>, cell int, off double"), "cells")
    # One row a cell, of at most CELLS.
    held = {(r.g, r.cell): (r.n, r.radius) for r in cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).collect()}

    def block(n: str):
        """A row's block: rows of a cell over as many blocks as it needs."""
        return F.pmod(F.xxhash64("x"), F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1))).cast("int")

    counts = cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"))
    blocked = stored(cells.join(S.broadcast_if_small(counts), ["g", "cell"]).withColumn("block", block("n")).drop("n"), "blocks")

    def visits(table):
        """The cells that every row of a block must visit, itself's included."""
        g, cell = table.column("g")[0].as_py(), table.column("cell")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
        many = np.diff(table.column("keys").combine_chunks().offsets.to_numpy())
        radius = np.array([held.get((g, c), (0, -np.inf))[1] for c in range(len(pivots[g]))])
        out_row, out_cell = [], []
        for a in range(0, len(x), 256):
            away = _distances(x[a : a + 256], x)
            order = np.argsort(away, axis=1, kind="stable")[:, : k + 1]
            near = np.take_along_axis(away, order, 1)
            reached = np.cumsum(many[order], 1) >= k + 1
            bound = np.where(reached.any(1), near[np.arange(len(near)), reached.argmax(1)], np.inf)
            # A little slack for rounding.
            able = _distances(x[a : a + 256], pivots[g]) - radius <= bound[:, None] * (1 + 1e-9) + 1e-12 * np.abs(x).max()
            r, c = np.nonzero(able & np.isfinite(radius))
            out_row.append(a + r)
            out_cell.append(c)
        row = np.concatenate(out_row)
        return pa.table({"g": pa.array([g] * len(row)), "x": table.column("x").combine_chunks().take(pa.array(row)), "cell": pa.array(np.concatenate(out_cell).astype(np.int32))})

    asks = stored(blocked.groupBy("g", "cell", "block").applyInArrow(visits, "g string, x array<double>, cell int"), "visits")
    asked = S.broadcast_if_small(asks.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("asked")))
    both = S.broadcast_if_small(counts.join(asked, ["g", "cell"]))
    turns = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("asked") / BLOCK), F.lit(1)).cast("int") - 1))
    blocks = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int") - 1))
    known = blocked.select("g", "cell", "block", "x", "keys").join(both, ["g", "cell"]).withColumn("turn", turns).select("g", "cell", "block", "turn", "x", "keys")
    asking = asks.join(both, ["g", "cell"]).withColumn("turn", block("asked")).withColumn("block", blocks)
    asking = asking.select("g", "cell", "block", "turn", "x")

    near_type = f"array<struct<far: double, key: {kind}, x: array<double>>>"

    def meet(left, right):
        g = (left if left.num_rows else right).column("g")[0].as_py()
        q = left.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
        x = right.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
        found, names = [], right.column("keys").to_pylist()
        if not len(x):
            q = q[:0]
        for a in range(0, len(q), 256):
            away = _distances(q[a : a + 256], x)
            top = min(k + 1, len(x))
            limit = np.partition(away, top - 1, axis=1)[:, top - 1]
            for i in range(len(away)):
                at = np.nonzero(away[i] <= limit[i])[0]
                hits = sorted((float(away[i, j]), name, int(j)) for j in at for name in names[j])[: k + 1]
                found.append([{"far": f, "key": n, "x": x[j].tolist()} for f, n, j in hits])
        schema = pa.schema([("g", pa.string()), ("x", pa.list_(pa.float64())), ("near", pa.list_(pa.struct([("far", pa.float64()), ("key", right.schema.field("keys").type.value_type), ("x", pa.list_(pa.float64()))])))])
        return pa.table([pa.array([g] * len(q)), pa.array(q.tolist(), pa.list_(pa.float64())), pa.array(found, schema.field("near").type)], schema=schema)

    by = ("g", "cell", "block", "turn")
    met = asking.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(meet, f"g string, x array<double>, near {near_type}")
    merged = met.groupBy("g", "x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["key"] != F.col("key")), 1, k)
    return rows.join(stored(merged, "near"), ["g", "x"]).select(F.col("g").alias(group), F.col("key").alias(key), "x", others.alias("near"))
