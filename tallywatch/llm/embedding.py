"""Near duplicates of vectors by codes of random rotations.

A vector is scaled to whole numbers and turned by random rotations made of sign flips and Hadamard
transforms, all in exact whole-number arithmetic; the signs after a rotation are its binary code there.
Slices of codes are the keys of hash tables. Once per vector are stored: its signs in all rotations (keys are cut from
these), c = <code, rotated vector> over the first few of them, and the rotated vector there in steps of one byte. Vectors that meet in a bucket are judged by these
alone: <code, rotated other> / c is an unbiased estimate of their inner product, off by more than
z * sqrt((1 - c^2) / (c^2 (D - 1))) only with the probability of z standard deviations; what the steps of a
byte can add is stored as well. Only members with a partner whose upper bound reaches the
threshold get their vectors, and cosines among these are computed in double precision.

Buckets are never turned into pairs of rows: members of a bucket, cut into blocks where it is
large, are compared inside tasks, and a task gives the members to look at again, or counts per
vector and links that join components.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import stored, whole_groups
from tallywatch.llm.graph import components

#: Members of a block of a bucket.
BLOCK = 1024
#: Buckets up to this size are compared together.
SMALL = 16
SCALE = 1 << 20


def rotate(whole: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and an unnormalised Hadamard transform of rows of whole numbers (as float64, exact)."""
    x = whole
    d = x.shape[1]
    for sign in flips:
        x = x * sign
        h = 1
        while h < d:
            x = x.reshape(len(x), d // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, d)
            h *= 2
    return x


class Rotations:
    """Random rotations of a dimension, the tables cut from their codes, and the estimate from codes."""

    def __init__(self, dimension: int, bits: int, tables: int, seed: int = 7):
        self.d = 1 << max(3, (dimension - 1).bit_length())
        self.bits = bits
        self.each = max(1, self.d // bits)
        self.width = min(bits, self.d)
        self.count = -(-tables // self.each)
        self.tables = tables
        rng = np.random.default_rng(seed)
        self.flips = rng.choice(np.array([-1.0, 1.0]), (self.count, 3, self.d))
        self.mix = rng.integers(0, 1 << 63, (tables, self.width), np.uint64) * np.uint64(2) + np.uint64(1)

    def whole(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors as whole numbers, padded to a power of two."""
        out = np.zeros((len(vectors), self.d))
        out[:, : vectors.shape[1]] = np.rint(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * SCALE)
        return out

    def signs(self, whole: np.ndarray) -> np.ndarray:
        """Signs after all rotations, one rotation beside another."""
        return np.concatenate([rotate(whole, f) >= 0 for f in self.flips], axis=1)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """One 64-bit key per row and table; equal signs in the table's slice of a code give equal keys."""
        out = np.empty((len(signs), self.tables), np.uint64)
        for t in range(self.tables):
            at = t // self.each * self.d + t % self.each * self.width
            key = ((signs[:, at : at + self.width].astype(np.uint64) + np.uint64(1)) * self.mix[t]).sum(1, dtype=np.uint64) + np.uint64(t)
            out[:, t] = (key ^ (key >> np.uint64(31))) * self.mix[t, 0]
        return out.view(np.int64)

    def coded(self, whole: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit rotated vectors, unit codes, correction factor <code, vector>) over the first rotations, one beside another."""
        turned = np.concatenate([rotate(whole, f) for f in self.flips[:rotations]], axis=1)
        turned /= np.linalg.norm(turned, axis=1, keepdims=True)
        code = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(turned.shape[1])
        return turned, code, (turned * code).sum(1)


    def compact(self, vectors: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits of the signs in all rotations, rotated vectors as bytes, factor and step and slack per row): what is stored of every vector.

        The slack bounds what rounding to steps can change in the inner product with any code.
        """
        whole = self.whole(vectors)
        turned, _, factor = self.coded(whole, rotations)
        step = np.abs(turned).max(1) / 127
        level = np.rint(turned / step[:, None])
        slack = np.abs(turned - level * step[:, None]).sum(1) / math.sqrt(turned.shape[1])
        return np.packbits(self.signs(whole), axis=1), level.astype(np.int8), np.stack([factor, step, slack], axis=1)


class Estimates:
    """Upper bounds of inner products from what ``Rotations.compact`` gave for some rows."""

    def __init__(self, bits: np.ndarray, level: np.ndarray, figures: np.ndarray, deviations: float):
        d = level.shape[1]
        self.factor, step, self.slack = figures.T
        self.code = (np.unpackbits(bits[:, : d // 8], axis=1).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
        self.turned = level.astype(np.float32) * step[:, None].astype(np.float32)
        # 1e-5 covers the sums in single precision.
        self.margin = deviations * np.sqrt((1 - self.factor**2) / (self.factor**2 * (d - 1))) + 1e-5

    def of_pairs(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ij->i", self.code[p], self.turned[q]) + self.slack[q]) / self.factor[p] + self.margin[p]

    def of_block(self, at: slice) -> np.ndarray:
        return (self.code[at] @ self.turned[at].T + self.slack[None, at]) / self.factor[at, None] + self.margin[at, None]


def _fixed(data: np.ndarray):
    """Rows of bytes as an Arrow binary column."""
    import pyarrow as pa

    offsets = np.arange(0, data.size + 1, data.shape[1], dtype=np.int32) if data.size else np.zeros(len(data) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _rows_of(column, width: int, kind=np.uint8) -> np.ndarray:
    """An Arrow binary column of equally long values as rows."""
    parts = []
    for c in column.chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]])
    return np.concatenate(parts).view(kind).reshape(-1, width)


def plan(count: int, cosine: float, miss: float) -> tuple[int, int]:
    """Bits of a key and number of tables for ``count`` vectors.

    Keys grow with the logarithm of the number of vectors, so that unrelated vectors seldom meet; the
    tables are as many as leave a pair at the threshold unmet with probability ``miss``.
    """
    bits = max(8, math.ceil(math.log2(max(count, 2))) + 3)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def _clean(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False)).alias("able"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = 1e-5, deviations: float = 6.0, rotations: int = 4) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts other vectors with a cosine of ``cosine`` or more, equal vectors included; component_id is the
    smallest vec_id that links reach. Vectors that are null, zero, or hold nulls or non-finite
    numbers have no links and are their own component, as is a row with a null vec_id (component null, kept). Vectors of different
    length never link. Equal vectors are one node, weighted by their rows; rows that repeat a vec_id
    count as vectors of their own.
    """
    rows = _clean(vectors)
    # Equal vectors are one node from the start: one row per distinct vector, with its number of rows.
    classes = rows.where("able").groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    classes = stored(classes, "vectors")
    shapes = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts, links = [], []
    for shape in shapes:  # one run per dimension: a column of vectors has one, or very few
        c, pairs = _links(classes.where(F.size("v") == shape.d), shape.d, shape.n, cosine, miss, deviations, rotations)
        counts.append(c)
        links.append(pairs)
    if not shapes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    count, pairs = counts[0], links[0]
    for c, p in zip(counts[1:], links[1:]):
        count, pairs = count.unionByName(c), pairs.unionByName(p)
    found = components(pairs)
    named = classes.join(count.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(found, "node", "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.where("able").join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(classes: DataFrame, dimension: int, count: int, cosine: float, miss: float, deviations: float, rotations: int):
    """(node, links) and (a, b): per vector the weights of its links, and links enough for the components."""
    bits, tables = plan(count, cosine, miss)
    turns = Rotations(dimension, bits, tables)
    parts = min(rotations, turns.count)

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            node = batch.column(0)
            x = batch.column(1).flatten().to_numpy().reshape(-1, dimension)
            for a in range(0, len(x), 2048):
                signs, level, figures = turns.compact(x[a : a + 2048], parts)
                yield pa.RecordBatch.from_arrays(
                    [node.slice(a, len(level)), _fixed(signs), _fixed(level.view(np.uint8)), *[pa.array(f) for f in figures.T]],
                    ["node", "signs", "level", "factor", "step", "slack"],
                )

    def key(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                some = pa.Table.from_batches([batch.slice(a, 2048)])
                keys = turns.keys(signs_of(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(some.column(0).to_numpy(), turns.tables), pa.int64()), pa.array(np.tile(np.arange(turns.tables, dtype=np.int32), len(keys))), pa.array(keys.ravel())],
                    ["node", "table", "key"],
                )

    def signs_of(rows):
        return np.unpackbits(_rows_of(rows.column("signs"), turns.count * turns.d // 8), axis=1).view(bool)

    coded = stored(classes.select("node", "v").mapInArrow(code, "node long, signs binary, level binary, factor double, step double, slack double"), "signs")
    banded = stored(coded.select("node", "signs").mapInArrow(key, "node long, table int, key long"), "codes")
    full = banded.groupBy("table", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = banded.join(full, ["table", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "key"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    place = ["table", "key", "i", "j"]
    dealt = dealt.withColumn("meets", F.explode(meets)).select("table", "key", "meets.i", "meets.j", "own", "node")

    def together(members: DataFrame) -> DataFrame:
        return members.repartition(*place).sortWithinPartitions(*place)

    def pairs(rows, group, of_pairs, of_block):
        """Pairs of rows of one group whose figure reaches the threshold."""
        i, j, own = (rows.column(c).to_numpy() for c in ("i", "j", "own"))
        starts = np.nonzero(np.diff(group, prepend=-1))[0]
        sizes = np.diff(np.append(starts, len(group)))
        size = np.repeat(sizes, sizes)
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Small buckets all at once, neighbour by neighbour; large ones as a matrix each.
        for step in range(1, min(int(sizes.max()), SMALL)):
            x = np.nonzero((group[step:] == group[:-step]) & (size[step:] <= SMALL))[0]
            for k in range(0, len(x), 1 << 14):
                p = x[k : k + (1 << 14)]
                p = p[of_pairs(p, p + step) >= cosine]
                firsts.append(p)
                seconds.append(p + step)
        for k in np.nonzero(sizes > SMALL)[0].tolist():
            x, y = np.nonzero(np.triu(of_block(slice(starts[k], starts[k] + sizes[k])) >= cosine, 1))
            firsts.append(x + starts[k])
            seconds.append(y + starts[k])
        x, y = np.concatenate(firsts), np.concatenate(seconds)
        # Two blocks of one bucket: only pairs across them.
        apart = (i[x] == j[x]) | (own[x] != own[y])
        return x[apart], y[apart]

    def judge(batches):
        width = parts * turns.d
        for rows, group in whole_groups(batches, 4):
            figures = np.stack([rows.column(c).to_numpy() for c in ("factor", "step", "slack")], axis=1)
            bound = Estimates(_rows_of(rows.column("code"), width // 8), _rows_of(rows.column("level"), width, np.int8), figures, deviations)
            some = np.unique(np.concatenate(pairs(rows, group, bound.of_pairs, bound.of_block)))
            if len(some):
                yield from rows.select([*place, "own", "node"]).take(some).to_batches()

    front = F.substring("signs", 1, parts * turns.d // 8).alias("code")
    judged = together(dealt.join(coded, "node").select(*place, "own", "node", front, "level", "factor", "step", "slack"))
    close = stored(judged.mapInArrow(judge, "table int, key long, i int, j int, own int, node long"), "close")
    members = close.join(coded.select("node", "signs"), "node").join(classes.select("node", "weight", "v"), "node")
    members = together(members.select(*place, "own", "node", "weight", "v", "signs"))

    def compare(batches):
        import pyarrow as pa

        for rows, group in whole_groups(batches, 4):
            table, node, weight = (rows.column(c).to_numpy() for c in ("table", "node", "weight"))
            v = np.concatenate([c.flatten().to_numpy() for c in rows.column("v").chunks]).reshape(-1, dimension)
            n = len(node)
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)

            def exact(p, q):
                return np.einsum("ij,ij->i", unit[p], unit[q])

            # The matrix may sum in another order: it only picks, the last word is of one formula.
            x, y = pairs(rows, group, exact, lambda at: unit[at] @ unit[at].T + 1e-9)
            keep = [np.zeros(0, np.int64)]
            for k in range(0, len(x), 1 << 14):
                keep.append(k + np.nonzero(exact(x[k : k + (1 << 14)], y[k : k + (1 << 14)]) >= cosine)[0])
            keep = np.concatenate(keep)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            # A pair counts in the first table in which both keys agree; keys are exact, so every task finds the same.
            some = np.unique(np.concatenate([x, y]))
            keys = turns.keys(signs_of(rows.select(["signs"]).take(some)))
            px, py = np.searchsorted(some, x), np.searchsorted(some, y)
            new = np.concatenate(
                [(keys[px[k : k + (1 << 14)]] == keys[py[k : k + (1 << 14)]]).argmax(1) == table[x[k : k + (1 << 14)]] for k in range(0, len(x), 1 << 14)]
            )
            x, y = x[new], y[new]
            if not len(x):
                continue
            links = np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
            # Links to the first member that can be reached are enough for the components.
            root = np.arange(n)
            while True:
                low, last = np.minimum(root[x], root[y]), root.copy()
                for end in (x, y, last[x], last[y]):
                    np.minimum.at(root, end, low)
                root = root[root]
                if (root == last).all():
                    break
            tied = np.nonzero(root != np.arange(n))[0]
            joins = list(zip(node[tied].tolist(), node[root[tied]].tolist()))
            at = np.nonzero(links)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[at], [p for p, _ in joins]]), pa.int64()), pa.array(np.concatenate([np.full(len(at), -1), [q for _, q in joins]]).astype(np.int64), mask=np.arange(len(at) + len(joins)) < len(at)),
                 pa.array(np.concatenate([links[at], np.zeros(len(joins))]).astype(np.int64))],
                ["a", "b", "links"],
            )

    found = stored(members.mapInArrow(compare, "a long, b long, links long"), "near")
    return found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), found.where("b IS NOT NULL").select("a", "b")
