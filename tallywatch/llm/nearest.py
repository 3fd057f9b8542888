"""Nearest vectors by learned partitions: a router learns which parts of a balanced neighbour graph a query needs.

On a bounded sample the graph of nearest neighbours is cut into parts of near-equal size with few links between them. A small network
learns to tell from a vector how its neighbours are spread over the parts. Every row is filed under its
most probable part; a query goes to its most probable parts until they hold a share of probability that held-out queries of the
sample needed to reach the wanted recall, and the rows found there are ranked by their exact inner products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import stored, whole_groups
from tallywatch.operators.summaries import top_rows

#: Vectors, and queries, of a block: what a task compares at a time.
BLOCK = 4096
#: Distinct vectors the router is fitted on at most, and how many of them make a part at least.
SAMPLE, PART = 1 << 14, 64
#: Distinct vectors of the table to a part, while the sample allows as many parts.
ROWS = 512
FOUND = "h1 long, h2 long, hits array<struct<far: double, vec_id: long, own: boolean>>"


def neighbours(vectors: np.ndarray, others: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Places in ``others`` of the ``k`` largest inner products of every vector; with ``same`` a vector isn't its own neighbour."""
    k = min(k, len(others) - same)
    out = np.empty((len(vectors), k), np.int64)
    for a in range(0, len(vectors), 512):
        near = vectors[a : a + 512] @ others.T
        if same:
            near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k] if 0 < k < near.shape[1] else np.argsort(-near, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 0.05, seed: int = 11) -> np.ndarray:
    """The part of every node of a neighbour graph: few links between parts, none of them larger than its share by more than ``slack``.

    Halves are cut again and again at the median of the slowest mode of a walk on the graph; then nodes
    move to the part of most of their neighbours, largest gains first, where there is room.
    """
    n, k = graph.shape
    rng = np.random.default_rng(seed)
    u, v = np.repeat(np.arange(n), k), graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    label, first, many = np.zeros(n, np.int64), np.zeros(1, np.int64), np.array([parts])
    while many.max() > 1:
        inner = label[u] == label[v]
        a, b = u[inner], v[inner]
        degree = np.bincount(a, minlength=n) + 1.0
        mass = np.bincount(label, degree, len(many))
        x = rng.standard_normal(n)
        for _ in range(40):
            x = 0.5 * x + 0.5 * (np.bincount(a, x[b], n) + x) / degree
            x -= (np.bincount(label, x * degree, len(many)) / np.maximum(mass, 1))[label]
            x /= np.sqrt(np.bincount(label, x * x, len(many)) + 1e-300)[label]
        order = np.lexsort((x, label))
        sizes = np.bincount(label, minlength=len(many))
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        low = many // 2
        high = np.zeros(n, bool)
        high[order] = place >= np.repeat(sizes * low // many, sizes)
        # A part of one stays whole: its first half is empty.
        numbers = np.stack([low, many - low], 1)
        slots = np.cumsum(numbers.ravel() > 0) - 1
        label = slots.reshape(-1, 2)[label, high.astype(int)]
        many = numbers.ravel()[numbers.ravel() > 0]
    room, least = int(np.ceil(n / parts * (1 + slack))), int(n / parts * (1 - slack))
    sizes = np.bincount(label, minlength=parts)
    for _ in range(rounds if parts > 1 else 0):
        held = np.bincount(u * parts + label[v], minlength=n * parts).reshape(n, parts)
        best = held.argmax(1)
        gain = held[np.arange(n), best] - held[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if sizes[best[i]] < room and sizes[label[i]] > least:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A network of one hidden layer from a vector to the probabilities of parts, and the mass of them a query needs."""

    def __init__(self, scale: float, weights: list[np.ndarray], mass: float):
        self.scale, self.weights, self.mass = scale, weights, mass

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        w, b, u, c = self.weights
        z = np.maximum(vectors / self.scale @ w + b, 0) @ u + c
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        return self.scores(vectors).argmax(1)

    def routes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, part): parts by falling probability until they hold the mass a query needs; one at least."""
        p = self.scores(vectors)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
        wanted = before <= self.mass
        wanted[:, 0] = True
        q, at = np.nonzero(wanted)
        return q, order[q, at]


def _train(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int, seed: int) -> list[np.ndarray]:
    """Softmax regression on a rectified hidden layer, fitted by Adam to rows of probabilities."""
    rng = np.random.default_rng(seed)
    d, m = x.shape[1], target.shape[1]
    weights = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, m)) * np.sqrt(1 / hidden), np.zeros(m)]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            w, b, u, c = weights
            h = np.maximum(x[rows] @ w + b, 0)
            z = h @ u + c
            z = np.exp(z - z.max(1, keepdims=True))
            dz = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (dz @ u.T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                mean[i] += 0.1 * (g - mean[i])
                square[i] += 0.001 * (g * g - square[i])
                weights[i] -= 2e-3 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return weights


def fit(sample: np.ndarray, parts: int, k: int = 20, recall: float = 0.96, links: int = 10, hidden: int = 96, epochs: int = 15, seed: int = 11) -> Router:
    """A router fitted on ``sample``, an eighth of which is held out to find the mass that reaches ``recall`` of the ``k`` nearest."""
    scale = float(np.sqrt((sample * sample).sum(1).mean())) or 1.0
    held = np.random.default_rng(seed).permutation(len(sample)) < len(sample) // 8
    known, asked = sample[~held], sample[held]
    parts = max(1, min(parts, len(known) // PART))
    graph = neighbours(known, known, links, True)
    label = balanced_parts(graph, parts, seed=seed)
    target = np.bincount(np.arange(len(known)) * parts + label, minlength=len(known) * parts).reshape(-1, parts).astype(float)
    np.add.at(target, (np.repeat(np.arange(len(known)), graph.shape[1]), label[graph.ravel()]), 1.0)
    weights = _train(known / scale, target / target.sum(1, keepdims=True), hidden, epochs, seed)
    router = Router(scale, weights, 1.0)
    if not len(asked) or parts == 1:
        return router
    best = neighbours(asked, known, k, False)
    p = router.scores(asked)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.empty_like(p)
    sorted_p = np.take_along_axis(p, order, 1)
    np.put_along_axis(before, order, np.cumsum(sorted_p, 1) - sorted_p, 1)
    needed = np.take_along_axis(before, router.parts(known)[best], 1)
    router.mass = float(np.quantile(needed, recall))
    return router


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2) of usable rows: finite, not zero, named. Equal vectors have equal (h1, h2), 128 bits of hashes."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), fine.alias("fine")).where("fine AND vec_id IS NOT NULL")
    v = F.transform("v", lambda c: c + F.lit(0.0))  # one zero
    return rows.select("vec_id", v.alias("v")).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))


def _by_count(counts: list, column: str) -> Column:
    """How many blocks a part has, as a small table in the plan: one entry a part."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for r in counts for x in (r["part"], -(-r[column] // BLOCK))]), F.col("part")), F.lit(0))


def _search(items: DataFrame, queries: DataFrame, dimension: int, count: int, k: int, recall: float, sample: int) -> DataFrame:
    """(h1, h2, hits): the best of the rows filed under the parts that a query is sent to, k + 1 at least if there are as many."""
    import pyarrow as pa

    # Twice the sample by hash, then exactly the first of it: no partition sends more than its share.
    share = min(1.0, 2.0 * sample / max(count, 1))
    spread = F.pmod(F.xxhash64(F.lit("sample"), "h1", "h2"), F.lit(1 << 30))
    chosen = items.where(spread < int(share * (1 << 30))).orderBy(spread, "h1", "h2").limit(sample).select("v").toArrow()
    column = chosen.column("v").combine_chunks()
    router = fit(column.flatten().to_numpy().reshape(-1, dimension), count // ROWS, k, recall)

    def matrix(batch):
        return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy().reshape(-1, dimension)

    def file(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.parts(matrix(batch)).astype(np.int32))], [*batch.schema.names, "part"])

    def send(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                q, part = router.routes(matrix(some))
                rows = some.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(part.astype(np.int32))], [*rows.schema.names, "part"])

    filed = stored(items.select("h1", "h2", "ids", "v").mapInArrow(file, "h1 long, h2 long, ids array<long>, v array<double>, part int"), "filed")
    sent = stored(queries.select("h1", "h2", "v").mapInArrow(send, "h1 long, h2 long, v array<double>, part int"), "sent")
    # Two numbers a part, of at most SAMPLE / PART parts.
    rows = filed.groupBy("part").agg(F.count(F.lit(1)).alias("items")).join(sent.groupBy("part").agg(F.count(F.lit(1)).alias("queries")), "part").collect()
    if not rows:
        return None
    item_blocks, query_blocks = _by_count(rows, "items"), _by_count(rows, "queries")
    own = F.xxhash64("h1", "h2")
    sides = (
        filed.withColumn("i", F.pmod(own, F.greatest(item_blocks, F.lit(1))).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(1), query_blocks))).where("j > 0"),
        sent.withColumn("ids", F.lit(None).cast("array<long>")).withColumn("j", (F.pmod(own, F.greatest(query_blocks, F.lit(1))) + 1).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), item_blocks - 1))).where("i >= 0"),
    )
    met = sides[0].unionByName(sides[1]).select("part", "i", "j", "h1", "h2", "ids", "v").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")

    def rank(batches):
        for table, group in whole_groups(batches, 3):
            h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
            ids = table.column("ids").combine_chunks()
            asks = ids.is_null().to_numpy(zero_copy_only=False)
            v = np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]).reshape(-1, dimension)
            begin = np.nonzero(np.diff(group, prepend=-1))[0].tolist()
            for a, b in zip(begin, [*begin[1:], len(group)]):
                q, x = a + np.nonzero(asks[a:b])[0], a + np.nonzero(~asks[a:b])[0]
                if not len(q) or not len(x):
                    continue
                names = ids.take(pa.array(x))
                many, names = np.diff(names.offsets.to_numpy()), names.flatten().to_numpy()
                from_row = np.cumsum(many) - many
                yield from best(v[q], v[x], h1[q], h2[q], h1[x], h2[x], many, names, from_row)

    def best(asked, known, q1, q2, x1, x2, many, names, from_row):
        size = np.linalg.norm(known, axis=1).max()
        for a in range(0, len(asked), 256):
            some = asked[a : a + 256]
            near = some @ known.T
            kth = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)] if near.shape[1] > k + 1 else np.full(len(some), -np.inf)
            # The product of matrices may round otherwise in another block: near ties are worked out again, one like the other.
            p, x = np.nonzero(near >= (kth - 1e-12 * size * np.linalg.norm(some, axis=1))[:, None])
            exact = np.concatenate([(some[p[c : c + 8192]] * known[x[c : c + 8192]]).sum(1) for c in range(0, len(p), 8192)]) + 0.0
            order = np.lexsort((names[from_row[x]], -exact, p))
            p, x, exact = p[order], x[order], exact[order]
            place = np.arange(len(p)) - np.searchsorted(p, p)
            p, x, exact = p[place <= k], x[place <= k], exact[place <= k]
            # Rows of equal vectors, of which the first k + 1 are known.
            times = many[x]
            row = np.repeat(from_row[x] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            p, x, exact = np.repeat(p, times), np.repeat(x, times), np.repeat(exact, times)
            order = np.lexsort((names[row], -exact, p))
            p, x, exact, row = p[order], x[order], exact[order], row[order]
            inside = np.arange(len(p)) - np.searchsorted(p, p) <= k
            p, x, exact, row = p[inside], x[inside], exact[inside], row[inside]
            own = (q1[a + p] == x1[x]) & (q2[a + p] == x2[x])
            hits = pa.StructArray.from_arrays([pa.array(0.0 - exact), pa.array(names[row]), pa.array(own)], ["far", "vec_id", "own"])
            start = np.searchsorted(p, np.arange(len(some) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(q1[a : a + 256]), pa.array(q2[a : a + 256]), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), hits)], ["h1", "h2", "hits"])

    return met.mapInArrow(rank, FOUND).groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.96, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` the ``k`` rows of ``vectors`` found with the largest inner product.

    Both tables hold vec_id and embedding. A query's own row, of its vec_id and vector, isn't found; other rows of its vec_id are. Rows that are null, zero, not finite or
    without a vec_id take no part, and vectors meet those of their length only. Rows equal in both columns count once. Ties go to the smaller
    vec_id. Equal vectors are searched once: of their rows only the k + 1 smallest vec_ids can be among the nearest. With fewer than k candidates in the
    parts searched, or in all, there are fewer rows. The router sees at most ``sample`` distinct vectors.
    """
    rows, asked = _rows(vectors), _rows(queries)
    ids = top_rows(rows.select("h1", "h2", "vec_id").distinct(), ["h1", "h2"], [F.col("vec_id")], k + 1)
    ids = ids.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    items = stored(rows.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(ids, ["h1", "h2"]), "vectors")
    wanted = asked.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    found = None
    for shape in items.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():  # one dimension, or very few
        some = _search(items.where(F.size("v") == shape.d), wanted.where(F.size("v") == shape.d), shape.d, shape.n, k, recall, sample)
        if some is not None:
            found = some if found is None else found.unionByName(some)
    schema = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    # A row for every query; of a hot vector's queries the larger side is split by adaptive execution.
    own = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(stored(found, "found"), ["h1", "h2"])
    others = F.slice(F.filter("hits", lambda h: ~(h["own"] & (h["vec_id"] == F.col("query_id")))), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("hit.far")).alias("score"))
