"""Near duplicates by banded MinHash with sequential Bayesian verification.

The threshold and the chance ``apart`` that a pair right at it shares no band give bands and rows: for
0.85 and 3e-6 signatures of 320 minima make 40 bands of 8, for 0.80 256 minima make 42 bands of 6
(the last 4 minima are only compared). Documents with equal sets are one node from the start. Candidates
are compared signature batch by signature batch: with a uniform prior, m equal minima out of k
leave a beta posterior for the similarity, and a pair goes once the chance that it reaches the
threshold is below ``miss``. What is left is verified on the full sets.

Buckets are never turned into pairs of rows. First every node meets one hub, the most central node it shares
a bucket with. Only buckets that still hold more than one component afterwards are compared
further, inside tasks: a bucket is cut into blocks, members of different components are
compared in numpy, and only links that join components come out. Work is thus bounded
by the buckets that are not settled by the hubs, and no link between components is given up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import runs, slices, some_rows, stored, text_or_empty, trimmed
from tallywatch.llm.graph import components

#: Minima that bands may use, and minima compared at once.
HASHES, BATCH = 320, 32
#: A block of a bucket holds about so many members, or so many shingles.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20

SEED = 20240229
WORD_FACTOR = np.random.default_rng(SEED + 1).integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FEATURES = "doc_id long, n_shingles long, digest binary, keys array<long>"
SETS = "doc_id long, digest binary, n long, signature binary, shingles binary"


@dataclass(frozen=True)
class Layout:
    """How minima make bands; ``minima`` is a multiple of BATCH."""

    bands: int
    rows: int

    @property
    def minima(self) -> int:
        return -(-self.bands * self.rows // BATCH) * BATCH

    def functions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Factors and offsets of the minima, and factors of the bands."""
        rng = np.random.default_rng(SEED)
        factors = rng.integers(0, 1 << 32, self.minima, np.uint32) | np.uint32(1)
        offsets = rng.integers(0, 1 << 32, self.minima, np.uint32)
        return factors, offsets, rng.integers(0, 1 << 63, (self.bands, self.rows), np.uint64) * np.uint64(2) + np.uint64(1)


def layout(percent: int, apart: float) -> Layout:
    """The most rows whose bands fit into HASHES minima; a pair at the threshold shares no band with a chance of ``apart`` at most.

    Where even bands of one row don't fit (below 0.04), there are more minima.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"a threshold of {percent} percent")
    found = None
    for rows in range(1, HASHES + 1):
        same = (percent / 100) ** rows
        bands = 1 if same == 1 else math.ceil(math.log(apart) / math.log1p(-same))
        if found and bands * rows > HASHES:
            break
        found = Layout(bands, rows)
    return found


def least_matches(percent: int, miss: float, minima: int = HASHES) -> list[int]:
    """For 32, 64, ... minima the fewest equal ones at which a pair may still reach the threshold.

    P(similarity >= t) after m of k matches is P(Binomial(k + 1, t) <= m).
    """
    t, out = percent / 100, []
    for k in range(BATCH, minima + 1, BATCH):
        total = 0.0
        for m in range(k + 1):
            total += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


class Shingler:
    """Hashed shingle sets of texts: words are split at ASCII white space, A-Z in lower case, ``size`` words a shingle."""

    def __init__(self, size: int = 5, limit: int = 200_000):
        self.size, self.limit = size, limit
        self.words: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """A sorted array of distinct 64-bit hashes per text; with fewer words than a shingle has, one hash of all of them."""
        import xxhash

        if len(self.words) > self.limit:
            self.words = {}
        split = [t.encode().lower().split() for t in texts]
        known = self.words
        for words in split:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
        out = []
        base = WORD_FACTOR
        for words in split:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            if not len(h):
                out.append(h)
                continue
            n = len(h) - self.size + 1
            if n < 1:
                total = np.array([len(h)], np.uint64)
                for x in h:
                    total = total * base + x
            else:
                total = h[:n]
                for i in range(1, self.size):
                    total = total * base + h[i : n + i]
            total = (total ^ (total >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
            out.append(np.unique(total ^ (total >> np.uint64(29))))
        return out


class Signer:
    """Minima and band keys of sets under fixed linear hash functions."""

    def __init__(self, shape: Layout):
        self.shape = shape
        self.factors, self.offsets, self.band_factors = shape.functions()

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.shape.minima, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[i : i + 1024, None] * self.factors + self.offsets).min(0), out=low)
        return low

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        bands, rows = self.shape.bands, self.shape.rows
        parts = (minima[: bands * rows].reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * self.band_factors
        keys = parts.sum(1, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(32))) * self.band_factors[:, 0]
        return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def _features(docs: DataFrame, words: int, shape: Layout) -> DataFrame:
    def work(batches):
        import pyarrow as pa
        import xxhash

        shingle, signer = Shingler(words), Signer(shape)
        for batch in some_rows(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 20):
                sets = shingle(texts[a:b])
                keys = np.array([signer.band_keys(signer.signature(s)) if len(s) else np.zeros(shape.bands, np.int64) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(np.arange(0, keys.size + 1, shape.bands, dtype=np.int32), pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "digest", "keys"],
                )
            trimmed()

    return docs.mapInArrow(work, FEATURES)


def _sets(docs: DataFrame, words: int, shape: Layout) -> DataFrame:
    def work(batches):
        import pyarrow as pa
        import xxhash

        shingle, signer = Shingler(words), Signer(shape)
        for batch in some_rows(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 20):
                sets = shingle(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([signer.signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "digest", "n", "signature", "shingles"],
                )
            trimmed()

    return docs.mapInArrow(work, SETS)


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes have 100 * intersection >= percent * union."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def surviving(minima: np.ndarray, a: np.ndarray, b: np.ndarray, matches: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of pairs (a, b) that stay possible through all batches after the first; ``matches`` counts the first's."""
    left = np.nonzero(matches >= least[0])[0]
    count = matches[left]
    for k, need in enumerate(least[1:], 1):
        at = slice(k * BATCH, (k + 1) * BATCH)
        count = count + (minima[a[left], at] == minima[b[left], at]).sum(1)
        stay = count >= need
        left, count = left[stay], count[stay]
    return left


def _verify_pairs(pairs: DataFrame, percent: int, miss: float, shape: Layout) -> DataFrame:
    """Rows (a, b, sa, sb, ha, hb) with both signatures and sets become links (a, b)."""
    least = least_matches(percent, miss, shape.minima)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            minima = np.array([np.frombuffer(x, np.uint32) for c in (2, 3) for x in batch.column(c).to_pylist()]).reshape(-1, shape.minima)
            n = len(one)
            a, b = np.arange(n), np.arange(n) + n
            keep = surviving(minima, a, b, (minima[:n, :BATCH] == minima[n:, :BATCH]).sum(1), least)
            left, right = batch.column(4), batch.column(5)
            keep = [i for i in keep.tolist() if linked(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array(one[keep], pa.int64()), pa.array(two[keep], pa.int64())], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb", "ha", "hb").mapInArrow(work, "a long, b long")


def _verify_blocks(members: DataFrame, percent: int, miss: float, shape: Layout) -> DataFrame:
    """Links between components within blocks of buckets.

    Rows: key, i, j (a pair of blocks of bucket ``key``, i <= j), own (the member's block), node, component, n, signature, shingles.
    """
    least = least_matches(percent, miss, shape.minima)

    def work(batches):
        import pyarrow as pa

        for group in runs(batches, 3):
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            own, node, sizes = (group.column(c).to_numpy() for c in ("own", "node", "n"))
            label = group.column("component").to_pylist()
            minima = np.array([np.frombuffer(x, np.uint32) for x in group.column("signature").to_pylist()])
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            names = {c: k for k, c in enumerate(dict.fromkeys(label))}
            comp = np.array([names[c] for c in label])
            root = list(range(len(names)))

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            out = []
            for at in range(0, len(node) - 1, 64):
                rows = np.arange(at, min(at + 64, len(node)))
                cols = np.arange(at + 1, len(node))
                able = (cols > rows[:, None]) & (comp[cols] != comp[rows][:, None])
                small, large = np.minimum(sizes[cols], sizes[rows][:, None]), np.maximum(sizes[cols], sizes[rows][:, None])
                able &= 100 * small >= percent * large
                if i != j:
                    able &= own[cols] != own[rows][:, None]
                x, y = np.nonzero(able)
                a, b = rows[x], cols[y]
                for k in range(0, len(a), 1 << 16):
                    u, v = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                    left = surviving(minima, u, v, (minima[u, :BATCH] == minima[v, :BATCH]).sum(1), least)
                    for p, q in zip(u[left].tolist(), v[left].tolist()):
                        r, s = find(comp[p]), find(comp[q])
                        if r != s and linked(sets[p], sets[q], percent):
                            root[r] = s
                            out.append((node[p], node[q]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])

    return members.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, miss: float = 1e-6, apart: float = 3e-6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links join documents with 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles;
    component_id is the smallest doc_id that can be reached. A text with fewer words is one shingle; a null
    text, or one without words, has none, links with nothing and is its own component. A null doc_id links with nothing either,
    has a null component and is kept. Rows repeated with one doc_id each have the component of their own text. Other columns are left out.
    A pair right at the threshold shares no band with a chance of ``apart`` at most; ``miss`` is the one at which the comparison gives a pair up.
    """
    shape = layout(percent, apart)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seen = stored(_features(rows, words, shape), "features")
    able = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("digest").agg(F.min("doc_id").alias("node"))
    firsts = able.join(classes, (able.digest == classes.digest) & (able.doc_id == classes.node), "left_semi")
    banded = firsts.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key")).distinct()
    banded = stored(banded, "bands")

    full = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(banded.join(full, "key"), "buckets")
    central = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    weighted = shared.select("key", "node").join(central, "node")
    hub = F.max(F.struct("weight", (-F.col("node")).alias("neg"))).alias("hub")
    hubs = weighted.groupBy("key").agg(hub)
    best = weighted.join(hubs, "key").groupBy("node").agg(F.max("hub").alias("hub"))
    pairs = best.select(F.col("node").alias("a"), (-F.col("hub.neg")).alias("b")).where("a != b")

    # The signatures and sets of nodes that share a bucket, from their texts.
    nodes = central.select(F.col("node").alias("doc_id"))
    sets = _sets(rows.join(nodes, "doc_id", "left_semi"), words, shape)
    sets = sets.join(classes, (sets.digest == classes.digest) & (sets.doc_id == classes.node), "left_semi").dropDuplicates(["doc_id", "digest"])
    sets = stored(sets.withColumnRenamed("doc_id", "node").drop("digest"), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"), F.col("shingles").alias("ha"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"), F.col("shingles").alias("hb"))
    both = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    found = components(_verify_pairs(both, percent, miss, shape))

    rest = _unsettled(shared, found, sets)
    more = stored(_verify_blocks(rest, percent, miss, shape), "more")
    label = F.coalesce("component", "node")
    if not more.isEmpty():
        a = more.join(found, more.a == found.node, "left").select(F.coalesce("component", "a").alias("a"), "b")
        ends = a.join(found, a.b == found.node, "left").select("a", F.coalesce("component", "b").alias("b"))
        merged = components(ends).select(F.col("node").alias("label"), F.col("component").alias("merged"))
        known = found.unionByName(ends.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("component"))).distinct()
        found = known.join(merged, known.component == merged.label, "left").select("node", F.coalesce("merged", "component").alias("component"))
        found = stored(found.groupBy("node").agg(F.min("component").alias("component")), "components")

    named = classes.join(found, "node", "left").select("digest", label.alias("component_id"))
    out = able.select("doc_id", "n_shingles", "digest").join(named, "digest").drop("digest")
    alone = seen.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _unsettled(shared: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, each dealt to the pairs of blocks it takes part in.

    Buckets with the same members say the same; one of them is enough.
    """
    labelled = stored(
        shared.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "labelled"
    )
    sizes = sets.groupBy("node").agg(F.max("n").alias("n"))
    state = labelled.join(sizes, "node").groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("low < high")
    chosen = state.groupBy("x", "y", "members", "shingles").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = labelled.join(chosen.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node", "key"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = dealt.withColumn("meets", F.explode(meets)).select("key", "meets.i", "meets.j", "own", "node", "component")
    full = dealt.join(sets, "node").select("key", "i", "j", "own", "node", "component", "n", "signature", "shingles")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
