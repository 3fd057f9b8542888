"""Token ids of documents kept as one wavelet matrix per shard.

A wavelet matrix stores a sequence of n ids of b bits as b planes of n bits. Plane k holds bit
b - 1 - k of every id, in the order left by a stable sort on the higher bits' planes: zeros first.
With a count of ones before each block of 512 bits, a plane answers rank and select, and b steps
over the planes give the id at a place, how often an id occurs in a range, and where. The blob is
all there is: nothing beside it has to be read, and it takes b bits and a sixteenth an id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.llm.common import slices, some_rows, stored, text_or_empty
from tallywatch.llm.words import library_encoder

MAGIC = b"TWM1"
BLOCK = 512

SHARDS = "part int, before long, n_docs long, n_tokens long, shard binary"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """A sequence of non-negative ids below 2 ** 32 with access, rank, select, count and occurrences."""

    def __init__(self, n: int, zeros: np.ndarray, planes: np.ndarray, ones: np.ndarray):
        self.n, self.zeros, self.planes, self.ones = n, zeros, planes, ones
        self.bits = len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        blocks = n // BLOCK + 1
        planes = np.zeros((bits, blocks * BLOCK // 8), np.uint8)
        ones = np.zeros((bits, blocks), np.uint32)
        zeros = np.zeros(bits, np.int64)
        for k in range(bits):
            bit = (rest >> (bits - 1 - k)) & 1 == 1
            packed = np.packbits(bit)
            planes[k, : len(packed)] = packed
            each = np.bitwise_count(planes[k].reshape(blocks, -1)).sum(1, dtype=np.int64)
            ones[k] = np.cumsum(each) - each
            # By places, which unlike masks cost the same whatever the bits.
            low = rest.take(np.flatnonzero(~bit))
            zeros[k] = len(low)
            rest = np.concatenate([low, rest.take(np.flatnonzero(bit))])
        return cls(n, zeros, planes, ones)

    def tobytes(self) -> bytes:
        head = struct.pack("<4sQI", MAGIC, self.n, self.bits)
        return head + self.zeros.astype("<i8").tobytes() + self.ones.astype("<u4").tobytes() + self.planes.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, bits = struct.unpack_from("<4sQI", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        blocks, at = n // BLOCK + 1, struct.calcsize("<4sQI")
        zeros = np.frombuffer(data, "<i8", bits, at)
        at += 8 * bits
        ones = np.frombuffer(data, "<u4", bits * blocks, at).reshape(bits, blocks)
        at += 4 * bits * blocks
        planes = np.frombuffer(data, np.uint8, bits * blocks * BLOCK // 8, at).reshape(bits, -1)
        return cls(n, zeros, planes, ones)

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane ``k`` before each place."""
        block = at // BLOCK
        row = self.planes[k].reshape(-1, BLOCK // 8)[block]
        inside = at % BLOCK
        whole = np.arange(BLOCK // 8) < (inside // 8)[:, None]
        count = (np.bitwise_count(row) * whole).sum(1, dtype=np.int64)
        part = np.take_along_axis(row, np.minimum(inside // 8, BLOCK // 8 - 1)[:, None], 1)[:, 0]
        count += np.bitwise_count(part & (0xFF00 >> (inside % 8)).astype(np.uint8))
        return self.ones[k][block] + count

    def access(self, at) -> np.ndarray:
        """The ids at some places."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            bit = (self.planes[k][at // 8] >> (7 - at % 8)) & 1
            before = self._rank1(k, at)
            at = np.where(bit == 1, self.zeros[k] + before, at - before)
            out = out * 2 + bit
        return out

    def _descend(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        both = np.array([begin, end], np.int64)
        for k in range(self.bits):
            before = self._rank1(k, both)
            both = self.zeros[k] + before if token >> (self.bits - 1 - k) & 1 else both - before
        return int(both[0]), int(both[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often ``token`` occurs from ``begin`` to before ``end``."""
        low, high = self._descend(token, begin, self.n if end is None else end)
        return high - low

    def rank(self, token: int, at: int) -> int:
        return self.count(token, 0, at)

    def _select_bit(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth ones (or zeros) of plane ``k``."""
        before = self.ones[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, nth, "right") - 1
        row = np.unpackbits(self.planes[k].reshape(-1, BLOCK // 8)[block], axis=1) == bit
        inside = np.argmax(np.cumsum(row, axis=1) > (nth - before[block])[:, None], axis=1)
        return block * BLOCK + inside

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending: up through the planes from the range it ends in."""
        low, high = self._descend(token, 0, self.n)
        at = np.arange(low, high)
        for k in reversed(range(self.bits)) if high > low else ():
            bit = token >> (self.bits - 1 - k) & 1
            at = self._select_bit(k, bit, at - self.zeros[k] if bit else at)
        return at

    def select(self, token: int, nth: int) -> int:
        """The place of the nth occurrence, from 0."""
        low, high = self._descend(token, 0, self.n)
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        at = np.array([low + nth])
        for k in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - k) & 1
            at = self._select_bit(k, bit, at - self.zeros[k] if bit else at)
        return int(at[0])

    def decode(self) -> np.ndarray:
        """The whole sequence, by undoing the stable sorts from the last plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~bit)] = out[: self.zeros[k]]
            above[np.flatnonzero(bit)] = out[self.zeros[k] :] | out.dtype.type(1 << (self.bits - 1 - k))
            out = above
        return out


def pack_shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents and their ids in one blob: count, doc ids with a null mask, lengths, wavelet matrix."""
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return struct.pack("<I", len(doc_ids)) + nulls.tobytes() + keys.tobytes() + counts.astype("<i8").tobytes() + WaveletMatrix.build(ids).tobytes()


def open_shard(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    (n,) = struct.unpack_from("<I", data)
    nulls = np.frombuffer(data, np.uint8, n, 4)
    keys = np.frombuffer(data, "<i8", n, 4 + n)
    counts = np.frombuffer(data, "<i8", n, 4 + 9 * n)
    return [None if z else int(k) for z, k in zip(nulls, keys)], counts, WaveletMatrix.frombytes(data[4 + 17 * n :])


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode documents and write shards in ascending doc_id order; returns the table of shards, read from its files.

    ``part`` and ``before`` (ids of the same part before the shard) order the shards. A null text
    is empty; rows with equal or null doc_id all stay, nulls first. A shard closes at
    ``shard_tokens`` ids, so memory does not depend on the number of documents.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = file.read()

    def build(batches):
        import pyarrow as pa

        encode = library_encoder(vocabulary, end_id, specials=True)
        part, before = TaskContext.get().partitionId(), 0
        keys, sizes, parts, held = [], [], [], 0

        def shard():
            return pa.RecordBatch.from_pylist(
                [{"part": part, "before": before, "n_docs": len(keys), "n_tokens": held,
                  "shard": pack_shard(keys, np.concatenate(sizes), np.concatenate(parts))}],
                pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.binary())]),
            )

        for batch in some_rows(batches, 4096):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 22):
                tokens, counts = encode(texts[a:b])
                keys += ids[a:b]
                sizes.append(counts)
                parts.append(tokens)
                held += len(tokens)
                if held >= shard_tokens:
                    yield shard()
                    before += held
                    keys, sizes, parts, held = [], [], [], 0
        if keys:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(rows.mapInArrow(build, SHARDS), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """One row per document from the shards alone: its place in the whole sequence, length and checksum.

    ``start`` needs the ids of all earlier parts: one total per part, summed up in order.
    """
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("base"))

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for base, before, data in zip(*[batch.column(c).to_pylist() for c in ("base", "before", "shard")]):
                keys, counts, matrix = open_shard(data)
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts + (base + before)), pa.array(counts),
                     pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # One row per part of the writing job: a table of that size can go to every executor.
    return shards.join(F.broadcast(bases), "part").select("base", "before", "shard").mapInArrow(decode, TOKENS)
