"""Documents packed into training windows of near-equal fill by multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import slices, some_rows, text_or_empty, trimmed
from tallywatch.llm.words import library_encoder

#: Groups of more pieces than this have their small ones joined before they are differenced.
BUNDLE_FROM = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp differencing into ``windows`` sets of near-equal sums; items are given by place.

    Every item begins as a partition with one filled set. The two partitions with the widest spread
    are merged, the fullest set of one with the emptiest of the other and so on, until one is left.
    """
    sums = np.zeros(windows, np.int64)
    roots = np.full(windows, -1, np.int64)
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        s, r = sums.copy(), roots.copy()
        s[0], r[0] = size, i
        heap.append((-int(size), i, s, r))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, s, r = heapq.heappop(heap)
        _, _, t, q = heapq.heappop(heap)
        s, q, t = s + t[::-1], q[::-1], r
        node = np.where(t < 0, q, t)
        both = np.nonzero((t >= 0) & (q >= 0))[0]
        node[both] = len(left) + np.arange(len(both))
        left += t[both].tolist()
        right += q[both].tolist()
        order = np.argsort(-s, kind="stable")
        s, node = s[order], node[order]
        heapq.heappush(heap, (int(s[-1] - s[0]), serial, s, node))
        serial += 1
    out: list[list[int]] = [[] for _ in range(windows)]
    for w, root in enumerate(heap[0][3].tolist() if heap else ()):
        stack = [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if node < len(sizes):
                out[w].append(node)
            else:
                stack += [right[node], left[node]]
    return out


def bundles(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Places of items, those of up to ``most`` joined in order while they hold no more than that together."""
    out: list[list[int]] = []
    held, total = [], 0
    for i, size in enumerate(sizes.tolist()):
        if size > most:
            out.append([i])
            continue
        if held and total + size > most:
            out.append(held)
            held, total = [], 0
        held.append(i)
        total += size
    return out + [held] if held else out


def windows_for(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sets of items within ``capacity``: as few windows as could hold them, and more while one overflows.

    Differencing keeps numbers of every window for every item, so many small items go in as bundles.
    """
    joined = bundles(sizes, capacity // 16) if len(sizes) > BUNDLE_FROM else [[i] for i in range(len(sizes))]
    whole = np.array([sizes[b].sum() for b in joined], np.int64)
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sets = difference(whole, count)
        if all(int(whole[s].sum()) <= capacity for s in sets):
            return [sorted(i for b in s for i in joined[b]) for s in sets if s]
        count += max(1, count // 128)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_tokens: int = 1 << 20, with_ids: bool = True, group_pieces: int = 1 << 17) -> DataFrame:
    """One row per piece of a document: where it begins in it, its ids, and its place in a window.

    Documents longer than a window fill whole windows first. What is left of them and all shorter
    documents are gathered per input partition until ``group_tokens`` ids or ``group_pieces`` pieces are there and packed by
    differencing, so a task holds one group at a time; only a partition's last group may be smaller.
    Nothing is shuffled. A null text is an empty one (its end id alone); equal or null doc_ids are
    documents like others.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = file.read()

    def pack(batches):
        import pyarrow as pa

        encode = library_encoder(vocabulary, end_id, 450_000, specials=True)
        sequence = TaskContext.get().partitionId() << 40
        rest, held = [], 0

        def flush(full, pieces):
            nonlocal sequence
            rows = []
            for piece in full:
                rows.append((*piece, sequence, 0))
                sequence += 1
            for window in windows_for(np.array([len(p[2]) for p in pieces], np.int64), capacity) if pieces else ():
                at = 0
                for i in window:
                    rows.append((*pieces[i], sequence, at))
                    at += len(pieces[i][2])
                sequence += 1
            key, start, ids, total, number, offset = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array([len(p) for p in ids], pa.int64()),
                 pa.array([zlib.crc32(p) for p in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(number, pa.int64()),
                 pa.array(offset, pa.int64()), pa.array([p.tobytes() if with_ids else None for p in ids], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in some_rows(batches, 4096):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 22):
                tokens, counts = encode(texts[a:b])
                tokens = tokens.astype("<u4")
                full, end = [], 0
                for key, count in zip(keys[a:b], counts.tolist()):
                    begin, end = end, end + count
                    whole = count // capacity * capacity
                    full += [(key, at, tokens[begin + at : begin + at + capacity], count) for at in range(0, whole, capacity)]
                    if count > whole:
                        rest.append((key, whole, tokens[begin + whole : end], count))
                        held += count - whole
                # A group is packed once as much again is there, so that the last one is not a small remainder.
                due = []
                if held >= 2 * group_tokens or len(rest) >= 2 * group_pieces:
                    size, cut = 0, 0
                    while size < group_tokens and cut < group_pieces:
                        size += len(rest[cut][2])
                        cut += 1
                    due, rest, held = rest[:cut], rest[cut:], held - size
                if full or due:
                    yield flush(full, due)
                # What a slice has freed would else stay with the worker, beside that of other stages.
                tokens = full = due = None
                trimmed()
        if rest:
            yield flush([], rest)
            rest = []
        trimmed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    packed = rows.mapInArrow(pack, PIECES)
    return packed if with_ids else packed.drop("ids")
