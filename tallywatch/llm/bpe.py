"""Byte-level BPE by ranks in two tiers: a minimal perfect hash for whole pre-tokens, a heap for the others."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import kept, slices, some_rows, text_or_empty
from tallywatch.llm.words import PieceEncoder

CODES = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PerfectHash:
    """Minimal perfect hash of byte strings in levels.

    Keys that meet no other on a level's bit array own their bit; the others go on to the next
    level. The number of owned bits before a key's bit is its place, without gaps.
    """

    def __init__(self, keys: list[bytes], room: float = 2.0):
        hashes = self.hashes(keys)
        self.levels: list[tuple[int, np.ndarray]] = []
        self.places = np.full(len(keys), -1, np.int64)
        left, given = np.arange(len(keys)), 0
        while len(left):
            size = max(8, int(room * len(left)))
            spot = self._spot(hashes[left], len(self.levels), size)
            owned = np.bincount(spot, minlength=size) == 1
            number = np.where(owned, given + np.cumsum(owned) - 1, -1)
            self.levels.append((size, number))
            self.places[left] = number[spot]
            given += int(owned.sum())
            left = left[number[spot] < 0]
            if len(self.levels) > 200:
                raise ValueError("equal keys")

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _spot(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed >> np.uint64(8)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """A place for every string; strings that are no keys get some place or -1."""
        hashes = self.hashes(keys)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, number) in enumerate(self.levels):
            if not len(left):
                break
            found = number[self._spot(hashes[left], level, size)]
            out[left] = found
            left = left[found < 0]
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals.

    The parts are a linked list over the bytes; the heap holds (rank, start, end) of neighbouring
    pairs, and an entry whose two parts are no longer there is passed over.
    """
    n = len(piece)
    after = list(range(1, n + 1)) + [n]
    before = list(range(-1, n))
    alive = bytearray(b"\1") * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, start, end = heapq.heappop(heap)
        if not alive[start]:
            continue
        middle = after[start]
        if middle >= n or after[middle] != end:
            continue
        alive[middle] = 0
        after[start] = end
        if end < n:
            before[end] = start
            last = after[end]
            rank = ranks.get(piece[start:last])
            if rank is not None:
                heapq.heappush(heap, (rank, start, last))
        first = before[start]
        if first >= 0:
            rank = ranks.get(piece[first:end])
            if rank is not None:
                heapq.heappush(heap, (rank, first, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class ByteBpe:
    """Encoder and decoder for a table of ranks and a pattern of pre-tokens."""

    def __init__(self, rank_lines: bytes, pattern: str):
        import regex

        pairs = [line.split() for line in rank_lines.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = list(self.ranks)
        self.table = PerfectHash(self.tokens)
        self.ids = np.zeros(len(self.tokens), np.int64)
        self.ids[self.table.places] = np.fromiter(self.ranks.values(), np.int64, len(self.tokens))
        self.by_place: list[bytes] = [b""] * len(self.tokens)
        for place, token in zip(self.table.places.tolist(), self.tokens):
            self.by_place[place] = token
        self.by_id = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pieces = PieceEncoder(self.encode_pieces)

    def encode_pieces(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has: the matches of the pattern are looked up whole, else merged."""
        found = [self.pattern.findall(lead + p) for p in pieces]
        distinct = {m: None for matches in found for m in matches}
        raw = [m.encode() for m in distinct]
        places = self.table(raw).tolist()
        names, ids, ranks = self.by_place, self.ids.tolist(), self.ranks
        known = {
            m: [ids[p]] if p >= 0 and names[p] == b else merge(b, ranks) for m, b, p in zip(distinct, raw, places)
        }
        sizes = np.fromiter((sum(len(known[m]) for m in matches) for matches in found), np.int64, len(found))
        return np.fromiter((i for matches in found for m in matches for i in known[m]), np.uint32), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


def _rows(docs: DataFrame, ranks_path: str, pattern: str, digest: bool) -> DataFrame:
    with open(ranks_path, "rb") as file:
        rank_lines = file.read()

    def code(batches):
        import pyarrow as pa

        coder = kept(("ranks", rank_lines, pattern), lambda: ByteBpe(rank_lines, pattern))
        for batch in some_rows(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 20):
                ids, counts = coder.encode(texts[a:b])
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                each = [ids[i:j] for i, j in zip(ends - counts, ends)]
                back = [coder.decode(i) for i in each]
                if digest:
                    kind = pa.string()
                    one = [hashlib.sha256(i).hexdigest() for i in each]
                    two = [hashlib.sha256(t).hexdigest() for t in back]
                else:
                    kind, one, two = pa.binary(), [i.tobytes() for i in each], back
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b], pa.int64()), pa.array(counts), pa.array(one, kind), pa.array(two, kind)],
                    (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]),
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(code, DIGESTS if digest else CODES)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document its ids (little-endian unsigned 32-bit integers) and the bytes they decode to.

    A null text is an empty one: no ids, no bytes. Rows with equal or null doc_id each keep a row;
    other columns are left out. Nothing is shuffled; a task keeps a bounded table of pieces it has seen.
    """
    return _rows(docs, ranks_path, pattern, False)


def document_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As ``encode_documents``, with SHA-256 digests in place of ids and bytes, taken where they are made."""
    return _rows(docs, ranks_path, pattern, True)
