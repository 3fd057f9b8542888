"""The prefix trie of rebuilt conversations: how many share their first turns, and what sharing saves.

A turn is known by 16 bytes of a digest of its role and text, so a conversation is a byte string and its
first d turns are the first 16 d bytes. Distinct strings are cut into ranges, each range is
put into adaptive radix trees, and nodes are read off where a byte depth is a multiple of 16. Nodes on the first
and last string of a range may go on in its neighbours; they are merged from two rows a range.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywatch.llm.common import stored, text_or_empty
from tallywatch.operators.summaries import broadcast_if_small

#: Bytes of a turn id.
WIDTH = 16
#: Strings of one tree.
TREE = 1 << 15
#: Nodes that wait for their parent, and characters of one piece of a list of ids.
WAITING, PIECE = 1 << 16, 1 << 20

NODE = "conv_id long, depth long, parent_conv_id long, parent_ref binary, ref binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
STEP = "depth int, n long, low long, kids long, leaves long, saved long, chars long, ends string, ref binary"
GROWN = f"{NODE}, key binary, path array<struct<{STEP.replace(' ', ':').replace(',:', ', ')}>>"
EMPTY = hashlib.sha256(b"").hexdigest()


class Leaf:
    __slots__ = ("key", "value")

    def __init__(self, key: bytes, value):
        self.key, self.value = key, value


class Node:
    """An inner node: the bytes all its keys share below its parent, and children by their next byte.

    Up to 4, then 16 children stand beside a list of their bytes; up to 48 behind a table from byte to place; more
    in a table by byte. A node that is full moves to the next layout.
    """

    __slots__ = ("end", "kids", "marks", "prefix", "room")

    def __init__(self, prefix: bytes):
        self.prefix, self.end = prefix, None
        self.room, self.marks, self.kids = 4, bytearray(), []

    def _at(self, byte: int) -> int:
        if self.room <= 16:
            return self.marks.find(byte)
        return self.marks[byte] - 1 if self.room == 48 else byte

    def get(self, byte: int):
        at = self._at(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid) -> None:
        at = self._at(byte)
        if at >= 0:
            self.kids[at] = kid
            return
        if len(self.kids) == self.room:
            self._grow()
        if self.room == 256:
            self.kids[byte] = kid
            return
        self.kids.append(kid)
        if self.room == 48:
            self.marks[byte] = len(self.kids)
        else:
            self.marks.append(byte)

    def _grow(self) -> None:
        pairs = list(self.items())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.marks = bytearray(256)
            for i, byte in enumerate(b for b, _ in pairs):
                self.marks[byte] = i + 1
            self.kids = [kid for _, kid in pairs]
        elif self.room == 256:
            self.marks, self.kids = None, [None] * 256
            for byte, kid in pairs:
                self.kids[byte] = kid

    def items(self):
        """(byte, child) in order of bytes."""
        if self.room <= 16:
            return sorted(zip(self.marks, self.kids), key=lambda p: p[0])
        if self.room == 48:
            return [(b, self.kids[at - 1]) for b, at in enumerate(self.marks) if at]
        return [(b, kid) for b, kid in enumerate(self.kids) if kid is not None]


def shared(a: bytes, b: bytes, begin: int = 0) -> int:
    """Up to where two byte strings agree, which agree before ``begin``."""
    end = min(len(a), len(b))
    while begin < end:
        size = min(64, end - begin)
        x, y = a[begin : begin + size], b[begin : begin + size]
        if x != y:
            return begin + size - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        begin += size
    return end


class RadixTree:
    """An adaptive radix tree over byte strings, one of which may begin another."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, value) -> None:
        above, edge, node, at = None, 0, self.root, 0
        while True:
            if node is None:
                new = Leaf(key, value)
            elif isinstance(node, Leaf):
                if node.key == key:
                    node.value = value
                    return
                upto = shared(key, node.key, at)
                new = Node(key[at:upto])
                for k, v, leaf in ((node.key, node.value, node), (key, value, None)):
                    if len(k) == upto:
                        new.end = Leaf(k, v)
                    else:
                        new.put(k[upto], leaf or Leaf(k, v))
            else:
                size = len(node.prefix)
                if key.startswith(node.prefix, at):
                    at += size
                    if at == len(key):
                        node.end = Leaf(key, value)
                        return
                    above, edge = node, key[at]
                    node, at = node.get(edge), at + 1
                    continue
                part = shared(node.prefix, key[at : at + size])
                new = Node(node.prefix[:part])
                new.put(node.prefix[part], node)
                node.prefix = node.prefix[part + 1 :]
                if at + part == len(key):
                    new.end = Leaf(key, value)
                else:
                    new.put(key[at + part], Leaf(key, value))
            if above is None:
                self.root = new
            else:
                above.put(edge, new)
            return

    def leaves(self):
        """(key, value, bytes shared with the key before), by key."""
        if self.root is None:
            return
        low, first = 0, True

        def below(node):
            return iter([*([node.end] if node.end else []), *(kid for _, kid in node.items())])

        stack = [(iter([self.root]), 0)]
        while stack:
            kids, depth = stack[-1]
            low = min(low, depth)
            kid = next(kids, None)
            if kid is None:
                stack.pop()
            elif isinstance(kid, Leaf):
                yield kid.key, kid.value, 0 if first else low
                low, first = len(kid.key), False
            else:
                # The byte of the edge stands between a node and its child.
                stack.append((below(kid), depth + (len(stack) > 1) + len(kid.prefix)))


class Path:
    """Turn-aligned nodes on the way to the key last seen; a key that leaves the way closes what it leaves.

    With ``open_left`` nodes of the first key may have begun in an earlier range: they are set aside
    in ``left`` and not closed.
    """

    def __init__(self, open_left: bool):
        self.open_left = open_left
        self.key, self.first, self.on_first = None, None, 0
        self.stack: list[dict] = []
        self.left: list[dict] = []
        self.rows: list[tuple] = []
        self.waiting = 0

    def _refer(self, key: bytes, depth: int, node: dict) -> None:
        """Let go of closed children whose parent is still open: they name it by a digest."""
        if node["closed"]:
            node["ref"] = node["ref"] or hashlib.sha256(key[: depth * WIDTH]).digest()[:WIDTH]
            self.rows += [(low, at, None, node["ref"], *rest) for low, at, *rest in node["closed"]]
            self.waiting -= len(node["closed"])
            node["closed"] = []

    def refer(self) -> None:
        for depth, node in enumerate(self.stack):
            self._refer(self.key, depth, node)

    def _pop(self) -> None:
        depth = len(self.stack) - 1
        node = self.stack.pop()
        if self.open_left and depth <= self.on_first:
            self._refer(self.key, depth, node)
            self.left.append(node)
            self.on_first = depth - 1
            return
        leaves = node["leaves"] if node["kids"] else 1
        saved = node["saved"] + (node["n"] - 1) * node["chars"]
        self.rows += [(low, at, node["low"], None, *rest) for low, at, *rest in node["closed"]]
        self.waiting -= len(node["closed"])
        row = (node["low"], depth, node["ref"], node["n"], node["kids"], leaves, saved, node["ends"] or EMPTY)
        if not depth:
            self.rows.append((row[0], 0, None, None, *row[2:]))
            return
        above = self.stack[-1]
        above["closed"].append(row)
        self.waiting += 1
        above["n"] += node["n"]
        above["low"] = node["low"] if above["low"] is None else min(above["low"], node["low"])
        above["kids"] += 1
        above["leaves"] += leaves
        above["saved"] += saved

    def push(self, key: bytes, common: int, steps: list[dict]) -> None:
        """Go on to ``key``, which shares ``common`` bytes with the key before; ``steps`` adds to its nodes."""
        while len(self.stack) - 1 > common // WIDTH:
            self._pop()
        self.key = key
        if self.first is None:
            self.first, self.on_first = key, len(key) // WIDTH
        for depth in range(len(self.stack), len(key) // WIDTH + 1):
            self.stack.append({"depth": depth, "n": 0, "low": None, "kids": 0, "leaves": 0, "saved": 0, "chars": 0, "ends": None, "ref": None, "closed": []})
        for step in steps:
            node = self.stack[step["depth"]]
            for name in ("n", "kids", "leaves", "saved"):
                node[name] += step.get(name, 0)
            node["chars"] = max(node["chars"], step.get("chars", 0))
            if step.get("low") is not None:
                node["low"] = step["low"] if node["low"] is None else min(node["low"], step["low"])
            node["ends"], node["ref"] = step.get("ends") or node["ends"], step.get("ref") or node["ref"]
        self.on_first = min(self.on_first, shared(self.first, key) // WIDTH) if self.open_left else self.on_first
        if self.waiting >= WAITING and self.open_left:
            self.refer()

    def close(self) -> None:
        while self.stack:
            self._pop()


def _add_key(path: Path, key: bytes, common: int, chars, n: int, low: int, ends: str) -> None:
    known = min(len(path.stack) - 1, common // WIDTH)
    steps = [{"depth": d + 1, "chars": chars[d]} for d in range(max(known, 0), len(chars))]
    path.push(key, common, [*steps, {"depth": len(chars), "n": n, "low": low, "ends": ends}])


def _batch(rows: list[tuple], paths: list[tuple]):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def fields(ddl):
        return [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))]

    schema = pa.schema([*fields(NODE), pa.field("key", pa.binary()), pa.field("path", pa.list_(pa.struct(fields(STEP))))])
    columns = list(zip(*[(*r, None, None) for r in rows], *[(*[None] * 10, key, steps) for key, steps in paths]))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _grow(batches):
    """Nodes of a range of sorted distinct keys, and the ways to its first and last key."""
    path, held = Path(open_left=True), []

    def plant():
        tree = RadixTree()
        for row in held:
            tree.insert(row[0], row)
        for i, (key, row, common) in enumerate(tree.leaves()):
            _add_key(path, key, common if i else shared(path.key or b"", key), *row[1:])
        held.clear()

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            held.append(row)
            if len(held) == TREE:
                plant()
        if len(path.rows) >= 1 << 14:
            yield _batch(path.rows, [])
            path.rows = []
    plant()
    if path.key is None:
        return
    path.refer()
    for step in (*path.left, *path.stack):
        del step["closed"]
    yield _batch(path.rows, [*([(path.first, path.left)] if path.left else []), (path.key, path.stack)])


def _merge(batches):
    """Nodes on the borders of ranges, from the ways to their first and last keys, sorted by key."""
    path = Path(open_left=False)
    for batch in batches:
        for key, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            path.push(key, shared(path.key or b"", key), steps)
    path.close()
    if path.rows:
        yield _batch(path.rows, [])


def _ids(batches):
    """Ids of equal conversations, sorted, written one after another in pieces."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for string, rows in itertools.groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda r: r[0]):
            ids = [i for _, i in rows]
            step = PIECE // 20
            out += [(string, ids[a], len(ids[a : a + step]), ",".join(map(str, ids[a : a + step]))) for a in range(0, len(ids), step)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["string", "low", "n", "ids"])


def _digests(batches):
    """Pieces of ids, sorted, to one digest a conversation string; a task holds one piece at a time."""
    import pyarrow as pa

    held, out = None, []
    for batch in batches:
        for string, low, n, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0] == string:
                held[2] += n
                held[3].update(b"," + ids.encode())
                continue
            if held:
                out.append((*held[:3], held[3].hexdigest()))
            held = [string, low, n, hashlib.sha256(ids.encode())]
        if len(out) >= 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["string", "low", "n", "ends"])
            out = []
    if held:
        out.append((*held[:3], held[3].hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["string", "low", "n", "ends"])


def rebuilt(turns: DataFrame, hundred: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, key, chars, string): the turn ids of every rebuilt conversation, its texts' lengths, and a digest of the key.

    Turns stand by turn, nulls first, those of one turn by their digest; null roles and texts are empty ones; rows repeated are turns of
    their own; rows without a conv_id belong to no conversation and are left out. A conversation is one row of 16 bytes a turn.
    """
    role, conv = F.coalesce("role", F.lit("")), F.col("conv_id").cast("long")
    turn = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text_or_empty()), 256), 1, 2 * WIDTH)
    rows = turns.select(
        conv.alias("conv_id"), (conv - conv % hundred).alias("base"), F.col("turn").isNotNull().alias("dated"), "turn", turn.alias("id"),
        F.length(text_or_empty()).cast("long").alias("chars"),
    ).where("conv_id IS NOT NULL")
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("dated", "turn", "id", "chars"))).alias("own"))
    # At most two hundred conversations have one base.
    lent = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, most - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    both = own.select("conv_id", F.concat(F.slice(F.coalesce(lent, F.slice("own", 1, 0)), F.lit(1), h), F.slice("own", h + 1, F.size("own"))).alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda t: t["id"]), ""))
    out = both.select("conv_id", key.alias("key"), F.transform("t", lambda t: t["chars"]).alias("chars"))
    return out.withColumn("string", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * WIDTH)))


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    No conversation at all gives no node; conversations without turns are members of the root alone. Equal conversations are counted,
    and their ids sorted and digested, apart from the tree, so they can be as many as they like.
    """
    convs = stored(rebuilt(turns), "conversations")
    ids = convs.select("string", "conv_id").repartitionByRange("string", "conv_id").sortWithinPartitions("string", "conv_id")
    pieces = ids.mapInArrow(_ids, "string binary, low long, n long, ids string")
    ends = pieces.repartition("string").sortWithinPartitions("string", "low").mapInArrow(_digests, "string binary, low long, n long, ends string")
    strings = convs.select("string", "key", "chars").dropDuplicates(["string"]).join(ends, "string")
    sorted_keys = strings.select("key", "chars", "n", "low", "ends").repartitionByRange("key").sortWithinPartitions("key")
    grown = stored(sorted_keys.mapInArrow(_grow, GROWN), "nodes")
    # Two rows a range; a task holds one way at a time.
    borders = grown.where("path IS NOT NULL").select("key", "path").repartition(1).sortWithinPartitions("key").mapInArrow(_merge, GROWN)
    nodes = grown.where("path IS NULL").drop("key", "path").unionByName(stored(borders.drop("key", "path"), "borders"))
    parents = nodes.where("ref IS NOT NULL").select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("above"))
    named = nodes.where("parent_ref IS NULL").unionByName(
        nodes.where("parent_ref IS NOT NULL").join(broadcast_if_small(parents), "parent_ref", "left").withColumn("parent_conv_id", F.col("above")).select(nodes.columns)
    )
    return named.drop("ref", "parent_ref")


def oracle_sql() -> str:
    """The same by grouping all prefixes, spelled out in full."""
    from tallywatch.llm.common import crc32_sql

    table, crc = crc32_sql("CAST(conv_id AS VARCHAR)")
    return f"""
    WITH crc AS (SELECT {table} AS crc_table),
    t AS (SELECT conv_id, conv_id - conv_id % 100 AS base, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
          FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id, base FROM t), crc),
    r AS (SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
          UNION ALL SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
    n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, text,
                 sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY i) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS node
          FROM r),
    p AS (SELECT conv_id, depth, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, length(text) AS chars,
                 depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM n
          UNION ALL SELECT conv_id, 0, 'root', NULL, 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
    g AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM p GROUP BY node),
    k AS (SELECT parent, count(*) AS n_children FROM g GROUP BY parent),
    f AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children FROM g LEFT JOIN k ON k.parent = g.node),
    -- Every node's own path, to sum over subtrees: a node lies below all prefixes of its first member.
    s AS (SELECT p.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved)::BIGINT AS saved_tokens
          FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
    SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
    FROM f JOIN s USING (node) LEFT JOIN f AS u ON u.node = f.parent"""
