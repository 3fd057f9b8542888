"""What the operators of this package share: stored tables, tables of queries, and small numpy helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.session import stored

__all__ = ["ORACLE", "QUERIES", "crc32_sql", "kept", "query", "read", "runs", "slices", "some_rows", "spans_of", "stored", "text_or_empty", "trimmed", "whole_groups"]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, the statement that checks it."""

    def add(func: Query) -> Query:
        QUERIES[name] = func
        if sql is not None:
            ORACLE[name] = sql
        return func

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc32_sql(text: str) -> tuple[str, str]:
    """For the SQL twins, which have no such function: a table to be named crc_table, and the unsigned CRC-32 of a text by it."""
    table = (
        "list_transform(range(256), lambda n: list_reduce(range(8), "
        "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"
    )
    code = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || hex(encode({text}))[2 * k + 1 : 2 * k + 2])::BIGINT)"
    return table, (
        f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    )


def trimmed() -> None:
    """Return freed memory to the system, where Arrow's pool and the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def some_rows(batches, rows: int = 1024):
    """Arrow batches cut into slices of at most ``rows`` rows, so that only so many texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kept(key: tuple, make: Callable):
    """What ``make`` gives, made once per Python worker: workers outlive tasks, what tasks unpickle does not.

    One object is kept; asking for another key lets go of it.
    """
    held = sys.modules.setdefault("tallywatch_kept", types.ModuleType("tallywatch_kept")).__dict__
    if held.get("key") != key:
        held["key"], held["value"] = None, None
        gc.collect()
        trimmed()
        held["value"] = make()
        held["key"] = key
        trimmed()
    return held["value"]


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def slices(texts: list[str], size: int) -> list[tuple[int, int]]:
    """Cut a list of texts into runs of about ``size`` characters, one text at least."""
    out, begin, total = [], 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            out.append((begin, i + 1))
            begin, total = i + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def runs(batches, keys: int):
    """Rows of Arrow batches sorted by their first ``keys`` columns, as one table per key."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.nonzero(new)[0].tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches, keys: int):
    """Rows of Arrow batches sorted by their first ``keys`` columns, as tables of many rows that never cut a key's rows apart.

    Yields (table, group number of every row).
    """
    import pyarrow as pa

    def numbered(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for k in range(keys):
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return table, np.cumsum(new)

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table, group = numbered(held)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks(), group[:cut]
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield numbered(held)
