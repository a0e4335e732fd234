"""Reading tables, cutting Arrow batches into bounded slices, and words as vectors of hashes.

A word, unless an operator says otherwise, is a longest run of ASCII letters or digits and of any bytes
from 0x80 up, with A-Z lower-cased. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20  # text handled at once inside a task; one longer text makes a slice of its own
BATCH_BYTES = 4 << 20  # rows sent to a Python worker at once; one longer row makes a batch of its own

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on text whose A-Z are lower-cased
LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session now bounds batches for Python workers by bytes as well as by rows.

    Ten thousand texts may be any number of bytes, held by the executor and by the worker at once. A bound that the
    session's user has set stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not conf.get(key, None):
        conf.set(key, str(BATCH_BYTES))
    return df


def tables(name: bytes, make):
    """The tables ``name`` of a Python worker, made once and kept from task to task until others are asked for."""
    kept = sys.__dict__.setdefault("_wardline_tables", [])  # a module's own names come anew with each task
    if not kept or kept[0] != name:
        tidy()
        kept[:] = [name, make()]
    return kept[1]


def tidy() -> None:
    """Gives back what earlier tasks of other operators left in this Python worker: tables, and pages not in use.

    Workers go from one operator to the next; without this they hold the most that each of them ever needed.
    """
    kept = sys.__dict__.setdefault("_wardline_tables", [])
    if kept:
        kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


class Texts(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch: their bytes end to end, row ``i`` being data[off[i]:off[i+1]]."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """A string column in slices of at most ``most`` bytes or one row."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield Texts(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on ``seed`` alone."""
    count = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)
    return mix(count * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_BYTE = odd_numbers(1, 256)[_LOWER]
_PLACE = odd_numbers(2, 1 << 12)


class Words(NamedTuple):
    """Words of a slice in order: 64-bit hash, bounds in bytes, and the number of words before each row."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # row i has the words first[i] to first[i + 1]


def hashed_words(t: Texts) -> Words:
    inside = _IS_WORD[t.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = t.off[1:-1]
    edges = edges[(edges > 0) & (edges < len(t.data))]
    begins[edges] = inside[edges]  # rows end words
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, t.off)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, first)
    at = np.flatnonzero(inside)
    length = end - start
    head = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(head, length)
    value = _BYTE[t.data[at]] * _PLACE[place & (len(_PLACE) - 1)]
    value ^= value >> np.uint64(29)
    return Words(mix(np.add.reduceat(value, head) + length.astype(np.uint64)), start, end, first)


def windows_of(hashes: np.ndarray, width: int, seed: int = 3) -> np.ndarray:
    """The hash of each run of ``width`` following words; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(odd_numbers(seed, width)):
        out += hashes[k : k + n] * m
    return mix(out)


def free(name: str, taken) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], key: str = "g") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``key``, cut between groups: tables with the bounds of the groups in them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        heads = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        begins = not held or held[-1].column(key)[-1].as_py() != keys[0]
        if held and (begins or len(heads)):
            cut = 0 if begins else int(heads[0])
            yield _bounded(held + [batch.slice(0, cut)] if cut else held, key)
            held, batch = [], batch.slice(cut)
            heads = heads[heads > cut] - cut
        if not held and len(heads):
            yield _bounded([batch.slice(0, int(heads[-1]))], key)
            batch = batch.slice(int(heads[-1]))
        held.append(batch)
    if held:
        yield _bounded(held, key)


def _bounded(batches: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    keys = rows.column(key).to_numpy()
    return rows, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smallest, other) that connect 0..n-1 as ``pairs`` do."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(r, x) for x in range(n) if (r := top(x)) != x]
