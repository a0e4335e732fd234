"""Benchmark decontamination by spaced seeds.

A mask picks some of the words of a short window and ignores the others; equal picks in a benchmark item and a
text are a hit. Around a hit the two are laid over each other, and an overlap counts if some run of ``WINDOW``
following words agrees in at least ``AGREE`` of them. The two masks together meet every such run: whichever two
of its words differ, one mask fits between them. Items of fewer words than ``WINDOW`` must agree as a whole,
with one word differing if they have at least eight, and are found by plain runs of ``SHORT`` words.

A bitmap of the benchmark's seeds, of bounded size, sorts out nearly all positions of the texts; the others are
joined with the seeds by their hash, a join whose skewed partitions adaptive execution splits. Every text is
read once and never shuffled.

Defined results: null or empty texts and items match nothing; items under ``SHORT`` words are not searched, as
chance would find them; repeated items are reported each, repeated texts give repeated finds; other columns are
dropped; an empty benchmark or an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Words, free, hashed_words, odd_numbers, mix, slices, tidy

WINDOW, AGREE = 13, 11  # words, and how many of them must be equal
MASKS = ("110011101", "11010100011")
SHORT = 4
LIMIT_BITS = 1 << 28  # of the bitmap; beyond it more positions pass and the join does the rest
BITS_EACH = 512  # of the bitmap for each seed, at least

_TAKEN = [np.flatnonzero([c == "1" for c in m]) for m in (*MASKS, "1" * SHORT)]
SPAN = [len(m) for m in (*MASKS, "1" * SHORT)]
BACK, AHEAD = WINDOW - 1, WINDOW + SHORT  # words kept around the start of a hit
AROUND = BACK + AHEAD


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    n = len(hashes) - SPAN[mask] + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k, m in zip(_TAKEN[mask], odd_numbers(11 + mask, len(_TAKEN[mask]))):
            out += hashes[k : k + n] * m
    return mix(out)


def surroundings(w: Words, row: np.ndarray, at: np.ndarray, missing: int) -> np.ndarray:
    """32 bits of each word around the positions ``at`` of their rows; ``missing`` beyond a row's ends."""
    place = at[:, None] + np.arange(-BACK, AHEAD)
    inside = (place >= w.first[row][:, None]) & (place < w.first[row + 1][:, None])
    short = (w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(2)  # neither 0 nor 1
    return np.where(inside, short[np.minimum(np.maximum(place, 0), len(short) - 1)], np.uint32(missing))


def _found(w: Words, mask: int, passes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and seed of the windows that lie in one row and pass."""
    s = seeds(w.hash, mask)
    at = np.flatnonzero(passes(s))
    row = np.searchsorted(w.first, at, side="right") - 1
    good = at + SPAN[mask] <= w.first[row + 1]
    return row[good], at[good], s[at[good]]


def _rows(ids: pa.Array, lo: int, row: np.ndarray, columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(lo + row)), *map(pa.array, columns)], names)


def _packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in x.astype("<u4")]


def item_seeds(items: DataFrame) -> DataFrame:
    """item_id, n_words, seed and surrounding words of every seed of a benchmark table (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for t in slices(batch.column(1)):
                w = hashed_words(t)
                count = np.diff(w.first)
                for mask in range(len(SPAN)):
                    row, at, seed = _found(w, mask, lambda s: np.ones(len(s), bool))
                    fits = (count[row] < WINDOW) == (mask == len(MASKS))
                    row, at, seed = row[fits], at[fits], seed[fits]
                    if len(row):
                        columns = [count[row], at - w.first[row], seed.astype(np.int64), _packed(surroundings(w, row, at, 0))]
                        names = ["item_id", "n_words", "place", "seed", "item_words"]
                        yield _rows(batch.column(0), t.lo, row, columns, names)

    kind = items.schema["item_id"].dataType.simpleString()
    fields = f"item_id {kind}, n_words long, place long, seed long, item_words binary"
    return items.select("item_id", "text").mapInArrow(run, fields)


def bitmap_of(found: DataFrame) -> tuple[np.ndarray, bool]:
    """Bits that are set at the seeds modulo their number, and whether there are short items; the driver holds both."""
    n, short = found.agg(F.count("*"), F.coalesce(F.max(F.col("n_words") < WINDOW), F.lit(False))).first()
    bits = 1 << 16
    while bits < min(n * BITS_EACH, LIMIT_BITS):
        bits *= 2
    place = F.col("seed").bitwiseAND(bits - 1)
    words = found.groupBy(F.shiftright(place, 3).cast("int").alias("at"))
    words = words.agg(F.expr("bit_or(shiftleft(1, cast(seed & 7 as int)))").alias("set"))
    out = np.zeros(bits // 8, np.uint8)
    for r in words.toLocalIterator():
        out[r["at"]] = r["set"]
    return out, bool(short)


def text_hits(docs: DataFrame, bitmap: np.ndarray, short: bool, keep: list[str]) -> DataFrame:
    """``keep``, seed and surrounding words of every window of a text whose seed is in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = [*keep, "seed", "text_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        last = np.uint64(len(bits) * 8 - 1)

        def passes(s: np.ndarray) -> np.ndarray:
            at = s & last
            return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

        for batch in batches:
            for t in slices(batch.column(len(keep))):
                w = hashed_words(t)
                for mask in range(len(SPAN) if short else len(MASKS)):
                    row, at, seed = _found(w, mask, passes)
                    for lo in range(0, len(row), 20_000):
                        r, a, s = (x[lo : lo + 20_000] for x in (row, at, seed))
                        kept = [batch.column(i).take(pa.array(t.lo + r)) for i in range(len(keep))]
                        made = [pa.array(s.astype(np.int64)), pa.array(_packed(surroundings(w, r, a, 1)), pa.binary())]
                        yield pa.RecordBatch.from_arrays([*kept, *made], names)

    rows = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{kept}, seed long, text_words binary")


def agreement(item: np.ndarray, text: np.ndarray, n_words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Most equal words of a run that is long and equal enough, 0 if there is none; rows lie over each other."""
    equal = (item == text).astype(np.int32)
    sums = np.concatenate([np.zeros((len(equal), 1), np.int32), np.cumsum(equal, axis=1)], axis=1)
    runs = sums[:, WINDOW:] - sums[:, :-WINDOW]
    best = runs.max(axis=1)
    best[best < AGREE] = 0
    # short items as a whole; they lie within the kept words
    small = n_words < WINDOW
    begin = np.clip(BACK - place, 0, AROUND)
    end = np.clip(begin + n_words, 0, AROUND)
    rows = np.arange(len(equal))
    whole = sums[rows, end] - sums[rows, begin]
    best[small] = np.where(whole >= n_words - (n_words >= 8), whole, 0)[small]
    return best


def overlaps(docs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row for each text and item that overlap: ``keep`` (doc_id), item_id and the most equal words of a run."""
    keep = keep or ["doc_id"]
    found = item_seeds(items)
    bitmap, short = bitmap_of(found)
    hits = text_hits(docs, bitmap, short, keep)
    pairs = hits.join(found, "seed").select(*keep, "item_id", "n_words", "place", "item_words", "text_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, place, item, text = (batch.column(len(keep) + k) for k in range(1, 5))
            words = [np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, AROUND) for c in (item, text)]
            best = agreement(*words, n.to_numpy(), place.to_numpy())
            good = pa.array(best > 0)
            columns = [batch.column(i).filter(good) for i in range(len(keep) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best[best > 0].astype(np.int64))], [*keep, "item_id", "n_equal"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keep, "item_id").schema)
    return pairs.mapInArrow(run, f"{kept}, n_equal long").groupBy(*keep, "item_id").agg(F.max("n_equal").alias("n_equal"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an overlap, with their columns. Rows are told apart by doc_id and text, null ids too."""
    key, h = free("_id", docs.columns), free("_h", docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(F.col("doc_id").alias(key), F.xxhash64(text).alias(h), "text")
    bad = overlaps(marked, items, [key, h]).select(F.col(key).alias("_bad_id"), F.col(h).alias("_bad_h")).distinct()
    keyed = docs.withColumn(h, F.xxhash64(text))
    same = (keyed[h] == bad["_bad_h"]) & keyed["doc_id"].eqNullSafe(bad["_bad_id"])
    return keyed.join(bad, same, "left_anti").select(*docs.columns)
