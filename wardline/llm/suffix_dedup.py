"""Removal of every byte inside a 200-byte string that occurs twice, by suffix arrays of anchored contexts.

* Anchors. In each 200-byte window the ``GRAM``-byte string of least hash is an anchor. Equal windows have their
  anchor at the same place, so whatever repeats shares an anchor, and about one byte in 80 is one. Only anchors
  whose string occurs twice go on.
* Contexts. An anchor's context is all that windows with this anchor can cover. Equal contexts are counted with
  partial sums; one that occurs twice is covered as a whole.
* Suffix arrays. The distinct contexts of an anchor are cut into blocks, forwards from the anchor and backwards
  before it; ranks of the blocks make the texts whose suffixes are sorted by linear grouping
  (``suffix_sort.py``). Common prefixes of neighbours in the two orders give, for every window, the contexts
  that share its left and its right part, so windows are compared exactly.
* Spans go back to the texts that hold the contexts and are merged for each text.

An anchor with many contexts (a common passage between ever different neighbours) is split by the content of
ever shorter ranges of windows until each part is small. Contexts that agree in all bytes of a range are covered
there as a whole and go on as one, and a range of one window leaves only such. So no group is held whole, and no
bucket is capped. Joins by a hot anchor or context are ones that adaptive execution splits.

Anchors are compared by a 64-bit hash together with up to 160 exact bytes around them, contexts by a 64-bit
hash within their anchor, rows by a 64-bit hash of id and text.

Defined results: null texts are empty; texts under 200 bytes lose nothing and match nothing; repeated rows are
texts of their own and lose all they share; ids may be null or repeated; other columns are ignored by ``spans``
and kept by ``without_repeats``, which cuts n_chars to the new text if there is such a column and drops parts of
characters that a cut leaves; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import Texts, free, mix, odd_numbers, slices, tidy, whole_groups
from wardline.llm.suffix_sort import suffix_order
from wardline.session import materialize

LENGTH = 200  # bytes of a string that must not repeat
GRAM = 40  # bytes of an anchor
BEFORE = LENGTH - GRAM  # most bytes of a window before its anchor
SPLIT = 8  # parts that the windows of a large bucket are divided into
LARGE = 1 << 16  # contexts of a bucket that are sorted together, about 4 KB of memory each with their bytes
PACKED = 2048  # contexts of small buckets that are sorted together
BLOCK = 40  # bytes of a block
STRETCH = 1 << 16  # bytes handled at once, so that the work on them stays in a core's cache

_BYTE = odd_numbers(41, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ROW, EMPTY = "array<struct<lo: int, hi: int>>", np.zeros(0, np.int64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, STRETCH + 2 * LENGTH + 2), _powers(_INVERSE, STRETCH + 2 * LENGTH + 2)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, in blocks met from both ends."""
    n = len(x) - width + 1
    full = -(-len(x) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _stretch_anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows that ``valid`` allows, and their hashes."""
    n = len(data)
    up, down = _POWERS
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    width = BEFORE + 1
    least = np.where(valid, _least(grams, width), np.uint64(0))
    # the greatest of the least over all windows that hold a gram
    around = np.zeros(len(grams) + width - 1, np.uint64)
    around[width - 1 : width - 1 + len(least)] = ~least
    around[: width - 1] = around[width - 1 + len(least) :] = np.iinfo(np.uint64).max
    at = np.flatnonzero(~_least(around, width) == grams)
    return at, grams[at]


def anchors(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, hash and context hash of every anchor of a slice, a stretch of windows at a time."""
    out: list[tuple] = []
    n = len(t.data)
    for lo in range(0, max(n - LENGTH + 1, 0), STRETCH):
        final = lo + STRETCH > n - LENGTH
        left, hi = max(0, lo - BEFORE), n if final else lo + STRETCH + LENGTH - 1
        begin = np.arange(left, hi - LENGTH + 1)
        end = t.off[np.searchsorted(t.off, begin, side="right")]
        at, h = _stretch_anchors(t.data[left:hi], begin + LENGTH <= end)
        at += left
        keep = (at >= lo) & (final | (at < lo + STRETCH))
        at, h = at[keep], h[keep]
        row = np.searchsorted(t.off, at, side="right") - 1
        c = _context_hashes(t, row, at, max(0, lo - BEFORE), min(n, hi + LENGTH))
        out.append((row, at - t.off[row], h, c))
    if not out:
        return EMPTY, EMPTY, EMPTY.astype(np.uint64), EMPTY.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _context_hashes(t: Texts, row: np.ndarray, at: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Hashes of the contexts of anchors, which all lie between two positions."""
    lo, hi = np.maximum(at - BEFORE, t.off[row]), np.minimum(at + LENGTH, t.off[row + 1])
    width = BEFORE + LENGTH
    data = np.concatenate([t.data[begin:end], np.zeros(width, np.uint8)])
    every = np.lib.stride_tricks.sliding_window_view(data, width)
    out = np.empty(len(at), np.uint64)
    factors = odd_numbers(42, width // 8)
    steps = np.arange(width // 8, dtype=np.uint64)
    for k in range(0, len(at), 1024):
        part = slice(k, k + 1024)
        found = every[lo[part] - begin]
        found = found * (np.arange(width) < (hi - lo)[part][:, None])  # nothing beyond the context
        out[part] = mix(found.view("<u8") * factors + steps).sum(axis=1)
    return mix(out + (at - lo).astype(np.uint64) * _BASE + (hi - at).astype(np.uint64))


def keyed(docs: DataFrame) -> DataFrame:
    """_key, of id and text, and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(F.isnull("doc_id"), "doc_id", text).alias("_key"), text.alias("text"))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for batch in batches:
        for t in slices(batch.column(1)):
            row, at, h, c = anchors(t)
            keys = batch.column(0).take(pa.array(t.lo + row))
            made = [pa.array(x.astype(np.int64)) for x in (at, h, c)]
            yield pa.RecordBatch.from_arrays([keys, *made], ["_key", "at", "h", "c"])


def _bytes_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a text is asked for."""
    tidy()
    names = ["g", "c", "first", "last", "before", "around"]
    for batch in batches:
        asked = batch.column(1).to_pylist()
        out: list[list] = [[], [], [], []]
        for text, wanted in zip(batch.column(0), asked):
            data = text.as_py().encode()
            for x in wanted:
                lo = max(0, x["at"] - BEFORE)
                out[0].append(x["h"])
                out[1].append(x["c"])
                out[2].append(x["at"] - lo)
                out[3].append(data[lo : x["at"] + LENGTH])
            if len(out[0]) > 10_000:
                yield _context_batch(out, names)
                out = [[], [], [], []]
        yield _context_batch(out, names)


def _context_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    n = len(out[0])
    longs = [pa.array(x, pa.int64()) for x in out[:2]]
    ends = [pa.array([0] * n, pa.int32()), pa.array([BEFORE] * n, pa.int32()), pa.array(out[2], pa.int32())]
    return pa.RecordBatch.from_arrays([*longs, *ends, pa.array(out[3], pa.binary())], names)


CONTEXT = "g long, c long, first int, last int, before int, around binary"


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


def _sorted(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows by bucket, and the common prefix of each with the one before it.

    Rows are texts of bucket and block ranks; the bucket's symbol, above all ranks, begins each text, and the order
    of the suffixes at these symbols is that of the rows.
    """
    n, width = rows.shape
    blocks = np.ascontiguousarray(rows).view(f"S{BLOCK}")
    ranks = np.unique(blocks, return_inverse=True)[1].reshape(n, -1)
    text = np.empty((n, ranks.shape[1] + 1), np.int64)
    text[:, 0] = bucket + int(ranks.max(initial=0)) + 1
    text[:, 1:] = ranks
    order = np.array(suffix_order(text.ravel().tolist()))
    order = order[order % text.shape[1] == 0] // text.shape[1]
    equal = rows[order[1:]] == rows[order[:-1]]
    common = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1))
    common[bucket[order[1:]] != bucket[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def repeated_windows(bucket: np.ndarray, before: np.ndarray, around: list[bytes], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """[context, o]: does the window that begins o bytes before the anchor occur in another context of its bucket."""
    n = len(around)
    out = np.zeros((n, BEFORE + 1), bool)
    size = np.array([len(a) for a in around]) - before
    right = _matrix([a[b:] for a, b in zip(around, before.tolist())], LENGTH)
    by_right, common_right = _sorted(bucket, right)
    begin = np.maximum(np.maximum(first, LENGTH - size), LENGTH - _reach(by_right, common_right))
    end = np.minimum(last, before)
    alive = np.flatnonzero(begin <= end)  # what shares too little after the anchor is not sorted again
    if not len(alive):
        return out
    left = _matrix([around[i][: before[i]][::-1] for i in alive.tolist()], BEFORE)
    by_left, common_left = _sorted(bucket[alive], left)
    begin, end = begin[alive], np.minimum(end[alive], _reach(by_left, common_left))
    a, b = np.empty(len(alive), np.int64), np.empty(n, np.int64)
    for o in range(int(begin.min()), int(end.max()) + 1):
        has = np.flatnonzero((begin <= o) & (o <= end))
        if len(has) < 2:
            continue
        a[by_left] = np.cumsum(common_left < o)
        b[by_right] = np.cumsum(common_right < LENGTH - o)
        same = a[has] * (n + 1) + b[alive[has]]
        order = np.argsort(same, kind="stable")
        ordered = same[order]
        pair = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(has), bool)
        twice[1:] |= pair
        twice[:-1] |= pair
        out[alive[has[order[twice]]], o] = True
    return out


def _reach(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest prefix that each row of an order shares with any other."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], -1))
    return out


def _runs(flags: np.ndarray) -> pa.Array:
    """Covered bytes, as ranges from the anchor, of the windows flagged for each context."""
    step = np.diff(flags.astype(np.int8), prepend=0, append=0)
    row, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    ranges = [pa.array((1 - end).astype(np.int32)), pa.array((LENGTH - begin).astype(np.int32))]
    offsets = np.searchsorted(row, np.arange(len(flags) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(ranges, ["lo", "hi"]))


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for rows, bounds in whole_groups(batches):
        lo = 0
        while lo < len(bounds) - 1:  # whole buckets, a few thousand contexts at a time
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + PACKED, side="right")) - 1)
            part = rows.slice(int(bounds[lo]), int(bounds[hi] - bounds[lo]))
            sizes = np.diff(bounds[lo : hi + 1])
            lo = hi
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            single = np.repeat(sizes == 1, sizes)
            if single.all():
                continue
            keep = pa.array(~single)
            part, bucket = part.filter(keep), bucket[~single]
            numbers = [part.column(k).to_numpy() for k in ("before", "first", "last")]
            flags = repeated_windows(bucket, numbers[0], part.column("around").to_pylist(), *numbers[1:])
            hit = np.flatnonzero(flags.any(axis=1))
            made = part.take(pa.array(hit))
            columns = [made.column("h").combine_chunks(), made.column("c").combine_chunks()]
            yield pa.RecordBatch.from_arrays([*columns, _runs(flags[hit])], ["h", "c", "ranges"])


def _name(x: int, y: int, z: int, data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d %d %d " % (x, y, z) + data, digest_size=8).digest(), "little", signed=True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context once for each part of its windows, keyed by what all windows of the part have in common.

    ``r`` names all the bytes of the part's windows.
    """
    tidy()
    names = ["h", "g", "c", "first", "last", "before", "around", "r"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for h, g, c, first, last, before, around in zip(*(batch.column(n).to_pylist() for n in names[:-1])):
            step = -(-(last - first + 1) // SPLIT)
            for a in range(first, last + 1, step):
                b = min(a + step - 1, last)
                # the part's windows begin b to a bytes before the anchor
                core = around[max(0, before - a) : before + LENGTH - b]
                if before < a or len(around) - before < LENGTH - b:
                    continue  # no window of this part lies in the text
                lo, hi = max(0, before - b), before + LENGTH - a
                around_part = around[lo:hi]
                values = (h, _name(g, a, b, core), c, a, b, before - lo, around_part, _name(before - lo, 0, 0, around_part))
                for column, value in zip(out, values):
                    column.append(value)
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)


def _sort_buckets(contexts: DataFrame) -> DataFrame:
    """h, c and ranges of the contexts with repeated windows, from contexts in buckets ``g``."""
    found, left = [], contexts
    fields = f"h long, {CONTEXT}"
    columns = [f.split()[0] for f in fields.split(", ")]
    while True:
        sizes = left.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        large = materialize(sizes.where(F.col("n") > LARGE).select("g"), "large")
        some = large.limit(1).count()
        now = left.join(large, "g", "left_anti") if some else left
        dealt = now.select(*columns).repartition("g").sortWithinPartitions("g")
        found.append(dealt.mapInArrow(_covered, f"h long, c long, ranges {ROW}"))
        if not some:
            break
        split = left.join(large, "g").select(*columns)
        parts = materialize(split.mapInArrow(_parts, f"{fields}, r long"), "parts")
        # windows whose bytes are all alike repeat as a whole; one context stands for them in what follows
        one = F.min(F.struct("h", "c", "first", "last", "before", "around")).alias("one")
        alike = parts.groupBy("g", "r").agg(F.count("*").alias("n"), one)
        alike = materialize(alike, "alike")
        ends = F.array(F.struct((-F.col("last")).alias("lo"), (LENGTH - F.col("first")).alias("hi")))
        twice = alike.where("n > 1").select("g", "r")
        found.append(parts.join(twice, ["g", "r"]).select("h", "c", ends.cast(ROW).alias("ranges")))
        left = alike.select("g", "one.*").select(*columns)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _union(ranges: Column) -> Column:
    """Sorted ranges with those that overlap or touch made one."""

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))
        meets = (F.size(done) > 0) & (last["hi"] >= r["lo"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, F.array().cast(ROW), add)


def spans(docs: DataFrame) -> DataFrame:
    """_key and the sorted, disjoint byte ranges to remove, of the texts that have any."""
    texts = keyed(docs)
    every = materialize(texts.mapInArrow(_anchor_rows, "_key long, at long, h long, c long"), "every")
    often = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = materialize(every.join(often, "h"), "anchors")
    holder = F.struct("_key", F.col("at").cast("int").alias("at"))
    contexts = shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(holder).alias("one"))
    contexts = materialize(contexts, "contexts")
    several = contexts.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    wanted = contexts.join(several, "h").select("one._key", F.struct("one.at", "h", "c").alias("x"))
    wanted = wanted.groupBy("_key").agg(F.collect_list("x").alias("wanted"))
    around = texts.join(wanted, "_key").select("text", "wanted").mapInArrow(_bytes_around, CONTEXT)
    # repeated rows answer more than once
    around = materialize(around.withColumn("h", F.col("g")).dropDuplicates(["h", "c"]), "around")
    whole = F.array(F.struct(F.lit(-BEFORE).alias("lo"), F.lit(LENGTH).alias("hi"))).cast(ROW)
    covered = contexts.where("n > 1").select("h", "c", whole.alias("ranges")).unionByName(_sort_buckets(around))
    # one row a context, its ranges made disjoint, so that no holder is repeated
    covered = covered.groupBy("h", "c").agg(_union(F.array_sort(F.flatten(F.collect_set("ranges")))).alias("ranges"))
    found = shared.join(covered, ["h", "c"]).select("_key", "at", F.explode("ranges").alias("r")).select(
        "_key", F.greatest(F.lit(0), F.col("at") + F.col("r.lo")).alias("lo"), (F.col("at") + F.col("r.hi")).alias("hi")
    )
    return found.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def cut(data: bytes, ranges: list[dict] | None) -> tuple[bytes, int]:
    """What is left of ``data`` and the number of runs removed; ranges are sorted and may overlap."""
    kept, at, runs, end = [], 0, 0, -1
    for r in ranges or ():
        lo, hi = r["lo"], min(r["hi"], len(data))
        if lo > end:
            runs += 1
        if lo > at:
            kept.append(data[at:lo])
        at = end = max(at, hi)
    kept.append(data[at:])
    return b"".join(kept), runs


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, ranges in zip(batch.column(1), batch.column(2)):
            data = text.as_py().encode()
            kept, runs = cut(data, ranges.as_py())
            for column, value in zip(out, (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out)], names)


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    found = spans(docs)
    key, ranges = free("_row", docs.columns), free("_spans", docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(key, F.xxhash64(F.isnull("doc_id"), "doc_id", text))
    found = found.select(F.col("_key").alias(key), F.col("spans").alias(ranges))
    return rows.join(found, key, "left").drop(key), ranges


def removed(docs: DataFrame) -> DataFrame:
    """Digests of what the removal leaves of each document."""
    rows, ranges = _with_spans(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ranges)
    fields = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(_digests, fields)


def _cut_texts(text_at: int, span_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column(text_at), batch.column(span_at)):
                text, ranges = text.as_py(), ranges.as_py()
                texts.append(cut(text.encode(), ranges)[0].decode("utf-8", "ignore") if ranges else text)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            del columns[span_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != span_at]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns and what is left of their texts."""
    rows, ranges = _with_spans(docs)
    rows = rows.select(*docs.columns, ranges)
    out = rows.mapInArrow(_cut_texts(docs.columns.index("text"), len(docs.columns)), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out
