"""How far the terms of each source diverge from its language's, by iceberg prefix refinement.

A term is kept in a language if at least ``MIN_DOCS`` of its documents hold it. No dictionary of all terms is ever
built: a pass over the texts counts, for each prefix of a few bytes, the distinct documents with a term that begins
so; prefixes below the threshold are discarded with all their terms, the next pass extends the others to twice the
length, and so on until no open prefix is left. A term that ends within a level's length is complete there; it is
counted with its occurrences by source, and kept if it reaches the threshold.

Surviving prefixes reach the next pass as a bitmap of fixed size, indexed by hash. A discarded prefix may slip
through it by chance and costs a little time; counts go by the bytes themselves, so results are exact. Each slice
of a task sends one row for each prefix, and Spark adds them up before and after the shuffle.

Shares of kept terms, smoothed, are compared between the sources of a language: sums over all terms for each pair
of sources, and the terms that stand out in a source. The sums come from blocks of terms and tiles of sources, a
dense matrix of bounded size at a time, so neither many terms nor many sources are gathered.

Defined results: a null text, lang or source is the empty string; each row is a document, repeated ones too; texts
and terms of any length are read whole; groups without terms, and languages without kept ones, have their pairs
(value 0 where nothing is kept); equal values rank by the item's bytes; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import mix, odd_numbers, slices, whole_groups
from wardline.session import materialize

MIN_DOCS = 30
FIRST = 3  # bytes of the first level's prefixes; each level doubles them
SLICE_BYTES = 4 << 20  # text counted at once inside a task
BITS = 26  # log2 of the bitmap's bits: 8 MB
TOP = 50  # terms listed for a group
SCALE = 1_000_000_000
SMOOTHING = 5
TILE = 256  # sources beside each other in a matrix
BLOCK_TERMS = 4096  # kept terms a task adds up for a pair of tiles

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True
_BYTE, _PLACE = odd_numbers(31, 256), odd_numbers(32, 1 << 12)


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _terms(data: np.ndarray, off: np.ndarray, above: int) -> tuple[pa.Array, np.ndarray]:
    """The terms of more than ``above`` bytes of a slice in order, and the row of each."""
    inside = _IS_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]  # rows end terms
    start = np.flatnonzero(begins)
    kept = np.flatnonzero(inside)
    heads = np.append(np.searchsorted(kept, start), len(kept))
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    letters = _LOWER[data[kept]]
    if above:
        long = np.flatnonzero(np.diff(heads) > above)
        letters, heads = _rows(letters, heads, long)
        row = row[long]
    return _strings(letters, heads), row


def _cut(data: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings cut to their first ``most`` bytes."""
    length = np.minimum(np.diff(off), most)
    head = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(head[-1]) + np.repeat(off[:-1] - head[:-1], length)
    return data[at], head


def _hashes(lang: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each (language hash, prefix)."""
    length = np.diff(off)
    out = lang + mix(length.astype(np.uint64) + np.uint64(1))
    some = np.flatnonzero(length)
    if len(some):
        place = np.arange(len(data)) - np.repeat(off[:-1], length)
        value = _BYTE[data] * _PLACE[place & (len(_PLACE) - 1)]
        value ^= value >> np.uint64(29)
        out[some] += np.add.reduceat(value, off[:-1][some])
    return mix(out)


def _lang_hash(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    return int(_hashes(np.zeros(1, np.uint64), raw, np.array([0, len(raw)]))[0])


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _level(length: int, before: int, alive):
    """A pass that counts prefixes of ``length`` bytes whose ``before`` bytes are alive in the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(alive.value, np.uint64) if alive else None
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            names = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            group = np.array([names[g] for g in groups])
            langs = list(dict.fromkeys(g[0] for g in names))
            lang_of = np.array([langs.index(g[0]) for g in names])
            hashed = np.array([_lang_hash(x) for x in langs], np.uint64)
            for t in slices(batch.column(2), SLICE_BYTES):
                terms, row = _terms(t.data, t.off, before)
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                code = coded.indices.to_numpy()
                data, off = _bytes_of(coded.dictionary)
                # distinct (document, term) with occurrences
                n_terms = len(coded.dictionary)
                pair, times = np.unique(row * n_terms + code, return_counts=True)
                row, code = pair // n_terms + t.lo, pair % n_terms
                lang = lang_of[group[row]]
                if bitmap is not None:
                    # terms whose prefix was discarded are done, like those that were complete before
                    both, back = np.unique(lang * n_terms + code, return_inverse=True)
                    cut, head = _cut(*_rows(data, off, both % n_terms), before)
                    bit = _bits(_hashes(hashed[both // n_terms], cut, head))
                    on = (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0
                    on = on[back]
                    row, code, times, lang = row[on], code[on], times[on], lang[on]
                ended = np.diff(off)[code] <= length
                yield _complete(names, group[row[ended]], code[ended], times[ended], coded.dictionary)
                cut, head = _cut(data, off, length)
                yield _open(langs, hashed, lang[~ended], row[~ended], code[~ended], cut, head)

    return run


def _rows(data: np.ndarray, off: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen strings of a binary column."""
    length = np.diff(off)[chosen]
    head = np.concatenate([[0], np.cumsum(length)])
    return data[np.arange(head[-1]) + np.repeat(off[chosen] - head[:-1], length)], head


_FIELDS = "lang string, source string, prefix binary, docs long, occurrences long, hash long"
_NAMES = ["lang", "source", "prefix", "docs", "occurrences", "hash"]


def _complete(names: dict, group: np.ndarray, code: np.ndarray, times: np.ndarray, dictionary: pa.Array) -> pa.RecordBatch:
    n = max(1, len(dictionary))
    key, back, docs = np.unique(group * n + code, return_inverse=True, return_counts=True)
    total = np.bincount(back, weights=times, minlength=len(key)).astype(np.int64)
    pairs = list(names)
    of = pa.array(key // n, pa.int32())
    columns = [pa.array([p[i] for p in pairs], pa.string()).take(of) for i in range(2)]
    prefix = dictionary.take(pa.array(key % n)).cast(pa.binary())
    return pa.RecordBatch.from_arrays([*columns, prefix, pa.array(docs), pa.array(total), pa.nulls(len(key), pa.int64())], _NAMES)


def _open(langs: list[str], hashed: np.ndarray, lang: np.ndarray, row: np.ndarray, code: np.ndarray, cut: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    """Prefixes of terms that go on, each once for a document."""
    coded = _strings(cut, head).dictionary_encode()
    n = max(1, len(coded.dictionary))
    prefix = coded.indices.to_numpy()[code]
    lang_of = np.zeros(int(row.max(initial=-1)) + 1, np.int64)
    lang_of[row] = lang
    once = np.unique(row * n + prefix)
    key, docs = np.unique(lang_of[once // n] * n + once % n, return_counts=True)
    data, off = _rows(*_bytes_of(coded.dictionary), key % n)
    hashes = _hashes(hashed[key // n], data, off)
    of = pa.array(langs, pa.string()).take(pa.array(key // n))
    text = _strings(data, off).cast(pa.binary())
    none = pa.nulls(len(key), pa.string())
    return pa.RecordBatch.from_arrays([of, none, text, pa.array(docs), pa.array(np.zeros(len(key), np.int64)), pa.array(hashes.view(np.int64))], _NAMES)


def _bitmap(survivors: DataFrame) -> bytes:
    """Bits of the surviving prefixes' hashes; the driver gets at most ``2 ** (BITS - 6)`` words."""
    bit = F.shiftrightunsigned("hash", 64 - BITS)
    words = survivors.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 AS int)))").alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out.tobytes()


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first: int = FIRST) -> DataFrame:
    """lang, source, term, n (occurrences there) and n_lang of each kept term in each source that has it.

    Terms are bytes. One pass over the texts for each level; ends with the level after which no prefix is open.
    """
    texts = _plain(docs)
    spark = docs.sparkSession
    found, alive, before, length = [], None, 0, first
    while True:
        counts = texts.mapInArrow(_level(length, before, alive), _FIELDS)
        summed = counts.groupBy("lang", "source", "prefix").agg(
            F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"), F.max("hash").alias("hash")
        )
        # an open prefix below the threshold is discarded here; a term's documents are still spread over its sources
        level = materialize(summed.where(F.col("source").isNotNull() | (F.col("docs") >= min_docs)), "level")
        found.append(level.where("source IS NOT NULL"))
        opened = level.where("source IS NULL")
        if opened.isEmpty():
            break
        alive = spark.sparkContext.broadcast(_bitmap(opened))
        before, length = length, 2 * length
    terms = found[0]
    for more in found[1:]:
        terms = terms.unionByName(more)
    whole = Window.partitionBy("lang", "prefix")
    terms = terms.select(
        "lang", "source", F.col("prefix").alias("term"), F.col("occurrences").alias("n"),
        F.sum("docs").over(whole).alias("docs"), F.sum("occurrences").over(whole).alias("n_lang"),
    )
    return terms.where(F.col("docs") >= min_docs).drop("docs")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)), in whole numbers throughout."""
    wide = "decimal(38,0)"
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + F.lit(SMOOTHING)).cast("decimal(20,0)")
    below = (total.cast("decimal(20,0)") + terms.cast("decimal(16,0)") * F.lit(SMOOTHING).cast("decimal(2,0)")).cast(wide)
    return F.call_function("div", above.cast(wide), F.nullif(below, F.lit(0).cast(wide))) + 1


def sources(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) with its tally and share bases; place numbers the sources of a language from 0."""
    groups = _plain(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    distinct = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang"))
    whole = distinct.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    joined = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = F.coalesce(_share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0))
    return joined.withColumns({"place": place, "base": base})


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows once for each pair of tiles that their source's tile belongs to."""
    tile = F.call_function("div", F.col("place"), F.lit(TILE))
    count = F.call_function("div", F.col("n_sources") + (TILE - 1), F.lit(TILE))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return pairs.withColumns({"lo": F.least(tile, "other"), "hi": F.greatest(tile, "other")})


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of absolute differences of shares, less those of the bases, for each pair of sources of two tiles."""
    for rows, bounds in whole_groups(batches):
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            part = rows.slice(lo, hi - lo)
            share, place = part.column("share").to_numpy(), part.column("place").to_numpy()
            n_bases = part.column("term").null_count  # they come first
            here, base = place[:n_bases], share[:n_bases]
            term = part.column("term").slice(n_bases).combine_chunks()
            code = term.dictionary_encode().indices.to_numpy() if len(term) else np.zeros(0, np.int64)
            column = np.searchsorted(here, place[n_bases:])
            left, right = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
            one = np.flatnonzero(here // TILE == left)
            two = np.flatnonzero(here // TILE == right)
            apart = np.abs(base[one][:, None] - base[two][None, :])
            total = np.zeros_like(apart)
            n_terms = int(code.max()) + 1 if len(code) else 0
            for first in range(0, n_terms, 512):
                a, b = np.searchsorted(code, [first, first + 512])
                dense = np.repeat(base[None, :], min(512, n_terms - first), axis=0)
                dense[code[a:b] - first, column[a:b]] = share[n_bases:][a:b]
                other = dense[:, two]
                for i, c in enumerate(one.tolist()):
                    total[i] += np.abs(dense[:, c : c + 1] - other).sum(axis=0) - len(dense) * apart[i]
            if part.column("bucket")[0].as_py() == 0:
                total += part.column("terms")[0].as_py() * apart
            i, j = np.nonzero(here[one][:, None] < here[two][None, :])
            names = part.column("source").slice(0, n_bases).combine_chunks()
            lang = part.column("lang").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(i), np.int64)))
            ends = [names.take(pa.array(side)) for side in (one[i], two[j])]
            yield pa.RecordBatch.from_arrays([lang, *ends, pa.array(total[i, j])], ["lang", "a", "b", "value"])


def source_pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, both ways round."""
    groups = groups.withColumn("n_sources", F.count("*").over(Window.partitionBy("lang")))
    buckets = F.greatest(F.call_function("div", F.col("terms") + (BLOCK_TERMS - 1), F.lit(BLOCK_TERMS)), F.lit(1).cast("long"))
    bases = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)))
    bases = bases.select("lang", "source", "place", "n_sources", "terms", "bucket", F.lit(None).cast("binary").alias("term"), F.col("base").alias("share"))
    size = groups.select("lang", "source", "place", "n_sources")
    rows = shares.join(size, ["lang", "source"]).withColumn("bucket", F.pmod(F.xxhash64("term"), buckets))
    rows = rows.select("lang", "source", "place", "n_sources", "terms", "bucket", "term", F.col("p").alias("share"))
    # names are only needed once, with the bases
    both = _tiles(bases).unionByName(_tiles(rows.withColumn("source", F.lit(""))))
    both = both.withColumn("g", F.xxhash64("lang", "lo", "hi", "bucket"))
    dealt = both.repartition("g").sortWithinPartitions("g", F.col("term").asc_nulls_first(), "place")
    summed = dealt.mapInArrow(_differences, "lang string, a string, b string, value long")
    summed = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return summed.select("lang", F.inline(ways), "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others, and its own terms."""
    kept = materialize(kept_terms(docs, min_docs), "kept")
    groups = materialize(sources(docs, kept), "groups")
    totals = groups.select("lang", "source", "total", "terms", "total_lang")
    shares = kept.join(totals, ["lang", "source"]).withColumns(
        {"p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))}
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = source_pairs(groups, shares.select("lang", "source", "term", "terms", "p"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    own = shares.where("n > 0 AND p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own = own.select("*", rank).where(F.col("rank") <= top)
    own = own.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(own)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, k.n AS n_lang FROM g JOIN k ON k.lang = g.lang),
n AS (SELECT c.lang, c.source, c.term, c.n_lang, coalesce(x.n, 0) AS n
      FROM c LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) x
      ON x.lang = c.lang AND x.source = c.source AND x.term = c.term),
s AS (SELECT n.lang, n.source, n.term, n.n,
             1 + 1000000000 * (n.n::HUGEINT + 5) // (sum(n.n) OVER (PARTITION BY n.lang, n.source) + 5 * v.v)::HUGEINT AS p,
             1 + 1000000000 * (n.n_lang::HUGEINT + 5) // (v.n + 5 * v.v) AS q
      FROM n JOIN v ON v.lang = n.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM p UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50"""
