"""Similarity join of texts on five-word shingles, with Bayesian pruning of candidates.

Texts with equal sets of shingles are one node. A node's MinHash values are cut into bands; nodes that agree in
a band are candidates. Two candidates are compared a few values at a time, and dropped as soon as the posterior
probability that their similarity reaches the threshold falls below a tolerance. The pairs left connect nodes
into groups, and within each group every pair that passes the same pruning is verified on its whole sets.
Links found that way connect the classes.

Buckets and groups are cut into blocks of bounded size and compared block by block; a block's result is a count
for each node and a forest of edges, never its pairs. Buckets are pre-aggregated before anything is joined, and
joins by a hot key are ones that adaptive execution splits. Intermediate tables lie in the shared folder.

Chances: two nodes at exactly the threshold share no band with probability (1 - 0.8^3)^21 = 3e-7, and each step
of pruning drops them with about the tolerance.

Defined results: texts of one to four words have one shingle, all their words; null texts, empty ones and those
without words are alike; repeated rows are copies of each other; documents with null ids belong to classes like
any other, and a class of such documents alone has a null id; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import Texts, forest, free, hashed_words, mix, odd_numbers, slices, tidy, whole_groups, windows_of
from wardline.llm.components import components
from wardline.session import materialize

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 21, 3
VALUES = 64  # MinHash values of a node; the first BANDS * ROWS make the bands
STEP = 16  # values compared at a time
TOLERANCE = 1e-8
BLOCK_NODES = 512  # of a bucket that are compared at once
BLOCK_SHINGLES = 250_000  # of a group that are compared at once, in at most
BLOCK_TEXTS = 1024  # distinct texts

_FACTORS = odd_numbers(21, VALUES)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of ``n`` equal values for which P(similarity >= threshold) is at least the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


STEPS = [(n, least_matches(n)) for n in range(STEP, VALUES + 1, STEP)]


def survivors(left: np.ndarray, right: np.ndarray, upper: bool) -> np.ndarray:
    """Index pairs of rows that no step drops; ``upper`` leaves out pairs of a row with itself or an earlier one."""
    a, b = np.triu_indices(len(left), 1) if upper else np.indices((len(left), len(right))).reshape(2, -1)
    equal = np.zeros(len(a), np.int32)
    for n, least in STEPS:
        equal += (left[a, n - STEP : n] == right[b, n - STEP : n]).sum(axis=1)
        kept = equal >= least
        a, b, equal = a[kept], b[kept], equal[kept]
    return np.column_stack([a, b])


def shingles(t: Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = hashed_words(t)
    every = windows_of(w.hash, WIDTH)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if hi - lo >= WIDTH:
            out.append(np.unique(every[lo : hi - WIDTH + 1]))
        else:
            out.append(windows_of(w.hash[lo:hi], hi - lo, 4) if hi > lo else np.zeros(1, np.uint64))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for batch in batches:
        for t in slices(batch.column(2)):
            sets = shingles(t)
            size = np.array([len(s) for s in sets])
            head = np.concatenate([[0], np.cumsum(size)[:-1]])
            every = np.concatenate(sets)
            mins = np.empty((len(sets), VALUES), np.uint64)
            for k, f in enumerate(_FACTORS):
                mins[:, k] = np.minimum.reduceat(every * f, head)
            node = mix(np.add.reduceat(mix(every.copy()), head) + size.astype(np.uint64))
            band = np.zeros((len(sets), BANDS), np.uint64)
            for k in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + mins[:, k : BANDS * ROWS : ROWS])
            short = (mix(mins) >> np.uint64(48)).astype("<u2")
            values = band.view(np.int64).ravel()
            kept = [batch.column(i).slice(t.lo, t.hi - t.lo) for i in range(2)]
            offsets = pa.array(np.arange(0, len(values) + 1, BANDS), pa.int32())
            made = [
                pa.array(node.view(np.int64)),
                pa.array(size.astype(np.int64)),
                pa.array([r.tobytes() for r in short], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(values)),
            ]
            names = ["doc_id", "text_hash", "node", "size", "signature", "bands"]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (its set of shingles), size, signature and bands of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, text_hash long, node long, size long, signature binary, bands array<long>"
    return materialize(_keyed(docs).mapInArrow(_signatures, fields), "signatures")


def _in_blocks(rows: DataFrame, group: list[str], n_blocks: Column, spread: str) -> DataFrame:
    """Rows once for each pair of blocks they take part in: ``g`` the pair, ``mine`` their block, ``cross``."""
    blocks = rows.withColumn("n_blocks", n_blocks.cast("long"))
    blocks = blocks.withColumn("mine", F.pmod(F.xxhash64(F.col(spread), F.lit(5)), "n_blocks"))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return pairs.select(
        F.xxhash64(*group, F.least("mine", "other"), F.greatest("mine", "other")).alias("g"),
        "mine",
        (F.col("mine") != F.col("other")).alias("cross"),
        *[c for c in rows.columns if c not in group],
    )


def _sides(mine: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two sides of a block pair, the same rows twice for a block with itself."""
    if not cross:
        every = np.arange(len(mine))
        return every, every
    return np.flatnonzero(mine == mine.min()), np.flatnonzero(mine != mine.min())


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for rows, bounds in whole_groups(batches):
        node, mine = rows.column("node").to_numpy(), rows.column("mine").to_numpy()
        cross = rows.column("cross").to_numpy(zero_copy_only=False)
        values = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u2").reshape(-1, VALUES)
        out: list[tuple[int, int]] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            a, b = _sides(mine[lo:hi], cross[lo])
            pairs = survivors(values[lo:hi][a], values[lo:hi][b], not cross[lo])
            if len(pairs):
                pairs = np.column_stack([a[pairs[:, 0]], b[pairs[:, 1]]])
                out += [(int(node[lo + x]), int(node[lo + y])) for x, y in forest(hi - lo, pairs)]
        edges = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """node and label of all nodes that some chain of unpruned candidates connects."""
    bands = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = bands.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = bands.join(buckets, ["band", "value"]).join(nodes.select("node", "signature"), "node")
    blocks = F.ceil(F.col("n") / BLOCK_NODES)
    pairs = _in_blocks(members, ["band", "value"], blocks, "node").select("g", "mine", "cross", "node", "signature")
    edges = pairs.repartition("g").sortWithinPartitions("g").mapInArrow(_bucket_edges, "u long, v long")
    return components(edges)


def overlap_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Shared shingles of each pair of sets."""
    if len(pairs) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs.tolist()], np.int64)
    used = np.unique(pairs)
    place = np.searchsorted(used, pairs)
    size = np.array([len(sets[i]) for i in used])
    found, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), size)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(used), len(used)), np.float32)
    width = max(1, 4_000_000 // len(used))  # columns at a time
    for lo in range(0, len(found), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(used), min(width, len(found) - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        shared += part @ part.T
    return shared[place[:, 0], place[:, 1]].astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for rows, bounds in whole_groups(batches):
        node, mine = rows.column("node").to_numpy(), rows.column("mine").to_numpy()
        copies = rows.column("copies").to_numpy()
        cross = rows.column("cross").to_numpy(zero_copy_only=False)
        out: list[tuple[int, int | None, int]] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            # one row for each node: a text stored several times comes several times
            _, first = np.unique(node[lo:hi], return_index=True)
            part = rows.slice(lo, hi - lo).take(pa.array(first))
            ids, weight = node[lo:hi][first], copies[lo:hi][first]
            values = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u2").reshape(-1, VALUES)
            a, b = _sides(mine[lo:hi][first], cross[lo])
            if not len(a) or not len(b):
                continue
            pairs = survivors(values[a], values[b], not cross[lo])
            if not len(pairs):
                continue
            pairs = np.column_stack([a[pairs[:, 0]], b[pairs[:, 1]]])
            sets = [np.frombuffer(s, "<u8") for s in part.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            shared = overlap_counts(sets, pairs)
            union = size[pairs[:, 0]] + size[pairs[:, 1]] - shared
            pairs = pairs[shared >= THRESHOLD * union - 1e-9]
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, pairs[:, 0], weight[pairs[:, 1]])
            np.add.at(links, pairs[:, 1], weight[pairs[:, 0]])
            out += [(int(ids[i]), None, int(links[i])) for i in np.flatnonzero(links)]
            out += [(int(ids[x]), int(ids[y]), 0) for x, y in forest(len(ids), pairs)]
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["u", "v", "links"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        names = [n if n != "text" else "shingles" for n in batch.schema.names]
        for t in slices(batch.column(at)):
            columns = [batch.column(i).slice(t.lo, t.hi - t.lo) for i in range(batch.num_columns)]
            columns[at] = pa.array([s.astype("<u8").tobytes() for s in shingles(t)], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)


def _same(a: Column, b: Column) -> Column:
    """Equality that holds for nulls, as two keys a join can be partitioned by."""
    return (_known(a) == _known(b)) & (F.isnull(a) == F.isnull(b))


def _known(a: Column) -> Column:
    """An id of any type as text, a null as an empty one."""
    return F.coalesce(a.cast("string"), F.lit(""))


def node_table(signed: DataFrame) -> DataFrame:
    """A row for each node: copies, the first document (least id) and its text, size, signature and bands."""
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")
    nodes = signed.groupBy("node").agg(
        F.count("*").alias("copies"),
        F.min(order).alias("least"),
        F.first("size").alias("size"),
        F.first("signature").alias("signature"),
        F.first("bands").alias("bands"),
    )
    return nodes.select("node", "copies", "least", "size", "signature", "bands")


def links_and_classes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label and links of the nodes that are linked to another."""
    groups = candidate_groups(nodes)
    grouped = groups.join(nodes.select("node", "copies", "least", "size", "signature"), "node")
    blocks = F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).alias("parts")
    weight = groups.join(nodes.select("node", "size"), "node").groupBy("label").agg(blocks)
    grouped = grouped.join(weight, "label")
    texts = _keyed(docs)
    chosen = _same(texts["doc_id"], grouped["least.doc_id"]) & (texts["text_hash"] == grouped["least.text_hash"])
    found = grouped.join(texts, chosen).select("label", "parts", "node", "copies", "signature", "text")
    sets = found.mapInArrow(_sets, "label long, parts long, node long, copies long, signature binary, shingles binary")
    pairs = _in_blocks(sets, ["label"], F.col("parts"), "node")
    pairs = pairs.select("g", "mine", "cross", "node", "copies", "signature", "shingles")
    results = pairs.repartition("g").sortWithinPartitions("g").mapInArrow(_verified, "u long, v long, links long")
    results = materialize(results, "links")
    counts = results.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(results.where("v IS NOT NULL").select("u", "v"))
    return classes.join(counts, "node", "left")


def _classed(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Every node with copies, links, and the first document of its class."""
    nodes = materialize(node_table(signed), "nodes")
    linked = links_and_classes(docs, nodes)
    labelled = nodes.select("node", "copies", "least").join(linked, "node", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    first = labelled.groupBy("label").agg(F.min("least").alias("first"))
    return labelled.join(first, "label").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of its class) and n_links (other documents at least that similar, copies too)."""
    signed = signatures(docs)
    classed = _classed(docs, signed)
    rows = signed.select("doc_id", "node").join(classed, "node")
    return rows.select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id, with its columns."""
    signed = signatures(docs)
    first = _classed(docs, signed).select("first").distinct()
    h = free("_text_hash", docs.columns)
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    none, known = free("_none", keyed.columns), free("_known", keyed.columns)
    keyed = keyed.withColumns({none: F.isnull("doc_id"), known: _known(F.col("doc_id"))})
    wanted = first.select(
        F.col("first.text_hash").alias(h),
        F.isnull("first.doc_id").alias(none),
        _known(F.col("first.doc_id")).alias(known),
    )
    kept = keyed.join(wanted, [h, none, known], "left_semi")
    return kept.dropDuplicates([h, none, known]).select(*docs.columns)
