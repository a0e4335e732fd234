"""Merkle manifest of a table of documents: a tree of hashes per source, one over the sources, a proof per row.

A leaf is the SHA-256 of a row's fields. A source's leaves are ranked by doc_id and the rank is written in digits
of base 3. Rows are dealt to blocks of ``3 ** DIGITS`` ranks, and within a block one digit column after the other
is grouped away: each step gathers at most three child structs into their parent, whose hash is that of its
children. A block's root is a leaf of the next tier, until a source has one block; the sources' roots are ranked
and rolled up the same way. Proofs then go down tier by tier: a block takes the path from its root upwards by a
grouping with its parent's row, and nested ``transform`` and one ``explode`` give each leaf its path. No leaf is
ever joined to a node, and no group holds more than a block.

All of it is SQL functions. Ranks come from sorted ranges (``operators.windows.in_order``), so a source with any
share of the rows is never one task.

Defined results: a null field is ``-``, an empty one ``0:``; a null doc_id comes first in its source and a null
source first of all; rows with one doc_id are ordered by their leaf, so repeated rows are repeated, equal leaves;
a source with a single row has that leaf as its root, and a single source's root is the root of all; a leaf
without siblings has the empty proof; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.operators.windows import in_order
from wardline.session import materialize

ARITY = 3  # nodes that become one
DIGITS = 6  # levels within a block, so a block has at most 729 leaves

STEP = "struct<before:string,after:string>"  # siblings to the left and to the right, hex digests end to end


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """The hash of a document whose text is ``text``."""
    return digest(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text))


def _ceil_div(n: Column, by: int) -> Column:
    return F.call_function("div", n + F.lit(by - 1).cast("long"), F.lit(by).cast("long"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` among those of one ``k`` (from 0, by ``order``) and ``n``, their number."""
    ordered = in_order(rows, ["k", *order])
    runs = ordered.groupBy("k", "_part").agg(F.count("*").alias("_run"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "k",
        "_part",
        (F.coalesce(F.sum("_run").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_run").over(Window.partitionBy("k")).alias("n"),
    )
    placed = ordered.join(runs, ["k", "_part"]).withColumn("rank", F.col("_place") + F.col("_shift"))
    return placed.drop("_part", "_place", "_shift")


def roll_up(nodes: DataFrame, payload: list[str], digits: int) -> DataFrame:
    """k, n, block and tree: a struct of a hash and its kids for each block of ``ARITY ** digits`` ranks."""

    def digit(j: int) -> str:
        return f"d{j}"

    rank = F.col("rank")
    size = ARITY**digits
    block = F.call_function("div", rank, F.lit(size).cast("long"))
    ranks = {digit(j): F.call_function("div", rank % ARITY ** (j + 1), F.lit(ARITY**j)) for j in range(digits)}
    # "e" is what a kid carries, its own kids or, for a leaf, the payload; it lies in the place of the kid's rank
    at = F.struct("hash", F.struct(*payload).alias("e")) if payload else F.struct("hash", F.lit(0).alias("e"))
    now = nodes.withColumns({"block": block, **ranks, "node": at}).repartition("k", "block")
    for j in range(digits):
        keys = ["k", "n", "block", *map(digit, range(j + 1, digits))]
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit(j)).alias("d"), F.col("node.hash").alias("hash"), F.col("node.e").alias("e"))))
        grouped = now.groupBy(*keys).agg(kids.alias("kids"))
        together = digest(F.concat_ws("", F.col("kids.hash")))
        up = F.when(_is_level(j), together).otherwise(F.col("kids")[0]["hash"])
        now = grouped.select(*keys, F.struct(up.alias("hash"), F.col("kids").alias("e")).alias("node"))
    return now.select("k", "n", "block", F.col("node").alias("tree"))


def _is_level(j: int) -> Column:
    """Whether a group of ``n`` leaves still has several nodes ``j`` levels above them."""
    return F.col("n") > ARITY**j


def unroll(trees: DataFrame, digits: int, payload: list[str]) -> DataFrame:
    """A row for each leaf of ``trees``: k, rank, payload, the columns of ``above`` and the path from the leaf up."""

    def step(kids: Column, i: Column) -> Column:
        hashes = F.transform(kids, lambda x: x["hash"])
        before = F.concat_ws("", F.slice(hashes, F.lit(1), i))
        after = F.concat_ws("", F.slice(hashes, i + 2, F.lit(ARITY)))
        return F.struct(before.alias("before"), after.alias("after"))

    def leaves(kids: Column, j: int, path: Column, rank: Column) -> Column:
        def down(kid: Column, i: Column) -> Column:
            own = F.when(_is_level(j), F.concat(F.array(step(kids, i)), path)).otherwise(path)
            place = rank + kid["d"] * F.lit(ARITY**j).cast("long")
            if j:
                return leaves(kid["e"], j - 1, own, place)
            return F.array(F.struct(place.alias("rank"), kid["hash"].alias("hash"), kid["e"].alias("e"), own.alias("path")))

        return F.flatten(F.transform(kids, down))

    first = F.col("block") * F.lit(ARITY**digits).cast("long")
    each = leaves(F.col("tree.e"), digits - 1, F.col("above.path"), first)
    flat = trees.select("k", "above", F.explode(each).alias("leaf"))
    own = [F.col("leaf.e")[c].alias(c) for c in payload]
    return flat.select("k", F.col("leaf.rank").alias("rank"), F.col("leaf.hash").alias("hash"), *own, F.col("leaf.path").alias("path"), "above")


def _tiers(nodes: DataFrame, payload: list[str], digits: int) -> list[DataFrame]:
    """Stored trees, tier by tier, up to the one in which every ``k`` has a single block."""
    tiers = []
    while True:
        tiers.append(materialize(roll_up(nodes, payload, digits), f"tier{len(tiers)}"))
        if tiers[-1].where("block > 0").isEmpty():
            return tiers
        n = _ceil_div(F.col("n"), ARITY**digits)
        nodes, payload = tiers[-1].select("k", n.alias("n"), F.col("block").alias("rank"), F.col("tree.hash").alias("hash")), []


def _lifted(trees: DataFrame, above: DataFrame) -> DataFrame:
    """Trees with the row ``above`` (k, block, above) of the same block, by one grouping."""
    none = F.lit(None)
    kind = {f.name: f.dataType for f in (*trees.schema.fields, *above.schema.fields)}
    both = trees.select("k", "block", "n", "tree", none.cast(kind["above"]).alias("above")).unionByName(
        above.select("k", "block", none.cast("long").alias("n"), none.cast(kind["tree"]).alias("tree"), "above")
    )
    met = both.groupBy("k", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "above")])
    return met


def _down(tiers: list[DataFrame], above: DataFrame, payload: list[str], digits: int) -> DataFrame:
    """Leaves of the lowest tier with their paths; ``above`` has a row (k, block, above) for each top block."""
    for trees in reversed(tiers[1:]):
        nodes = unroll(_lifted(trees, above), digits, [])
        above = nodes.select("k", F.col("rank").alias("block"), F.col("above").withField("path", F.col("path")).alias("above"))
    return unroll(_lifted(tiers[0], above), digits, payload)


def manifest(rows: DataFrame, payload: list[str], digits: int = DIGITS) -> DataFrame:
    """Each leaf's path, and the roots.

    ``rows`` has source, doc_id, leaf and the columns of ``payload``; comes back with path, an array of (before,
    after) from the leaf to the root, subroot (the source's) and root. Group and tier are bounded by ``digits``.
    """
    # a null source sorts before every name
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    leaves = materialize(rows.select(key.alias("k"), "doc_id", F.col("leaf").alias("hash"), *payload), "leaves")
    carried = list(dict.fromkeys(["doc_id", *payload]))
    sources = _tiers(ranked(leaves, ["doc_id", "hash"]), carried, digits)
    tops = sources[-1].select(F.col("k").alias("of"), F.col("tree.hash").alias("hash"), F.lit("").alias("k"))
    whole = _tiers(ranked(tops, ["of"]), ["of"], digits)
    top = F.struct(F.array().cast(f"array<{STEP}>").alias("path"), F.lit("").alias("subroot"), F.col("tree.hash").alias("root"))
    by_source = _down(whole, whole[-1].select("k", "block", top.alias("above")), ["of"], digits)
    above = F.struct("path", F.col("hash").alias("subroot"), F.col("above.root").alias("root"))
    above = by_source.select(F.col("of").alias("k"), F.lit(0).cast("long").alias("block"), above.alias("above"))
    leaves = _down(sources, above, carried, digits)
    named = F.when(F.col("k") != "", F.expr("substring(k, 2)")).alias("source")
    return leaves.select(named, *carried, F.col("hash").alias("leaf"), "path", "above.subroot", "above.root")


def folded(leaf_hash: Column, path: Column) -> Column:
    """The root that ``leaf_hash`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf_hash, lambda h, s: digest(s["before"], h, s["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))))


def audit(docs: DataFrame, now: Column, digits: int = DIGITS) -> DataFrame:
    """The manifest of ``docs``, and whether each row still folds to the root if its text is ``now`` today."""
    changed = F.when(F.col("text").eqNullSafe(now), F.col("leaf")).otherwise(leaf(now))
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").withColumn("leaf", leaf(F.col("text")))
    proofs = manifest(rows.select("source", "doc_id", "leaf", changed.alias("current")), ["current"], digits)
    root = folded(F.col("current"), F.col("path"))
    shown = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """Texts as tampered with: newlines go where 2 divides the CRC-32 of the id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


LEVELS = 16  # of the SQL below: 3 ** 16 leaves


def _crc_table() -> list[int]:
    def entry(b: int) -> int:
        return reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(8), b)

    return [entry(b) for b in range(256)]


def _oracle() -> str:
    def up(nodes: str, levels: int) -> str:
        """Chained tables L0 .. of (g, i, h): a group's nodes by level."""
        out = []
        for j in range(levels):
            out.append(
                f"""{nodes}{j + 1} AS (
    SELECT g, i // 3 AS i, CASE WHEN max(n) > {3**j} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, max(n) AS n
    FROM {nodes}{j} GROUP BY g, i // 3)"""
            )
        return ",\n".join(out)

    def steps(nodes: str, alias: str, level: int) -> str:
        return f"""LEFT JOIN (
    SELECT x.g, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS b,
           coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS a
    FROM {nodes}{level} x JOIN {nodes}{level} y ON x.g = y.g AND x.i // 3 = y.i // 3 WHERE x.n > {3**level} GROUP BY ALL
  ) {alias}{level}"""

    parts = [f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    text = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"
    fields = " || ".join(parts)
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))"
    short = LEVELS // 2
    walk = "\n".join([f"  {steps('l', 'p', j)} ON p{j}.g = d.g AND p{j}.i = d.i // {3**j}" for j in range(LEVELS)] + [f"  {steps('s', 'q', j)} ON q{j}.i = o.i // {3**j}" for j in range(short)])
    proof = " || ".join([f"coalesce(p{j}.b || p{j}.a, '')" for j in range(LEVELS)] + [f"coalesce(q{j}.b || q{j}.a, '')" for j in range(short)])
    folds, last = [], "r0"
    at = [f"p{j}" for j in range(LEVELS)] + [f"q{j}" for j in range(short)]
    columns = ", ".join(f"{p}.b AS {p}b, {p}.a AS {p}a" for p in at)
    for j, p in enumerate(at):
        folds.append(f"r{j + 1} AS (SELECT * REPLACE (CASE WHEN {p}b IS NULL THEN cur ELSE sha256({p}b || cur || {p}a) END AS cur) FROM {last})")
        last = f"r{j + 1}"
    return f"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS t),
rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256({fields} || {text.format("text")}) AS h,
         CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN sha256({fields} || {text.format("replace(text, chr(10), '')")}) END AS c
  FROM documents, t),
d AS (
  SELECT doc_id, g, h, coalesce(c, h) AS c, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
         count(*) OVER (PARTITION BY g) AS n
  FROM rows),
l0 AS (SELECT g, i, h, n FROM d),
{up("l", LEVELS)},
o AS (SELECT g AS s, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM l{LEVELS}),
s0 AS (SELECT '' AS g, i, h, n FROM o),
{up("s", short)},
r0 AS (
  SELECT d.doc_id, d.h AS leaf, o.h AS subroot, z.h AS root, d.c AS cur, sha256({proof}) AS proof_sha256, {columns}
  FROM d JOIN o ON o.s = d.g CROSS JOIN s{short} z
{walk}),
{(","+chr(10)).join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, cur AS folded_root, cur = root AS verified FROM {last}"""


ORACLE = _oracle()
