"""Exact interpolated quantiles that never sort or hold a whole group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a bounded sketch
first brackets each quantile between two values; a second pass counts the rows around the brackets
and only the few values inside them are tallied. The result equals ``percentile`` exactly.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.operators.joins import join_statistics

ACCURACY = 2_000  # of the sketch over a whole column: brackets hold about 0.4 % of the rows
GROUP_ACCURACY = 20_000  # of the sketches per key, whose brackets are not narrowed again
INSIDE_ROWS = 20_000_000  # a slot with more rows is bracketed again


def _edge_probs(probs: list[float], accuracy: int) -> list[float]:
    """Two sketch probabilities per quantile, a little below and above it."""
    slack = 4 / accuracy
    return [e for p in probs for e in (max(p - slack, 0.0), min(p + slack, 1.0))]


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """One row (feature, q, value) per column and quantile of the whole table."""
    rows = whole_quantiles(df, columns, probs)
    return df.sparkSession.createDataFrame(rows, "feature string, q double, value double")


def exact_quantile(df: DataFrame, column: str, prob: float) -> float | None:
    """A single quantile of a whole column."""
    return whole_quantiles(df, [column], [prob])[0][2]


def whole_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> list[tuple]:
    """(column, probability, value) triples."""
    src = df.select(*[F.col(c).cast("double").alias(c) for c in columns])

    def neighbours(n: int) -> set[int]:
        return {f(p * (n - 1)) for p in probs for f in (floor, ceil)}

    totals, values = _values_at(src, columns, probs, neighbours)
    rows = []
    for i, c in enumerate(columns):
        for p in probs:
            value = None
            if i in totals:
                place = p * (totals[i] - 1)
                low, high = values[i, floor(place)], values[i, ceil(place)]
                value = low + (high - low) * (place - floor(place))
            rows.append((c, p, value))
    return rows


def _values_at(src: DataFrame, columns: list[str], probs: list[float], places_for) -> tuple[dict, dict]:
    """Rows per column, and the value at each place (0-based rank) that ``places_for(rows)`` names.

    Each pass ends in a few numbers per column: the sketch's edges near ``probs``; counts, minima
    and maxima of the slots that the edges cut a column into; and, for a place strictly inside a
    slot, the running counts of that slot's values, or the same again if the slot is still large.
    """
    edges = _sketch_edges(src, columns, probs)
    slots = _slot_counts(src, columns, edges)
    totals = {i: sum(r["n"] for r in rows) for i, rows in slots.items()}
    values: dict[tuple[int, int], float] = {}
    small: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, rows in slots.items():
        before = 0
        for row in rows:
            asked = [p for p in places_for(totals[i]) if before <= p < before + row["n"]]
            inside = []
            for place in asked:
                if place == before or row["lo"] == row["hi"]:
                    values[i, place] = row["lo"]
                elif place == before + row["n"] - 1:
                    values[i, place] = row["hi"]
                else:
                    inside.append(place - before)
            if inside and not 0 < row["s"] < 2 * len(edges[i]):
                raise RuntimeError("a quantile lies outside its bracket")
            if inside and row["n"] > INSIDE_ROWS:
                v, (low, high) = F.col(columns[i]), _bounds(edges[i], row["s"])
                part = src.select(columns[i]).where((v > low) & (v < high))
                near = [offset / (row["n"] - 1) for offset in inside]
                _, found = _values_at(part, [columns[i]], near, lambda n, at=inside: at)
                values.update({(i, before + offset): x for (_, offset), x in found.items()})
            elif inside:
                small[i, row["s"]] = [(before + offset, offset) for offset in inside]
            before += row["n"]
    if small:
        values.update(_places_inside(src, columns, edges, small))
    return totals, values


def _bounds(edges: list[float], slot: int) -> tuple[float, float]:
    """The two edges around an inner slot."""
    return edges[slot // 2 - 1], edges[slot // 2]


def _sketch_edges(src: DataFrame, columns: list[str], probs: list[float]) -> list[list[float]]:
    wanted = _edge_probs(probs, ACCURACY)
    sketches = [F.percentile_approx(c, wanted, ACCURACY).alias(f"_{i}") for i, c in enumerate(columns)]
    return [sorted(set(found or [])) for found in src.agg(*sketches).head()]


def _slot_counts(src: DataFrame, columns: list[str], edges: list[list[float]]) -> dict[int, list]:
    """Per column its non-empty slots in order. Slot 2k + 1 is the k-th edge, 2k lies below it.

    Columns become rows first and their edges are joined to them (one row per column), so the
    generated code stays small enough to be compiled.
    """
    width = max(map(len, edges))
    names = [f"e{j}" for j in range(width)]
    padded = [(i, *e, *[None] * (width - len(e))) for i, e in enumerate(edges)]
    table = src.sparkSession.createDataFrame(padded, "c int" + "".join(f", {n} double" for n in names))
    v = F.col("v")
    steps = [F.coalesce((v > F.col(n)).cast("int") + (v >= F.col(n)).cast("int"), F.lit(0)) for n in names]
    spread = src.select(F.posexplode(F.array(*columns)).alias("c", "v")).where("v IS NOT NULL")
    tally = (
        spread.join(F.broadcast(table), "c")
        .withColumn("s", sum(steps, F.lit(0)))
        .groupBy("c", "s")
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    slots: dict[int, list] = {}
    for row in sorted(tally.collect()):  # at most 4 x len(probs) + 1 rows per column
        slots.setdefault(row["c"], []).append(row)
    return slots


def _places_inside(src: DataFrame, columns: list[str], edges: list, inside: dict) -> dict:
    """Values at given places within slots; only rows of these slots are counted."""
    used = sorted({i for i, _ in inside})
    bounds = [(used.index(i), i, s, *_bounds(edges[i], s)) for i, s in inside]
    table = src.sparkSession.createDataFrame(bounds, "u int, c int, s int, low double, high double")
    spread = src.select(F.posexplode(F.array(*[columns[i] for i in used])).alias("u", "v"))
    kept = spread.join(F.broadcast(table), "u").where("v > low AND v < high")
    in_slot = lambda i, s: (F.col("c") == i) & (F.col("s") == s)
    counted = kept.groupBy("c", "s", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("c", "s").orderBy("v"))
    running = counted.withColumn("upto", upto)
    covers = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
    marks = [
        F.when(in_slot(i, s) & covers(offset), F.lit(place))
        for (i, s), asked in inside.items()
        for place, offset in asked
    ]
    hits = running.select("c", "v", F.explode(F.array_compact(F.array(*marks))).alias("place"))
    return {(r["c"], r["place"]): r["v"] for r in hits.collect()}


def exact_quantiles_by(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probs: list[float],
    rows_per_salt: int | None = None,
) -> DataFrame:
    """One row (keys, feature, q, value) per key, column and quantile.

    The brackets are per-key statistics joined to the rows; nothing is run on the way.
    """
    src = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    wanted = _edge_probs(probs, GROUP_ACCURACY)
    brackets = src.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        *[F.percentile_approx(c, wanted, GROUP_ACCURACY).alias(f"_edges_{i}") for i, c in enumerate(columns)],
    )
    rows = join_statistics(src, brackets, keys, "_rows", columns, rows_per_salt)
    edge = lambda i, j: F.get(F.col(f"_edges_{i}"), F.lit(j))

    cells = [(i, c, j, p) for i, c in enumerate(columns) for j, p in enumerate(probs)]
    low = lambda i, j: edge(i, 2 * j)
    high = lambda i, j: edge(i, 2 * j + 1)

    def tally(i: int, c: str, j: int, p: float) -> Column:
        v = F.col(c)
        lo, hi = low(i, j), high(i, j)
        return F.struct(
            F.lit(c).alias("feature"),
            F.lit(p).alias("q"),
            F.count(v).alias("n"),
            F.count_if(v < lo).alias("below"),
            F.count_if(v.between(lo, hi)).alias("inside"),
            F.max(F.when(v < lo, v)).alias("prev"),
            F.min(F.when(v > hi, v)).alias("next"),
            F.max(lo).alias("lo"),
            F.max(hi).alias("hi"),
        )

    packed = rows.groupBy(*keys).agg(F.array(*[tally(*cell) for cell in cells]).alias("_cells"))
    counts = packed.select(*keys, F.inline("_cells"))
    pos = F.col("q") * (F.col("n") - 1)
    counts = counts.withColumns({"_pos": pos, "_i": F.floor(pos), "_k": F.ceil(pos)})

    def inside(i: int, c: str, j: int, p: float) -> Column:
        v = F.col(c)
        lo, hi = low(i, j), high(i, j)
        return F.when(
            (lo < hi) & v.between(lo, hi),
            F.struct(F.lit(c).alias("feature"), F.lit(p).alias("q"), v.alias("v")),
        )

    kept = rows.select(*keys, F.inline(F.array_compact(F.array(*[inside(*x) for x in cells]))))
    tallied = kept.groupBy(*keys, "feature", "q", "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys, "feature", "q").orderBy("v")
    cumulated = tallied.withColumn("upto", F.sum("c").over(order))
    on = [*keys, "feature", "q"]
    reach = F.col("upto") + F.col("below")
    steps = cumulated.join(counts.select(*on, "below", "_i", "_k"), on).groupBy(*on).agg(
        F.min(F.when(reach > F.col("_i"), F.col("v"))).alias("_vi"),
        F.min(F.when(reach > F.col("_k"), F.col("v"))).alias("_vk"),
    )
    resolved = counts.join(steps, on, "left")

    def at(position: Column, tallied_value: Column) -> Column:
        top = F.col("below") + F.col("inside")
        return (
            F.when(position == F.col("below") - 1, F.col("prev"))
            .when(position == top, F.col("next"))
            .when((position < F.col("below")) | (position > top), _out_of_bracket())
            .when(F.col("lo") == F.col("hi"), F.col("lo"))
            .otherwise(tallied_value)
        )

    vi, vk = at(F.col("_i"), F.col("_vi")), at(F.col("_k"), F.col("_vk"))
    part = F.col("_pos") - F.col("_i")
    value = F.when(F.col("_i") == F.col("_k"), vi).otherwise(vi + (vk - vi) * part)
    return resolved.select(*keys, "feature", "q", value.alias("value"))


def _out_of_bracket() -> Column:
    return F.raise_error(F.lit("quantile outside its bracket")).cast("double")
