"""Time-ordered operators per user that do not gather a user in one task.

A service account may own a third of all events, and a single hour may hold a third of its own.
Trailing counts cut each user's time line into cells that are worked on in parallel. The other
operators, and trailing counts where a cell is still too large, sort all rows into ranges of about
equal size and carry only what crosses the border of a range: a few numbers per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.session import materialize

MICROS = 1_000_000

DENSE_CELL_ROWS = 2_000_000  # rows of a cell that one task sorts with ease


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# --- rows in order -----------------------------------------------------------------------


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Sort all rows by ``order`` (nulls first) and add ``_part`` and ``_place`` within it.

    The sort cuts by sampled values of all order columns, so ranges stay about equal however
    often a key or a time repeats. The result is stored once: a task that is run again cannot
    number its rows differently.
    """
    columns = [F.col(c).asc_nulls_first() for c in order]
    ordered = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    # range number in the high bits, place in the low 33
    stored = materialize(ordered.withColumn("_ident", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_ident", 33)
    return stored.withColumns(
        {"_part": part, "_place": F.col("_ident") - F.shiftleft(part, 33)}
    ).drop("_ident")


def _by_part() -> Window:
    """Window over the table of ranges, which has one row per range."""
    return Window.orderBy("_part")


def _offsets(ordered: DataFrame, amount: Column) -> DataFrame:
    """(_part, _offset): the sum of ``amount`` over all earlier ranges."""
    sums = ordered.groupBy("_part").agg(amount.alias("_sum"))
    earlier = _by_part().rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))


# --- trailing counts ---------------------------------------------------------------------


def trailing_count(
    df: DataFrame,
    keys: DataFrame,
    key: str,
    ts: str,
    tiebreak: str,
    out: str,
    seconds: int = 3600,
    dense_cell_rows: int = DENSE_CELL_ROWS,
) -> DataFrame:
    """Rows of the same key in (ts - seconds, ts], rows at the same instant counting up one by one.

    ``keys`` are the (key, ts) pairs of ``df``, read narrowly; only the size of the cells is taken from them.

    Each row arrives at its time and leaves ``seconds`` later. Time is cut into cells as long as
    the window, so what is still counted at a row is: everything that leaves in the row's cell
    (all of the cell before) minus what has left so far plus what has arrived so far. That is one
    running sum per (key, cell): one shuffle, linear work, no sliding frame.

    Narrow passes with partial counts look for keys, then cells, of more than ``dense_cell_rows`` rows; if there are
    such cells, the running sum is taken over sorted ranges instead, with the same result. Arrivals and departures are made
    from the same row, so they always cancel.
    """
    span = seconds * MICROS

    def cell(t: Column) -> Column:
        return F.call_function("div", t - F.pmod(t, F.lit(span)), F.lit(span))

    # Columns that only travel are packed, so that a row that leaves carries one null, not many.
    others = [c for c in df.columns if c not in (key, ts, tiebreak)]
    packed = F.struct(*others) if others else F.lit(None).cast("int")
    arriving = micros(F.col(ts))
    nothing = F.when(F.lit(False), packed)
    arrives = F.struct(
        F.col(ts).alias(ts),
        F.col(tiebreak).alias(tiebreak),
        arriving.alias("_t"),
        F.when(F.col(ts).isNull(), 0).otherwise(1).alias("_step"),
        packed.alias("_others"),
    )
    leaves = F.struct(
        F.when(F.lit(False), F.col(ts)).alias(ts),
        F.when(F.lit(False), F.col(tiebreak)).alias(tiebreak),
        (arriving + F.lit(span)).alias("_t"),
        F.lit(-1).alias("_step"),
        nothing.alias("_others"),
    )
    both = F.when(F.col(ts).isNull(), F.array(arrives)).otherwise(F.array(arrives, leaves))
    steps = df.select(key, F.inline(both))

    cells = keys.select(key, cell(micros(F.col(ts))).alias("_c"))
    # a key of few rows has no cell of many, so most tables need no counts per cell
    if _has_more(cells.select(key), dense_cell_rows) and _has_more(cells, dense_cell_rows):
        counted = _running_over_ranges(steps, [key, "_t", "_step", tiebreak])
    else:
        counted = _running_over_cells(steps, key, cell, tiebreak)

    count = F.when(F.col(ts).isNull(), F.lit(0)).otherwise(F.col("_count")).alias(out)
    back = [F.col(c) if c in (key, ts, tiebreak) else F.col("_others")[c].alias(c) for c in df.columns]
    return counted.where("_step >= 0").select(*back, count)


def _running_over_cells(steps: DataFrame, key: str, cell, tiebreak: str) -> DataFrame:
    # rows without a time count nothing; they are only spread
    spread = -1 - F.pmod(F.xxhash64(tiebreak), F.lit(1024))
    celled = steps.withColumn("_cell", F.coalesce(cell(F.col("_t")), spread))
    celled = celled.repartition(key, "_cell")
    ordered = Window.partitionBy(key, "_cell").orderBy("_t", "_step", tiebreak)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.count_if(F.col("_step") == -1).over(whole)
    return celled.withColumn("_count", F.sum("_step").over(so_far) + base)


def _has_more(rows: DataFrame, limit: int) -> bool:
    """Whether any row comes more than ``limit`` times; counted map-side first."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    return not counts.where(F.col("_n") > limit).isEmpty()


def _running_over_ranges(steps: DataFrame, order: list[str]) -> DataFrame:
    """The running sum over all rows sorted by key and time.

    All rows of a key that arrive also leave, so the sum is zero between keys and needs no restart.
    """
    ordered = in_order(steps, order)
    offsets = _offsets(ordered, F.sum("_step"))
    so_far = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    joined = ordered.join(F.broadcast(offsets), "_part")
    return joined.withColumn("_count", F.sum("_step").over(so_far) + F.col("_offset"))


# --- positions and look-back -------------------------------------------------------------


def sequence_by_time(
    df: DataFrame, ts: str, tiebreak: list[str], out: str = "seq", restart: str | None = None
) -> DataFrame:
    """Positions 0..n-1 in time order; ``restart`` ("day", "month", ...) begins anew per period."""
    ordered = in_order(df, [ts, *tiebreak])
    numbered = ordered.join(F.broadcast(_offsets(ordered, F.count("*"))), "_part")
    seq = F.col("_place") + F.col("_offset")
    if restart:
        period = F.date_trunc(restart, F.col(ts).cast("timestamp"))
        numbered = numbered.withColumns({"_period": period, "_seq": seq})
        starts = numbered.groupBy(F.col("_period").alias("_p")).agg(F.min("_seq").alias("_start"))
        same = F.col("_period").eqNullSafe(F.col("_p"))
        numbered = numbered.join(F.broadcast(starts), same)  # one row per period of the calendar
        seq = F.col("_seq") - F.col("_start")
    return numbered.select(*df.columns, seq.alias(out))


def previous_values(
    df: DataFrame, key: str, ts: str, tiebreak: str, value: str, depth: int
) -> DataFrame:
    """Add ``prev_1`` .. ``prev_depth``: the value of the key's rows before this one.

    Within a range this is ``lag``. The first rows of a range continue with the last ``depth``
    rows of the ranges before it. A row of another key ends the look-back.
    """
    ordered = in_order(df, [key, ts, tiebreak])
    item = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    sizes = ordered.groupBy("_part").agg(F.max("_place").alias("_last"))
    tails = (
        ordered.join(F.broadcast(sizes), "_part")
        .where(F.col("_place") > F.col("_last") - depth)
        .groupBy("_part")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_place")).alias("o"), item.alias("e")))).alias("_tail"))
    )
    # newest first; any ``depth`` ranges hold at least ``depth`` rows between them
    none = F.array().cast(tails.schema["_tail"].dataType)
    older = [F.coalesce(F.lag("_tail", i).over(_by_part()), none) for i in range(1, depth + 1)]
    carried = tails.select("_part", F.slice(F.concat(*older), 1, depth).alias("_carry"))

    here = Window.partitionBy("_part").orderBy("_place")
    looked = ordered.withColumns({f"_lag{i}": F.lag(item, i).over(here) for i in range(1, depth + 1)})
    looked = looked.join(F.broadcast(carried), "_part", "left")

    def back(i: int) -> Column:
        before = F.get(F.col("_carry"), F.lit(i - 1) - F.col("_place"))["e"]
        found = F.when(F.col("_place") >= i, F.col(f"_lag{i}")).otherwise(before)
        return F.when(found["k"].eqNullSafe(F.col(key)), found["v"]).alias(f"prev_{i}")

    return looked.select(*df.columns, *[back(i) for i in range(1, depth + 1)])


def last_before(df: DataFrame, marks: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    """Add ``out``: the time of the latest mark of the same key at or before each row.

    ``marks`` holds (key, ts). Rows and marks are merged in time order; a range whose first key
    began in an earlier range starts with that key's latest mark. No pair of row and mark is formed.
    """
    at = F.col(ts).cast("timestamp")
    rows = df.withColumns({"_at": at, "_mark": F.lit(None).cast("timestamp"), "_row": F.lit(1)})
    seen = marks.select(key, at.alias("_at"), at.alias("_mark"), F.lit(0).alias("_row"))
    ordered = in_order(rows.unionByName(seen, allowMissingColumns=True), [key, "_at", "_row"])

    per_key = ordered.groupBy("_part", key).agg(
        F.min("_place").alias("_from"), F.max("_mark").alias("_latest")
    )
    ends = per_key.groupBy("_part").agg(
        F.min_by(key, "_from").alias("_first"),
        F.max_by(key, "_from").alias("_last"),
        F.max_by("_latest", "_from").alias("_latest"),
    )
    # one row per range; ranges that end in the same key follow one another
    same_end = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_upto", F.max("_latest").over(same_end))
    prior_key, prior = F.lag("_last").over(_by_part()), F.lag("_upto").over(_by_part())
    continues = prior_key.eqNullSafe(F.col("_first")) & prior.isNotNull()
    carried = ends.select("_part", "_first", F.when(continues, prior).alias("_carry"))

    so_far = Window.partitionBy("_part", key).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    running = ordered.withColumn("_here", F.max("_mark").over(so_far)).where("_row = 1")
    joined = running.join(F.broadcast(carried), "_part")
    carry = F.when(F.col(key).eqNullSafe(F.col("_first")), F.col("_carry"))
    return joined.select(*df.columns, F.coalesce("_here", carry).alias(out))


# --- sessions ----------------------------------------------------------------------------


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions per user: runs of events with no pause of ``gap_minutes`` or more.

    Events are first combined per minute; events of one minute always share a session when the
    gap is longer than a minute, so the result is exact and the window sees minutes, not events.
    """
    minutes = (
        df.groupBy(key, F.date_trunc("minute", F.col(ts).cast("timestamp")).alias("_minute"))
        .agg(
            F.min(F.col(ts).cast("timestamp")).alias("_from"),
            F.max(F.col(ts).cast("timestamp")).alias("_to"),
            F.count("*").alias("_n"),
        )
    )
    order = Window.partitionBy(key).orderBy("_minute")
    pause = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(order))
    opens = (pause.isNull() | (pause >= gap_minutes * 60 * MICROS)).cast("int")
    marked = minutes.withColumn("_open", opens).withColumn("_session", F.sum("_open").over(order))
    return (
        marked.groupBy(key, "_session")
        .agg(
            F.min("_from").alias("session_start"),
            F.max("_to").alias("last_event"),
            F.sum("_n").alias("events"),
        )
        .drop("_session")
    )
