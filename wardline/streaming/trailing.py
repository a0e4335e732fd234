"""The trailing count of a stream as exact state: late events revise what was counted before them.

State is kept per (bucket of users, hour), in the stream's own state store, so that a call of it serves many users; a
user is always in the same bucket. An event is sent to its own hour, where it is counted, and to the next one, where it
is only context (its other columns stay behind), so a count needs no other key and no look at the sink. A
micro-batch returns each new event with its count, and again each earlier event whose count a late arrival has
changed. An event-time timer drops an hour's events once the watermark has passed the end of the hour: from then
on no event of it can arrive. Events later than the watermark's delay are dropped, as by any stateful operator.

The sink is an append-only table of versions in folders by day and batch; a batch that is run again replaces its own
folder. ``current`` gives the latest version of each event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.joins import first_per_key

SECOND = 1_000_000  # of a time in microseconds
BUCKETS = 16  # of users: so many calls of the state at most serve an hour
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trailing_sizes(rows: list[tuple], span: int, of: int) -> Iterator[int]:
    """For each of the rows, sorted by user (at ``of``) and time, how many of its user up to it lie less than ``span`` before it."""
    low = 0
    for at, row in enumerate(rows):
        if row[of] != rows[low][of]:
            low = at
        while rows[low][0] <= row[0] - span:
            low += 1
        yield at + 1 - low


class TrailingHour(StatefulProcessor):
    """Events of some users' hour and of the hour before it; counts of the former."""

    def __init__(self, state: str, columns: list[str], key: str, out: str, span: int):
        self.state, self.columns, self.span, self.row = state, columns, span, Row(*columns, out)
        self.of = 3 + columns.index(key)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # (micros, tie, own, values)
        new = [(r["micros_"], r["tie_"], r["own_"], *(r[c] for c in self.columns)) for r in rows]
        if key[1] is None:  # without a time an event has no hour, and no other event counts it
            yield from (self.row(*r[3:], 0) for r in new)
            return
        users = {r[self.of] for r in new}  # the others' counts stay
        before = sorted((tuple(r) for r in self.held.get() if r[self.of] in users), key=self._place)
        self.held.appendList(new)
        self.handle.registerTimer((key[1] + 1) * self.span // 1000)
        known = {(r[self.of], r[1]): n for r, n in zip(before, trailing_sizes(before, self.span, self.of)) if r[2]}
        every = sorted(before + new, key=self._place)
        for r, n in zip(every, trailing_sizes(every, self.span, self.of)):
            if r[2] and known.get((r[self.of], r[1])) != n:
                yield self.row(*r[3:], n)

    def _place(self, row: tuple) -> tuple:
        user = row[self.of]
        return user is not None, user if user is not None else 0, row[0], row[1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def trailing_stream(
    stream: DataFrame, key: str, ts: str, tiebreak: str, out: str, delay: str = "1 hour", seconds: int = 3600,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rows of ``stream`` with ``out``, their trailing count, once for each change of it.

    ``tiebreak`` tells events apart and orders those of one instant. Needs the RocksDB state store. The state of an hour
    is read and worked on bucket by bucket; a checkpoint goes with its number of ``buckets``.
    """
    span = seconds * SECOND
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = stream.withWatermark(ts, delay).withColumn("own_", F.explode(F.array(F.lit(True), F.lit(False))))
    timed = timed.where(F.col("own_") | F.col(ts).isNotNull())
    cell = F.call_function("div", micros - F.pmod(micros, F.lit(span)), F.lit(span)) + F.when(F.col("own_"), 0).otherwise(1)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    timed = timed.withColumns({"bucket_": bucket, "cell_": cell, "micros_": micros, "tie_": F.col(tiebreak)})
    timed = timed.withColumns({c: F.when(F.col("own_"), F.col(c)) for c in stream.columns if c not in (key, ts)})
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    fields = [f"`{c}` {types[c]}" for c in stream.columns]
    state = ", ".join(["micros_ bigint", f"tie_ {types[tiebreak]}", "own_ boolean", *fields])
    return timed.groupBy("bucket_", "cell_").transformWithState(
        statefulProcessor=TrailingHour(state, stream.columns, key, out, span),
        outputStructType=", ".join([*fields, f"`{out}` bigint"]),
        outputMode="Update",
        timeMode="EventTime",
    )


def versions(
    stream: DataFrame,
    ts: str,
    out: str,
    checkpoint: str,
    available_now: bool = False,
    finish: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Write each micro-batch's rows, as ``finish`` makes them, to ``out`` as versions, by day and batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        placed = finish(batch).withColumns({"event_date": F.to_date(ts), "version": F.lit(batch_id)})
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("event_date", "version").parquet(out)

    writer = stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)  # read when the query starts
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(PROVIDER, before)


def current(spark: SparkSession, out: str, tiebreak: str) -> DataFrame:
    """The latest version of each event."""
    stored = spark.read.option("basePath", out).parquet(out)
    newest = first_per_key(stored.withColumn("_age", -F.col("version")), ["event_date", tiebreak], ["_age"])
    return newest.drop("_age", "event_date", "version")
