"""Payment events -> subscription state.

Rules: only ``charge.completed`` events count; an unknown transaction reference
(no subscription) is ignored; a redelivered transaction counts once; success on
an active, unexpired subscription extends its expiry by 30 days, otherwise
starts a new 30-day term; a failure marks the subscription past due; five days
past due downgrades it to Starter. A term that ends without a payment ends the
subscription. All times are event times.

Events may come in any order and in any split over micro-batches. They wait in
a list state until the watermark has passed them, and are then taken in the
order of (event time, transaction), with the deadlines between them, so the
result does not depend on the batches. Event-time timers fire for the next
waiting event, the end of the grace period and the end of the term. State goes
when nothing waits and no term or grace period runs: it is bounded by the
subscriptions that are running, and by the events within the watermark's delay.

State is kept in RocksDB and survives restarts through the checkpoint. Subscriptions
share a grouping key in blocks (:class:`SubscriptionBlocks`): a timer, a state call and an
Arrow batch serve a block, where one state a subscription (:class:`Subscriptions`) pays
some 25 state calls for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
TERM_MS = 30 * DAY_MS
GRACE_MS = 5 * DAY_MS

# Times travel as whole milliseconds: a row costs no conversion in the Python worker.
OUTPUT_SCHEMA = T.StructType([
    T.StructField("subscription_id", T.IntegerType()), T.StructField("ms", T.LongType()),
    T.StructField("transaction_id", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("plan", T.StringType()), T.StructField("expiry_ms", T.LongType())])
WAITING_SCHEMA = T.StructType([
    T.StructField("ms", T.LongType()), T.StructField("transaction_id", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("plan", T.StringType())])
STATE_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("plan", T.StringType()),
    T.StructField("expiry_ms", T.LongType()), T.StructField("past_due_ms", T.LongType())])
CHANGE = Row(*OUTPUT_SCHEMA.names)
NONE = ("none", "Starter", None, None)

# Subscriptions are dealt to so many blocks by a hash. It holds for the life of a checkpoint.
BLOCKS = 1024
PANDAS_TIMES = ("1678-01-01 00:00:00", "2262-01-01 00:00:00")
# A block's waiting events and running states, one Arrow stream a piece.
PACKED_SCHEMA = T.StructType([T.StructField("packed", T.BinaryType())])
WAITING = pa.schema([("subscription_id", pa.int64()), ("ms", pa.int64()), ("transaction_id", pa.int64()),
                     ("status", pa.string()), ("plan", pa.string())])
RUNNING = pa.schema([("subscription_id", pa.int64()), ("status", pa.string()), ("plan", pa.string()),
                     ("expiry_ms", pa.int64()), ("past_due_ms", pa.int64())])


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch payment events derived from ``orders``: one charge per order (status
    from the order status), every 17th order another event type, every 19th an
    unknown reference, every 13th delivered twice."""
    from bizlens.plans.views import table
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ev = o.select(
        F.when(k % 17 == 0, "transfer.completed").otherwise("charge.completed").alias("event"),
        k.alias("transaction_id"),
        F.when(k % 19 == 0, F.concat(F.lit("unknown-"), k.cast("string")))
        .otherwise(F.concat(F.lit("tx-"), k.cast("string"))).alias("tx_ref"),
        F.when(F.col("o_orderstatus") == "F", "successful").when(F.col("o_orderstatus") == "P", "failed")
        .otherwise("pending").alias("status"),
        (F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=(k % 86400).cast("int"))).alias("event_time"))
    return ev.unionByName(ev.filter(k % 13 == 0))


def write_in_files(events: DataFrame, path: str, files: int) -> None:
    """Write ``events`` as ``files`` Parquet files in the order of time, as a source
    that appends would leave them: modification times follow the order of the files,
    whichever was written last."""
    spark = events.sparkSession
    events.repartitionByRange(files, "event_time").write.parquet(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")),
                   key=lambda f: f.getPath().getName())
    first = min((f.getModificationTime() for f in parts), default=0)
    for k, f in enumerate(parts):
        fs.setTimes(f.getPath(), first - 1000 * (len(parts) - k), -1)


def apply_events(state: tuple, events: list[tuple], upto: int) -> tuple[tuple, list[tuple]]:
    """The state after ``events`` (ms, transaction, status, plan; in order) and all
    deadlines up to ``upto``, and the rows (ms, transaction, status, plan, expiry) of its changes."""
    rows = []
    status, plan, expiry, past_due = state

    def deadline(ms: int) -> None:
        nonlocal status, plan, expiry, past_due
        if status == "past_due" and past_due + GRACE_MS <= ms:
            rows.append((past_due + GRACE_MS, None, "expired", "Starter", None))
            status, plan, expiry, past_due = NONE
        elif status == "active" and expiry <= ms:
            status, plan, expiry, past_due = NONE

    for ms, transaction, result, paid_plan in events:
        deadline(ms)
        if result == "successful":
            expiry = (expiry if status == "active" else ms) + TERM_MS
            status, plan, past_due = "active", paid_plan, None
        else:
            past_due = past_due if status == "past_due" else ms
            status = "past_due"
        rows.append((ms, transaction, status, plan, expiry))
    deadline(upto)
    return (status, plan, expiry, past_due), rows


def end_of(state: tuple) -> int | None:
    """When a running term or grace period ends."""
    status, _, expiry, past_due = state
    return past_due + GRACE_MS if status == "past_due" else expiry if status == "active" else None


def packed(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def unpacked(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def rows_of(t: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pandas(integer_object_nulls=True).tolist() for c in t.columns))


class Subscriptions(StatefulProcessor):
    """The waiting events and the state of one subscription."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING_SCHEMA)
        self.state = handle.getValueState("state", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.ms, r.transaction_id, r.status, r.plan) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(ms for ms, *_ in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = int(timerValues.getCurrentWatermarkInMs())
        every = sorted({tuple(r) for r in self.waiting.get()})  # a redelivered event is the same tuple
        due, later = [e for e in every if e[0] <= upto], [e for e in every if e[0] > upto]
        before = self.state.get() or NONE
        state, rows = apply_events(before, due, upto)
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if state != before:
            if state == NONE:
                self.state.clear()
            else:
                self.state.update(state)
        # a second timer of the same watermark finds nothing due: what it would set stands already
        if due or state != before:
            ends = [end for end in [end_of(state)] if end is not None]
            if later or ends:
                self.handle.registerTimer(min([e[0] for e in later[:1]] + ends))
        return iter([CHANGE(key[0], *r) for r in rows])

    def close(self) -> None:
        pass


class SubscriptionBlocks(StatefulProcessor):
    """The waiting events and the running states of a block of subscriptions. Ids come as text:
    pandas has no integers beside nulls."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED_SCHEMA)
        self.running = handle.getValueState("running", PACKED_SCHEMA)
        self.done: set[tuple] = set()  # (block, watermark)

    def _wake(self, times: list[int]) -> None:
        if times:  # a timer fires when the watermark is above it; what is due at the watermark is taken too
            self.handle.registerTimer(min(times) - 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for pdf in rows:
            t = pa.table([pa.array(pdf[f.name], pa.int64() if f.name == "ms" else pa.string(), from_pandas=True).cast(f.type)
                          for f in WAITING], schema=WAITING)
            self.waiting.appendValue((packed(t),))
            first.append(pc.min(t["ms"]).as_py())
        self._wake(first)
        self.done.clear()
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = int(timerValues.getCurrentWatermarkInMs())
        if (key, upto) in self.done:  # a second timer of the same watermark
            return
        self.done.add((key, upto))
        every = pa.concat_tables([WAITING.empty_table(), *(unpacked(b) for (b,) in self.waiting.get())])
        due, later = every.filter(pc.less_equal(every["ms"], upto)), every.filter(pc.greater(every["ms"], upto))
        before = self.running.get()
        states = {sub: tuple(state) for sub, *state in rows_of(unpacked(before[0]))} if before else {}
        ended = [sub for sub, state in states.items() if end_of(state) <= upto]
        changes = []

        def change(sub: int | None, events: list[tuple]) -> None:
            state, rows = apply_events(states.pop(sub, NONE), events, upto)
            if state != NONE:
                states[sub] = state
            changes.extend((sub, *r) for r in rows)

        for sub, events in groupby(rows_of(due.sort_by([(c, "ascending") for c in WAITING.names])), itemgetter(0)):
            change(sub, [e[1:] for e, _ in groupby(events)])  # a redelivered event is the same tuple
        for sub in ended:
            if sub in states:
                change(sub, [])
        if due.num_rows:
            if later.num_rows:
                self.waiting.put([(packed(later),)])
            else:
                self.waiting.clear()
        if due.num_rows or ended:
            if states:
                columns = zip(*((sub, *state) for sub, state in states.items()))
                self.running.update((packed(pa.table([pa.array(c, f.type) for c, f in zip(columns, RUNNING)], schema=RUNNING)),))
            elif before:
                self.running.clear()
        self._wake([pc.min(later["ms"]).as_py()] * (later.num_rows > 0) + [end_of(state) for state in states.values()])
        if changes:
            yield pd.DataFrame(changes, columns=OUTPUT_SCHEMA.names, dtype=object)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The state store that ``transformWithState`` needs, for queries started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def subscription_state(events: DataFrame, subscriptions: DataFrame, *, watermark: str = "1 day",
                       blocks: int | None = BLOCKS) -> DataFrame:
    """W1 on a stream: one output row per state change, final when it is emitted.
    Start it inside :func:`rocksdb_state`. ``blocks`` None keeps a state a subscription."""
    subs = subscriptions.select(F.col("tx_ref"), F.col("user_tenant_id").alias("subscription_id"), "plan")
    # A charge of any status moves the watermark: a test of the status alone would be moved below it.
    # One without a time is passed by no watermark.
    paid = F.col("status").isin("successful", "failed").cast("int") + F.col("event_time").isNotNull().cast("int") == 2
    e = (events.filter((F.col("event") == "charge.completed"))
         .withWatermark("event_time", watermark)
         .filter(paid)
         .join(subs, "tx_ref"))  # unknown references drop out here
    ms = F.unix_millis("event_time").alias("ms")
    if blocks is None:
        changes = e.select("subscription_id", "event_time", ms, "transaction_id", "status", "plan") \
            .groupBy("subscription_id").transformWithState(Subscriptions(), OUTPUT_SCHEMA, "Append", "EventTime")
    else:
        # The column by which Spark drops late events; pandas has no times beyond PANDAS_TIMES (past them nothing is late).
        low, high = (F.lit(t).cast("timestamp") for t in PANDAS_TIMES)
        time = F.when(F.col("event_time") <= high, F.greatest("event_time", low)) \
            .alias("event_time", metadata=e.schema["event_time"].metadata)
        block = F.pmod(F.xxhash64("subscription_id"), F.lit(blocks)).cast("int").alias("block")
        changes = e.select(block, F.col("subscription_id").cast("string").alias("subscription_id"), time, ms,
                           F.col("transaction_id").cast("string").alias("transaction_id"), "status", "plan") \
            .groupBy("block").transformWithStateInPandas(SubscriptionBlocks(), OUTPUT_SCHEMA, "Append", "EventTime")
    return changes.select("subscription_id", F.timestamp_millis("ms").alias("event_time"), "transaction_id", "status", "plan",
                          F.timestamp_millis("expiry_ms").alias("expiry"))
