"""W1 in blocks of subscriptions, and its files in the order of time."""

import datetime as dt
import os
from itertools import groupby

import numpy as np
import pandas as pd
import pytest

from bizlens.streaming import payments as WP

SCHEMA = "event string, transaction_id long, tx_ref string, status string, event_time timestamp"
UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)


def _changes(spark, folder, files, subs, **kw):
    """What W1 tells of ``files`` (rows of SCHEMA), a micro-batch each."""
    from bizlens.streaming import kpis as WS
    src = os.path.join(folder, "events")
    os.makedirs(src)
    for k, rows in enumerate(files):
        f = os.path.join(src, f"{len(files) - k}.parquet")
        pdf = pd.DataFrame(rows, columns=["event", "transaction_id", "tx_ref", "status", "event_time"])
        pdf["transaction_id"] = pdf["transaction_id"].astype("Int64")
        pdf["event_time"] = pd.Series([r[4] for r in rows], dtype="datetime64[us, UTC]")
        pdf.to_parquet(f, index=False)
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    s = spark.createDataFrame(subs, "tx_ref string, user_tenant_id int, plan string")
    with WP.rocksdb_state(spark):
        out = WS.run_available(WP.subscription_state(stream, s, **kw), kind="pay").collect()
    millis = lambda t: None if t is None else round(t.replace(tzinfo=t.tzinfo or UTC).timestamp() * 1000)
    return sorted(((r.subscription_id, millis(r.event_time), r.transaction_id, r.status, r.plan, millis(r.expiry)) for r in out), key=str)


def _told(files, subs):
    """The same by the rules, a subscription at a time."""
    rows = [r for f in files for r in f if r[0] == "charge.completed" and r[4] is not None]
    upto = round(max(r[4].timestamp() for r in rows) * 1000) - WP.DAY_MS
    events = {(sub, round(t.timestamp() * 1000), tx, status, plan) for _, tx, ref, status, t in rows if status in ("successful", "failed")
              for key, sub, plan in subs if key == ref}
    order = sorted((e for e in events if e[1] <= upto), key=lambda e: (str(e[0]), e[1], str(e[2])))
    return sorted(((sub, *c) for sub, g in groupby(order, lambda e: e[0])
                   for c in WP.apply_events(WP.NONE, [e[1:] for e in g], upto)[1]), key=str)


def _files(n=400):
    rng = np.random.default_rng(7)
    subs = [(f"tx-{k}", None if k % 29 == 0 else int(k % 23) * 1000, ["Agency", "Enterprise", None][k % 3]) for k in range(n)]
    rows = [("transfer.completed" if k % 17 == 0 else "charge.completed", k, f"tx-{k}" if k % 19 else f"unknown-{k}",
             ["successful", "failed", "pending"][int(rng.integers(0, 7)) // 3], START + dt.timedelta(seconds=int(rng.integers(0, 300 * 86400))))
            for k in range(n)]
    rows += rows[::13]  # redelivered
    rows += [("charge.completed", None, "tx-5", "successful", START + dt.timedelta(days=20, seconds=k)) for k in range(2)]
    rows.sort(key=lambda r: r[4])
    return [rows[:120], rows[120:150], rows[150:]], subs


@pytest.mark.parametrize("blocks", [None, 1, 7])
def test_blocks_give_the_changes_of_every_subscription(spark, tmp_dir, blocks):
    files, subs = _files()
    want = _told(files, subs)
    assert len(want) > 200 and any(r[3] == "expired" for r in want) and any(r[0] is None for r in want)
    assert _changes(spark, tmp_dir, files, subs, blocks=blocks) == want


def test_blocks_of_odd_times(spark, tmp_dir):
    """An event at the last watermark counts; one without a time never comes; times beyond those of pandas do."""
    far = dt.datetime(9999, 6, 1, tzinfo=UTC)
    subs = [("a", 1, "Agency"), ("b", 2, "Agency"), ("c", 3, "Agency"), ("d", 4, "Agency"), ("e", 5, "Agency")]
    files = [[("charge.completed", 1, "a", "successful", START), ("charge.completed", 2, "b", "failed", None)],
             [("charge.completed", 3, "c", "successful", far - dt.timedelta(days=3)),
              ("charge.completed", 4, "d", "failed", far - dt.timedelta(days=1)), ("charge.completed", 5, "e", "failed", far)]]
    want = _told(files, subs)
    assert {r[0] for r in want} == {1, 3, 4}
    assert _changes(spark, tmp_dir, files, subs) == want


@pytest.mark.parametrize("blocks", [None, 3])
def test_late_events_are_dropped_with_blocks_too(spark, tmp_dir, blocks):
    day = lambda n: START + dt.timedelta(days=n)
    subs = [("a", 1, "Agency"), ("b", 1, "Agency"), ("c", 2, "Agency"), ("z", 9, "Agency")]
    files = [[("charge.completed", 1, "a", "successful", day(100))], [("charge.completed", 2, "c", "successful", day(150))],
             [("charge.completed", 3, "b", "successful", day(50)), ("charge.completed", 4, "z", "successful", day(200))]]
    assert {r[2] for r in _changes(spark, tmp_dir, files, subs, blocks=blocks)} == {1, 2}


def test_charges_of_any_status_move_the_watermark(spark, tmp_dir):
    subs = [("a", 1, "Agency"), ("b", 2, "Agency")]
    files = [[("charge.completed", 1, "a", "successful", START), ("charge.completed", 2, "b", "pending", START + dt.timedelta(days=3))]]
    assert [r[2] for r in _changes(spark, tmp_dir, files, subs)] == [1]


def test_a_block_costs_few_state_calls_and_wakes_once_a_watermark():
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
    calls, timers = [], []

    class Kept:
        rows, row = [], None

        def get(self):
            calls.append("get")
            return iter(self.rows) if self is waiting else self.row

        def appendValue(self, v):
            calls.append("append")
            self.rows = [*self.rows, v]

        def put(self, v):
            calls.append("put")
            self.rows = v

        def update(self, v):
            calls.append("update")
            self.row = v

        def clear(self):
            calls.append("clear")
            self.rows, self.row = [], None

    waiting, running = Kept(), Kept()
    handle = type("Handle", (), {"getListState": lambda *_: waiting, "getValueState": lambda *_: running,
                                 "registerTimer": lambda _, ms: timers.append(ms)})()
    p = WP.SubscriptionBlocks()
    p.init(handle)
    n = 3000
    pdf = pd.DataFrame({"block": 1, "subscription_id": [str(k) for k in range(n)], "ms": range(1000, 1000 + n),
                        "transaction_id": [str(k) for k in range(n)], "status": "successful", "plan": "Agency"})
    assert not list(p.handleInputRows((1,), iter([pdf[:2000], pdf[2000:]]), TimerValues(-1, 0)))
    assert calls == ["append", "append"] and timers == [999]
    calls.clear()
    upto = 1000 + n - 2  # the last event waits on
    out = list(p.handleExpiredTimer((1,), TimerValues(-1, upto), ExpiredTimerInfo(999)))
    assert sum(len(x) for x in out) == n - 1 and list(out[0].iloc[0]) == [0, 1000, 0, "active", "Agency", 1000 + WP.TERM_MS]
    assert calls == ["get", "get", "put", "update"] and timers == [999, upto]
    calls.clear()
    assert not list(p.handleExpiredTimer((1,), TimerValues(-1, upto), ExpiredTimerInfo(1500))) and not calls
    assert sum(len(x) for x in p.handleExpiredTimer((1,), TimerValues(-1, 10**13), ExpiredTimerInfo(upto))) == 1
    assert not waiting.rows and running.row is None  # all terms ended


def test_files_keep_the_order_of_time_whichever_was_written_last(spark, tmp_dir, monkeypatch):
    from pyspark.sql import DataFrameWriter
    real, src = DataFrameWriter.parquet, os.path.join(tmp_dir, "src")

    def slow_first(self, path, *a, **k):
        real(self, path, *a, **k)
        for n, f in enumerate(sorted(f for f in os.listdir(path) if f.startswith("part-"))):
            os.utime(os.path.join(path, f), (1_700_000_000 - 60 * n,) * 2)  # the first was done a minute after the next

    monkeypatch.setattr(DataFrameWriter, "parquet", slow_first)
    ev = spark.range(300).selectExpr("id", "timestamp_seconds(id * 86400) AS event_time")
    WP.write_in_files(ev, src, 3)
    files = sorted((f for f in os.listdir(src) if f.startswith("part-")), key=lambda f: os.path.getmtime(os.path.join(src, f)))
    firsts = [pd.read_parquet(os.path.join(src, f))["id"].min() for f in files]
    assert len(files) == 3 and firsts == sorted(firsts)
