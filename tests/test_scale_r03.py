"""Round 3 findings on size: what a query does again, holds or moves, on rows built here."""

import datetime as dt

import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables of the driver's schema, as far as the views read them."""
    d = str(tmp_path_factory.mktemp("tables"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")

    day = [dt.datetime(1997, 1 + k, 3 + k) for k in range(6)]
    put("region", [(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string")
    put("nation", [(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(k, k % 2, "AUTO", 10.0 * k) for k in range(1, 9)],
        "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    put("part", [(k, f"Brand#{k}", 5.0 + k) for k in range(4)], "p_partkey long, p_brand string, p_retailprice double")
    put("orders", [(k, 1 + k % 8, day[k % 6]) for k in range(60)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    put("lineitem", [(k % 60, k % 4, 1, 1.0 + k % 5, 100.0 + k, 0.01 * (k % 10), 0.02) for k in range(300)],
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    return d


def _plan(df, kind):
    return df._jdf.queryExecution().optimizedPlan().toString() if kind == "optimized" else df._jdf.queryExecution().executedPlan().toString()


def test_orders_meet_their_customers_before_lineitem(spark, tables):
    from bizlens.plans.views import business_view
    bv = business_view(spark, tables)
    top = next(line for line in _plan(bv, "optimized").splitlines() if "Join Inner" in line)
    assert "l_orderkey" in top and "o_orderkey" in top
    assert bv.count() == 300


@pytest.mark.parametrize("name", ["M2", "D2", "V1", "J1"])
def test_joined_rows_are_read_once(spark, tables, name):
    """What is left to run when the query returns no longer reads lineitem."""
    import __spark_entry__ as E
    df = E.queries()[name](spark, tables)
    assert "l_extendedprice" not in _plan(df, "optimized")
    assert df.count() > 0


def test_pieces_of_a_partition_give_the_same_neighbours_and_sums(spark, monkeypatch):
    from bizlens.plans import carry
    rows = [(k // 23, k, None if k % 3 or 23 <= k < 50 else float(k), k % 5) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, o int, x double, n long").coalesce(1)
    told = []
    for size in (10_000, 7):
        monkeypatch.setattr(carry, "PIECE", size)
        near = carry.neighbours(df, ["g"], ["o"], ["x"]).orderBy("o").collect()
        sums = carry.running_sums(carry.sorted_ranges(df, ["g"], ["o"]), ["g"], ["n"], next_of="o").orderBy("o").collect()
        told.append((near, [tuple(r[c] for c in ("g", "o", "cum_n", "next_o")) for r in sums]))
    assert told[0] == told[1]


def test_a_task_holds_a_piece_whatever_the_batches():
    import pyarrow as pa
    from bizlens.plans.carry import _pieces
    batches = [pa.RecordBatch.from_pydict({"__part": [3] * n, "v": list(range(n))}) for n in (5, 0, 11, 1)]
    got = list(_pieces(iter(batches), 4))
    assert [p for p, _ in got] == [(3, i) for i in range(5)] and [t.num_rows for _, t in got] == [4, 4, 4, 4, 1]


class _State:
    """The state of one key, counting the calls that reach the state store."""

    def __init__(self):
        self.list, self.value, self.timers, self.calls = [], None, [], 0

    def getListState(self, *_):
        outer = self

        class L:
            def get(self):
                outer.calls += 1
                return iter(outer.list)

            def put(self, rows):
                outer.calls, outer.list = outer.calls + 1, list(rows)

            def appendList(self, rows):
                outer.calls, outer.list = outer.calls + 1, outer.list + list(rows)

            def clear(self):
                outer.calls, outer.list = outer.calls + 1, []
        return L()

    def getValueState(self, *_):
        outer = self

        class S:
            def get(self):
                outer.calls += 1
                return outer.value

            def exists(self):
                outer.calls += 1
                return outer.value is not None

            def update(self, v):
                outer.calls, outer.value = outer.calls + 1, v

            def clear(self):
                outer.calls, outer.value = outer.calls + 1, None
        return S()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


def test_payment_timer_costs_few_state_calls_and_a_second_one_reads_only():
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
    from bizlens.streaming.payments import Subscriptions, TERM_MS
    state, p = _State(), Subscriptions()
    p.init(state)
    event = Row("ms", "transaction_id", "status", "plan")
    assert not list(p.handleInputRows((7,), iter([event(1000, 1, "successful", "Pro"), event(2000, 2, "successful", "Pro"),
                                                  event(2000, 2, "successful", "Pro")]), TimerValues()))
    assert state.timers == [1000] and state.calls == 2
    state.calls = 0
    rows = list(p.handleExpiredTimer((7,), TimerValues(-1, 5000), ExpiredTimerInfo(1000)))
    assert [(r.subscription_id, r.ms, r.transaction_id, r.status, r.plan, r.expiry_ms) for r in rows] == [
        (7, 1000, 1, "active", "Pro", 1000 + TERM_MS), (7, 2000, 2, "active", "Pro", 1000 + 2 * TERM_MS)]
    assert state.calls == 5 and state.timers == [1000, 1000 + 2 * TERM_MS] and not state.list
    state.calls = 0
    assert not list(p.handleExpiredTimer((7,), TimerValues(-1, 5000), ExpiredTimerInfo(2000)))
    assert state.calls == 2 and len(state.timers) == 2


def test_number_test_casts_only_what_has_the_shape_of_a_number(spark):
    """The same verdict as the cast, on odd strings too; a text that is no number is never cast."""
    from pyspark.sql import functions as F

    from bizlens.operators import schema
    odd = ["1", " 1.5 ", "-.5", "+5.", "1e5", "1E-3", "1e", ".", "", " ", None, "nan", "NaN", "-Infinity", "inf", "+INF", "infin", "1f",
           "2.5D", "0x1p3", "0x.8P-1", "0x", "1996-01-02", "12/3", "1,000", "$5", "x1", "1 2", "\t7\n", " 7", "٣", "1_0", "--1",
           "1.2.3", "9" * 400, "d", "e5", "+", "1e5f", "tru"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    got = df.select("x", schema._is_number(F.col("x")).alias("n"), F.trim("x").try_cast("double").isNotNull().alias("c")).collect()
    assert [(r.x, r.n) for r in got] == [(r.x, r.c) for r in got]
    told = str(schema._is_number(F.col("x"))._jc)
    assert told.index("CASE WHEN") < told.lower().index("cast(")


def test_inference_tries_the_formats_it_decides_by(spark, monkeypatch):
    from bizlens.operators import schema
    asked, real = [], schema.parse_stats
    monkeypatch.setattr(schema, "parse_stats", lambda *a, **k: asked.append(k.get("formats")) or real(*a, **k))
    rows = [("1996-01-02", "02/01/1996", "a-b", "1.5", "-3")] * 8 + [(None, "5", "2/3", "x", None)] * 2
    typed = schema.infer_types(spark.createDataFrame(rows, "iso string, day string, txt string, num string, neg string"))
    assert [t for _, t in typed.dtypes] == ["timestamp_ntz", "timestamp_ntz", "string", "double", "double"]
    assert [sorted(f) for f in asked] == [sorted(f for _, f in schema.STRICT_DATE_FORMATS)]


@pytest.mark.parametrize("by", [["g"], []])
def test_last_values_of_stored_rows_need_no_sort_of_all_rows(spark, by):
    from bizlens.operators import kpi
    day = [dt.datetime(1997, 1 + k % 3, 1 + k % 5) for k in range(60)]
    rows = [((None, "a", "b", "c")[k % 4], None if k % 4 == 2 and k % 3 == 0 or k % 4 == 3 else day[k], 10.0 + k,
             float("nan") if k % 7 == 0 else 5.0 * k, 2.0 * k) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, date timestamp_ntz, revenue double, cash double, debt double")
    m = {"date": "date", "revenue": "revenue", "cash_balance": "cash", "debt": "debt"}
    one, two = (kpi.compute_kpis(df, m, by=by, order_by=["revenue"], stored=s) for s in (False, True))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    # all rows (by group and month) meet hash aggregates only; the sort is left to the rows of the last dates
    sorts = [any("SortAggregate" in line and "_groupingexpression" in line for line in _plan(df, "executed").splitlines())
             for df in (one, two)]
    assert sorts == [True, False]


@pytest.mark.parametrize("name", ["H1", "J9", "M6", "J8", "S2"])
def test_joins_have_tasks_by_the_rows(spark, tables, monkeypatch, name):
    """The joined rows go to a task per so many lines, whatever the session's number of partitions."""
    from bizlens.plans import catalog
    real, seen = catalog.shuffle_tasks, []

    def counted(session, rows):
        seen.append(rows)
        return real(session, rows, rows_per_task=10)
    monkeypatch.setattr(catalog, "shuffle_tasks", counted)
    df = catalog.REGISTRY[name](spark, tables)
    assert seen and set(seen) == {300}
    assert "l_extendedprice" not in _plan(df, "optimized")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    assert df.count() > 0


def test_shuffle_tasks_grow_with_the_rows_and_are_restored(spark):
    from bizlens.session import shuffle_tasks
    key = "spark.sql.shuffle.partitions"
    with pytest.raises(ValueError), shuffle_tasks(spark, 4_500_001):
        assert spark.conf.get(key) == "10"
        raise ValueError
    with shuffle_tasks(spark, 300):
        assert spark.conf.get(key) == "8"
    assert spark.conf.get(key) == "8"
