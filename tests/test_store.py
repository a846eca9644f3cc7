"""Persistence, ledger, streaming, encodings and the HTTP front."""

import itertools
import json
import threading
import urllib.request

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from positdb.engine import Engine
from positdb.errors import Cancelled, DataCorruption, ExecutionError
from positdb.functions import certainty, times, values
from positdb.operators import sets
from positdb.server import answer, serve
from positdb.sources import ledger
from positdb.sources.store import PositStore, Shred
from positdb.streaming.rows import Callbacks, Running, deliver, stream
from positdb.streaming.snapshots import latest

SCRIPT = """add role shelf, name; add posit [{(+a, shelf)}, "x", '2020'], [{(+b, name)}, 42, '2020-01'], [{(a, shelf)}, "x", '2020'], [{(a, shelf)}, 42%, @BOT];"""


def test_store_is_restored_and_verified(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    store = PositStore.open(spark, path)
    Engine(store).run(SCRIPT)
    assert store.posits().count() == 3
    again = PositStore.open(spark, path)
    assert again.roles == store.roles and again.types == store.types and again.last_id >= store.last_id - 1
    Engine(again).run("add posit [{(+c, name)}, \"new\", '2021'];" + 'add role other; add posit [{(+d, other)}, {"a": 1}, @EOT];')
    found = Engine(PositStore.open(spark, path)).execute_collect("search [{(*, name)}, +n, +t] return n, t;")
    assert sorted(found.rows) == [["42", "2020-1"], ["new", "2021"]]
    assert ledger.verify(again) == {"entries": 5, "mismatches": 0, "first": None}
    assert ledger.head(again)[1] == 5


def test_equal_posits_are_one_also_after_restart(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    first = PositStore.open(spark, path)
    first.add_role("k")
    one = first.insert([({"k": 7}, values.decimal("10.0"), times.parse("2020"))])
    again = PositStore.open(spark, path)
    assert again.insert([({"k": 7}, values.decimal("10.00"), times.parse("2020"))]) == one
    assert again.insert([({"k": 7}, values.integer("10"), times.parse("2020"))]) != one


def test_tables_are_deduplicated_and_chained(spark, tmp_path):
    """Posits of a table that equal each other or those of the store are not added; all others get ledger entries."""
    path = f"file://{tmp_path}/db"
    store = PositStore.open(spark, path)
    store.add_role("k")
    first, = store.insert([({"k": 7}, values.integer("10"), times.BEGINNING)])
    table = spark.createDataFrame([(7, 10, 1000), (7, 11, 1001), (8, 10, 1002), (8, 10, 1003)], "thing long, v long, id long")
    store.shred(Shred(table, {"k": F.col("thing")}, values.INTEGER, F.col("v"), F.col("id")))
    assert sorted(r.posit_id for r in store.posits().collect()) == [first, 1001, 1002]
    again = PositStore.open(spark, path)
    assert ledger.verify(again) == {"entries": 3, "mismatches": 0, "first": None} and again.last_id >= 1002


def test_a_changed_store_does_not_open(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    Engine(PositStore.open(spark, path)).run(SCRIPT)
    posits = spark.read.parquet(f"{path}/posit")
    changed = posits.withColumn("v_text", F.when(F.col("v_text") == "x", "y").otherwise(F.col("v_text"))).collect()
    spark.createDataFrame(changed, posits.schema).write.mode("overwrite").partitionBy("role_set").parquet(f"{path}/posit")
    with pytest.raises(DataCorruption):
        PositStore.open(spark, path)


def test_a_command_is_one_write(spark, tmp_path):
    """Posits of a command go to one file, but for those that appear in a later one of it."""
    path = f"file://{tmp_path}/db"
    store = PositStore.open(spark, path)
    Engine(store).run("add role k; add posit " + ", ".join(f"[{{(+x{i}, k)}}, {i}, '2020']" for i in range(20)) + ";")
    assert store.posits().count() == 20 and store._read("ledger").inputFiles().__len__() == 1
    Engine(store).run("add posit +p [{(+a, k)}, 1, '2021'], [{(p, posit), (a, ascertains)}, 50%, '2022'];")
    assert store.posits().count() == 22 and ledger.verify(store)["mismatches"] == 0


def test_ledger_finds_changes(spark):
    store = PositStore.in_memory(spark)
    Engine(store).run(SCRIPT)
    rows = [(r.posit_id, r.p) for r in store.posits().select("posit_id", ledger.payload_column().alias("p")).orderBy("posit_id").collect()]
    entries = spark.createDataFrame(ledger.chain(rows), ledger.SCHEMA)
    changed = store.posits().withColumn("v_text", F.when(F.col("posit_id") == rows[1][0], "y").otherwise(F.col("v_text")))
    assert [r.posit_id for r in ledger.checked(changed, entries).where("not ok").collect()] == [rows[1][0]]
    assert ledger.verify(store) == {"entries": 0, "mismatches": 0, "first": None}


def test_listing_and_lookup(spark):
    store = PositStore.in_memory(spark)
    Engine(store).run("add role wife, husband; add posit [{(+w, wife), (+h, husband)}, \"married\", '2004-06-19'];")
    row = store.posits().first()
    things = row.apps
    assert store.listing().first().line == f"{row.posit_id} [{{({things['husband']}, husband), ({things['wife']}, wife)}}, married::<String>, 2004-06-19]"
    assert store.involving(things["wife"]).count() == 1 and store.involving(-1).count() == 0


def test_set_operators(spark):
    a, b, none = (spark.createDataFrame([(x,) for x in xs], "thing long") for xs in ([1, 2, 3], [3, 4], []))
    get = lambda df: sorted(r.thing for r in df.collect())
    assert get(sets.intersect(a, b)) == [3] and get(sets.union(a, b)) == [1, 2, 3, 4]
    assert get(sets.difference(a, b)) == [1, 2] and get(sets.symmetric_difference(a, b)) == [1, 2, 4]
    assert get(sets.symmetric_difference(none, b)) == [3, 4] and get(sets.insert(none, [9, 9])) == [9]


@pytest.mark.parametrize(("percents", "ok"), [([25, -75], True), ([-95] * 20, True), ([-95] * 21, False), ([], True), ([0, 100], True), ([1, 100], False)])
def test_consistency(spark, percents, ok):
    assert certainty.all_consistent(percents) == ok
    df = spark.createDataFrame([(1, p) for p in percents], "g int, v_cert int")
    assert [r.consistent for r in certainty.consistent(df, ["g"]).collect()] == ([ok] if percents else [])


def reference_order(a, b):
    """-1, 0, 1 at the coarser precision of two times, each (precision, calendar fields)."""
    n = min(len(a), len(b))
    return (a[:n] > b[:n]) - (a[:n] < b[:n])


FIELDS = st.tuples(st.integers(1, 4), st.integers(2019, 2021), st.integers(1, 12), st.integers(1, 28), st.integers(0, 23)).map(lambda t: t[1 : 1 + t[0]])


def literal(f):
    return times.parse({1: "{0:04}", 2: "{0:04}-{1:02}", 3: "{0:04}-{1:02}-{2:02}", 4: "{0:04}-{1:02}-{2:02} {3:02}:00"}[len(f)].format(*f))


@given(FIELDS, FIELDS)
@settings(max_examples=300, deadline=None)
def test_intervals_order_like_calendars(a, b):
    x, y, c = literal(a), literal(b), reference_order(a, b)
    assert (x.hi < y.lo, x.lo <= y.hi, x.lo > y.hi, x.hi >= y.lo) == (c < 0, c <= 0, c > 0, c >= 0)
    assert ((x.prec, x.lo) == (y.prec, y.lo)) == (a == b)


def test_time_columns(spark):
    texts = ["2022", "2022-05", "2022-05-01", "2022-05-01 10:00:07", "0044-03-15"]
    found = [times.parse(t) for t in texts] + [times.BEGINNING, times.END]
    df = spark.createDataFrame([(t.prec, t.lo, t.text) for t in found], "p int, lo long, text string")
    assert [r[0] for r in df.select(times.shown(F.col("p"), F.col("lo"))).collect()][:4] == [t.text for t in found][:4]
    stamp = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.5' as a, timestamp_ntz'2024-02-29 12:34:56.789012' as b")
    r = stamp.select(times.micros(F.col("a")).alias("a"), times.micros(F.col("b")).alias("b"), times.timestamp(times.micros(F.col("b"))).alias("c"), "b").first()
    assert r[0] == -500_000 and r[2] == r[3]


@pytest.mark.parametrize("bad", ["2022-13", "2022-02-30", "12", "2022-05-01 25:00", "999999"])
def test_bad_times(bad):
    with pytest.raises(ExecutionError):
        times.parse(bad)


def test_rows_are_streamed(spark):
    engine = Engine(spark)
    engine.run(SCRIPT)
    script = "search [{(*, shelf)}, +v, *] return v; search [{(*, name)}, +n, *] return n limit 1;"
    assert sorted(stream(engine, script)) == [(0, ["0.42"]), (0, ["x"]), (1, ["42"])]
    told = []
    assert deliver(engine, script, Callbacks(lambda k, r: told.append((k, r.columns)), lambda k, row, types: k > 0, lambda *x: told.append(x))) == 2
    assert told == [(0, ["v"]), (0, 1, False), (1, ["n"]), (1, 1, True)]
    assert len(list(Running(engine, script))) == 3
    with pytest.raises(ExecutionError):
        list(Running(engine, "search [{(*, nothing)}, +v, *] return v;"))
    with pytest.raises(Cancelled):
        list(Running(engine, script, timeout=0))


def test_http(spark):
    engine = Engine(spark)
    engine.run(SCRIPT)
    one = "search [{(*, name)}, +n, *] return n;"
    assert answer(engine, {"script": "find"})[0] == 400 and answer(engine, {"script": "search [{(*, nothing)}, +n, *] return n;"})[0] == 500
    status, body = answer(engine, {"script": one})
    assert status == 200 and (body["columns"], body["rows"], body["row_types"], body["row_count"], body["limited"]) == (["n"], [["42"]], [["i64"]], 1, False)
    status, body = answer(engine, {"script": one + one})
    assert status == 200 and body["row_count"] == 2 and [f["rows"] for f in body["result_sets"]] == [[["42"]]] * 2
    assert answer(engine, {"script": one, "timeout_ms": 0})[0] == 504
    server = serve(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def streamed(**asked):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/v1/query", json.dumps(asked | {"stream": True}).encode())
        text = urllib.request.urlopen(request, timeout=60).read().decode()
        return [json.loads(x.removeprefix("data: ")) for x in text.split("\n\n") if x]

    try:
        found = streamed(script=one)
        assert [e["event"] for e in found] == ["meta", "row", "end"] and found[1]["types"] == ["i64"] and found[2]["row_count"] == 1
        assert streamed(script=one, timeout_ms=60_000) == found
        found = streamed(script=one + one)
        assert [e["event"] for e in found] == ["result_set_start", "row", "result_set_end"] * 2 + ["multi_end", "end"]
        assert found[4]["index"] == 1 and found[6]["total_rows"] == 2
        assert [e["event"] for e in streamed(script=one, timeout_ms=0)] == ["error", "end"]
    finally:
        server.shutdown()


def test_latest_over_a_stream(spark, tmp_path):
    store = PositStore.in_memory(spark)
    Engine(store).run("add role k; add posit [{(+a, k)}, 1, '2020'], [{(a, k)}, 2, '2021'], [{(+b, k)}, 3, '2019'];")
    store.posits().write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(store.posits().schema).parquet(f"{tmp_path}/in")
    running = latest(source).writeStream.outputMode("complete").format("memory").queryName("latest_posits").option("checkpointLocation", f"{tmp_path}/c").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(r.v_text for r in spark.table("latest_posits").collect()) == ["2", "3"]
    assert sorted(itertools.chain(*[[r.v_text] for r in latest(store.posits()).collect()])) == ["2", "3"]
