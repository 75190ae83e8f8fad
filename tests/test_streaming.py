"""The push engine, and Structured Streaming against the batch result."""

import time

import pytest

from tideline.operators.lowering import events
from tideline.operators.timeline import Timeline
from tideline.plans.spec import compile_spec
from tideline.streaming.engine import Engine, EngineError
from tideline.streaming.runner import evaluate

SPEC = """
in x: Events[Int]
in u: Events[Unit]
out sum(x) as total
out last(x, u) as l
out delay(const(4, u), u) as d
out count(delay(const(3, u), u)) as fired
"""


def test_engine_pushes_ticks_and_timers():
    got = []
    e = Engine(SPEC, lambda ts, name, value: got.append((ts, name, value if value != {} else "()")))
    e.provide("x", 5)
    e.set_time(2)
    e.provide("u")
    e.set_time(9)
    e.provide("x", 1)
    e.step()
    assert [x for x in got if x[1] == "total"] == [(0, "total", 5), (9, "total", 6)]
    assert (2, "l", 5) in got and (6, "d", "()") in got
    assert [x for x in got if x[1] == "fired"] == [(0, "fired", 0), (5, "fired", 1)]


def test_engine_rejects_wrong_input():
    e = Engine(SPEC, lambda *_: None)
    e.set_time(3)
    e.provide("x", 1)
    for act, message in ((lambda: e.provide("x", 2), "two events"), (lambda: e.provide("y", 2), "no input"), (lambda: e.provide("u", "s"), "takes Unit"), (lambda: e.set_time(1), "backwards")):
        with pytest.raises(EngineError, match=message):
            act()
    bad = Engine("in x: Events[Int]\nout 1 / x", lambda *_: None)
    bad.provide("x", 0)
    with pytest.raises(EngineError, match="zero"):
        bad.step()


def test_structured_streaming_gives_the_batch_result(spark, tmp_path):
    spec = compile_spec(SPEC)
    rows = [("a", 1000, 1, None), ("a", 3000, None, True), ("b", 2000, 7, True), ("a", 5000, 4, None), ("b", 9000, 2, None), ("a", 12_000, 3, True), ("z", 60_000, 0, None)]
    schema = "k string, ts long, x long, u boolean"
    for i, part in enumerate((rows[1:3], rows[:1] + rows[3:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    query = evaluate(stream, spec, "k", "10 seconds").writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("got").collect()}
    want = {tuple(r) for r in events(spec.outputs, Timeline(spark.createDataFrame(rows, schema), ("k",))).collect()}
    mark = 50_000
    assert got == {r for r in want if r[1] <= mark and r[0] != "z"}


ROWS = "k string, ts long, x long, u boolean"


def streamed(spark, folder, spec, **options):
    """One run over what is in the folder that earlier runs haven't seen; all output so far."""
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(folder / "in"))
    out = evaluate(stream, spec, "k", **options)
    out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(str(folder / "out")).collect())


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.json(str(folder / f"in/{name}"))


def test_a_query_goes_on_from_its_checkpoint(spark, tmp_path):
    spec = compile_spec(SPEC)
    rows = [("a", 1000, 1, None), ("b", 2000, 7, True), ("a", 5000, 4, True), ("b", 9000, 2, None), ("a", 12_000, 3, True), ("z", 60_000, 0, None)]
    feed(spark, tmp_path, 0, rows[:3])
    first = streamed(spark, tmp_path, spec)
    feed(spark, tmp_path, 1, rows[3:])
    second = streamed(spark, tmp_path, spec)
    assert streamed(spark, tmp_path, spec) == second and set(first) < set(second)
    want = {tuple(r) for r in events(spec.outputs, Timeline(spark.createDataFrame(rows, ROWS), ("k",))).collect()}
    assert len(second) == len(set(second)) and {r for r in second if r[0] != "z"} == {r for r in want if r[0] != "z"}


def test_silent_keys_are_forgotten(spark, tmp_path):
    spec = compile_spec("in x: Events[Int]\nin u: Events[Unit]\nout sum(x) as total")
    for i, rows in enumerate(([("a", 1000, 1, None), ("b", 1500, 5, None)], [("b", 4000, 1, None)], [("z", 20_000, 0, None)], [("a", 21_000, 2, None), ("b", 21_000, 2, None)], [("z", 40_000, 0, None)])):
        feed(spark, tmp_path, i, rows)
        got = streamed(spark, tmp_path, spec, expire=17_000)
    assert [r[1:] for r in got if r[0] == "a"] == [(0, "total", "0"), (0, "total", "0"), (1000, "total", "1"), (21_000, "total", "2")]
    assert [r[1:] for r in got if r[0] == "b"] == [(0, "total", "0"), (1500, "total", "5"), (4000, "total", "6"), (21_000, "total", "8")]


def test_keys_may_share_states(spark, tmp_path):
    spec = compile_spec(SPEC)
    # more keys than states, one of them null, some silent in later batches, one forgotten
    parts = [[(k, 1000 + i, i, True if i % 2 else None) for i, k in enumerate([None, *"abcdefgh"])], [(k, 5000, 2, None) for k in "abcd"], [(None, 9000, 1, None), ("a", 9000, 3, True), ("z", 20_000, 0, None)], [("b", 21_000, 1, None), ("z", 60_000, 0, None)]]
    found = {}
    for groups in (None, 3):
        folder = tmp_path / str(groups)
        for i, rows in enumerate(parts):
            feed(spark, folder, i, rows)
            stream = spark.readStream.schema(ROWS).option("recursiveFileLookup", True).json(str(folder / "in"))
            out = evaluate(stream, spec, "k", expire=14_000, groups=groups)
            out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start().awaitTermination()
        found[groups] = spark.read.schema(out.schema).parquet(str(folder / "out")).collect()
    # at 60,000 the watermark stands; a state without older events isn't called for it
    first, second = (sorted((r[0] or "", *r[1:]) for r in rows if r[1] < 60_000) for rows in found.values())
    assert first == second and {r[0] for r in first} == {"", *"abcdefgh", "z"}
    with pytest.raises(ValueError, match="integers or strings"):
        evaluate(spark.readStream.schema("k double, ts long, x long, u boolean").json(str(tmp_path)), spec, "k", groups=3)


def test_streamed_totals_hands_over_no_state_for_each_key(spark, tmp_path):
    """A state costs milliseconds, so their number must not grow with the keys."""
    from tideline.plans.language_queries import queries

    folder = str(tmp_path / "in")
    events = spark.range(3000).selectExpr("id as event_id", "timestamp_micros(1704153600000000 + id) as ts", "id as user_id", "'click' as event_type", "1.0D as value", "'' as props")
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    seen = []
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryProgress(self, event):
            seen.extend(s.numRowsTotal for s in event.progress.stateOperators)
        def onQueryIdle(self, event): ...
        def onQueryTerminated(self, event): ...

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        assert queries()["streamed_totals"](spark, folder).count() == 6000
        for _ in range(100):
            if seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert 0 < max(seen) <= 2048
