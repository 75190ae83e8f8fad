"""Queries against their SQL on events that the smallest tables don't have: values of 0 cents, users' events at the same time."""

import duckdb
import pytest

from test_queries import QUERIES, SQL, rows
from tideline.functions.types import INT
from tideline.operators import library as L
from tideline.operators.lowering import outputs
from tideline.plans.spec import compile_spec
from tideline.sources import trace


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """A folder with an events table of the given (seconds, user, type, value), and a connection that has it, too."""
    con = duckdb.connect()

    def make(name, events):
        folder = tmp_path_factory.mktemp(name)
        values = ", ".join(f"({i}::bigint, timestamp '2024-01-02' + interval ({s}) second, {u}::bigint, '{kind}', {v}::double, '')" for i, (s, u, kind, v) in enumerate(events))
        con.execute(f"copy (select * from (values {values}) as t(event_id, ts, user_id, event_type, \"value\", props)) to '{folder}/events.parquet' (format parquet)")
        con.execute(f"create or replace view events as select * from '{folder}/events.parquet'")
        return str(folder), con

    return make


def answers(spark, table, name, sql=None):
    """The query's rows and its SQL's."""
    folder, con = table
    df = QUERIES[name](spark, folder)
    names = sorted(df.columns)
    return rows(df.select(*names).collect()), rows(con.sql(f"select {', '.join(names)} from ({sql or SQL[name]})").fetchall())


#: The last click of user 1 but one ends a delay of 36 s at its own tick; user 2 has nothing but values of 0.
ZERO = [(0, 1, "click", 0.01), (20, 1, "click", 0.0), (40, 1, "view", 0.0), (50, 1, "click", 0.02), (900, 1, "view", 1.5), (960, 1, "click", 3.0), (970, 1, "view", 0.5), (5, 2, "click", 0.0), (9, 2, "error", 0.0)]


def test_a_click_of_no_price_fires_at_once(spark, table):
    got, want = answers(spark, table("zero", ZERO), "delay_stepped")
    assert got == want and len(got) == 3


def test_a_price_of_0_has_no_logarithm(spark, table):
    made = table("zero", ZERO)
    name = "scalar_float_ops"
    with pytest.raises(duckdb.Error):
        made[1].sql(SQL[name]).fetchall()
    # as the SQL fails at 0, the rows are held against it with that one logarithm left out
    got, want = answers(spark, made, name, SQL[name].replace("trunc(ln(p) / ln(2.0::double) * 1000)::bigint as r_log", "case when p > 0 then trunc(ln(p) / ln(2.0::double) * 1000)::bigint end as r_log"))
    assert got == want and len(got) == len(ZERO)


@pytest.mark.parametrize("name", ["map_max", "map_min"])
def test_maps_show_entries_above_0(spark, table, name):
    got, want = answers(spark, table("zero", ZERO), name)
    assert got == want and len(got) == len(ZERO) + 2


#: Users whose events share their time: of one type, with equal and with other values, and of two types.
SHARED = [(0, 1, "click", 1.0), (0, 2, "click", 1.0), (3, 1, "purchase", 2.0), (5, 1, "click", 4.0), (5, 2, "click", 5.0), (5, 3, "purchase", 7.0), (5, 4, "signup", 1.0), (8, 1, "purchase", 6.0), (8, 2, "purchase", 6.0), (9, 1, "view", 3.0), (9, 2, "purchase", 1.0)]


@pytest.mark.parametrize("name", ["text_trace", "csv_trace", "json_trace", "trace_flattened", "trace_abort_at"])
def test_events_of_one_time_are_all_there(spark, table, name):
    got, want = answers(spark, table("shared", SHARED), name)
    assert got == want and got


def test_running_values_where_times_repeat(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("time,x,y\n0,5,\n0,6,1\n2..3,1,\n3,2,7\n3,,8\n")
    spec = compile_spec("in x: Events[Int]\nin y: Events[Int]\nout sum(x) as total\nout prev(x) as before\nout x + y as both\nout default(y, -1) as d\nout last(x, period(3)) as p")
    line = trace.read_csv(spark, str(path), {"x": INT, "y": INT}, repeated=True)
    got = [tuple(r) for r in outputs(spec.outputs, line).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(0, 0, None, None, -1, None), (0, 5, None, None, None, None), (0, 11, 5, 7, 1, None), (2, 12, 6, 2, None, None), (3, None, None, None, None, 1), (3, 13, 1, 2, None, None), (3, 15, 1, 9, 7, None), (3, None, None, 10, 8, None)]
    assert sorted(map(key, got)) == sorted(map(key, want))
    with pytest.raises(ValueError, match="don't repeat"):
        outputs({"s": L.sample(spec.inputs["x"], 4)}, line)
