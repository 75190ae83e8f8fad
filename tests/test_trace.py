"""Traces: reading text, CSV and JSON, ranges, limits, wrong input; writing output; specifications on Spark."""

import pytest

from tideline import __main__ as cli
from tideline.functions.types import BOOL, FLOAT, INT, STRING, UNIT, list_of, map_of, obj, option, set_of
from tideline.operators.lowering import events
from tideline.plans.spec import compile_spec
from tideline.sources import trace


def parsed(line, **types):
    return list(trace.events_of_line(line, types))


def test_lines_values_and_comments():
    assert parsed("3: x = -5 # five", x=INT) == [(3, "x", -5)]
    assert parsed("4: u", u=UNIT) == [(4, "u", True)]
    assert parsed("  -- nothing", u=UNIT) == []
    assert parsed('5: s = "a # ${1 + 2} b"', s=STRING) == [(5, "s", "a # 3 b")]
    assert parsed("6: f = 1.5e2", f=FLOAT) == [(6, "f", 150.0)]
    assert parsed("7: b = 3 < 4 && !(2 == 2)", b=BOOL) == [(7, "b", False)]
    assert parsed("8: l = List(1, 0x10, 7 / 2)", l=list_of(INT)) == [(8, "l", [1, 16, 3])]
    assert parsed("8: s = Set(3, 1, 3)", s=set_of(INT)) == [(8, "s", [1, 3])]
    assert parsed('9: m = Map("a" -> 1, "b" -> if true then 2 else 3)', m=map_of(STRING, INT)) == [(9, "m", [("a", 1), ("b", 2)])]
    assert parsed("9: o = Some(4)", o=option(INT)) == [(9, "o", {"some": True, "v": 4})]
    assert parsed("9: p = {a = 1, b: 2.0}", p=obj(a=INT, b=FLOAT)) == [(9, "p", {"a": 1, "b": 2.0})]
    assert parsed("9: z = 3", x=INT) == [(9, "z", None)]


def test_ranges():
    assert [x[0] for x in parsed("1..3: x = 2", x=INT)] == [1, 2, 3]
    assert [x[0] for x in parsed("0,5..20: u", u=UNIT)] == [0, 5, 10, 15, 20]
    assert parsed("2 < t <= 4: x = t * t", x=INT) == [(3, "x", 9), (4, "x", 16)]
    assert parsed("5..3: x = 1", x=INT) == []
    assert [x[0] for x in trace.events_of_line("7..: x = 1", {"x": INT}, until=9)] == [7, 8, 9]
    with pytest.raises(trace.TraceError, match="needs an end"):
        parsed("7..: x = 1", x=INT)
    with pytest.raises(trace.TraceError, match="positive step"):
        parsed("7,7..9: x = 1", x=INT)


@pytest.mark.parametrize(("line", "message"), [("x = 1", "no event"), ("1: x = true", "takes Int"), ("1: x = y", "not defined"), ("1: x = 1 / 0", "zero"), ("1: x = (", "expected")])
def test_wrong_lines(line, message):
    with pytest.raises(trace.TraceError, match=message):
        parsed(line, x=INT)


SPEC = """
in x: Events[Int]
in u: Events[Unit]
out count(u) as n
out x + 1 as y
out last(x, u) as l
out sample(x, 4) as s
out fold(x, List.empty[Int], (l: List[Int], v: Int) => List.append(l, v)) as all
"""


def shown(df):
    return {(r.ts, r.stream, r.value) for r in df.collect()}


def test_text_trace_through_spark(spark, tmp_path):
    path = tmp_path / "in.trace"
    path.write_text("1: x = 3\n2: u\n4..6: x = 2\n6: u\n9: other = 1\n")
    spec = compile_spec(SPEC)
    line = trace.read_text(spark, str(path), {n: s.type for n, s in spec.inputs.items()})
    got = events(spec.outputs, line)
    want = {(0, "n", "0"), (2, "n", "1"), (6, "n", "2"), (1, "y", "4"), (4, "y", "3"), (5, "y", "3"), (6, "y", "3"), (2, "l", "3"), (6, "l", "2"), (1, "s", "3"), (5, "s", "2"),
            (0, "all", "List()"), (1, "all", "List(3)"), (4, "all", "List(3, 2)"), (5, "all", "List(3, 2, 2)"), (6, "all", "List(3, 2, 2, 2)")}
    assert shown(got) == want
    assert shown(trace.stop_on(got, "l")) == {x for x in want if x[0] <= 2}
    trace.write_text(got, str(tmp_path / "out"))
    written = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert set(written) == {f"{a}: {b} = {c}" for a, b, c in want} and written[0].startswith("0:") and written[-1].startswith("6:")


def test_abort_at_takes_one_event_more(spark, tmp_path):
    path = tmp_path / "in.trace"
    path.write_text("1..100: x = 2\n")
    line = trace.read_text(spark, str(path), {"x": INT}, abort_at=4)
    assert line.df.count() == 5


def test_backward_time_and_doubled_events_fail(spark, tmp_path):
    path = tmp_path / "in.trace"
    path.write_text("5: x = 1\n3: x = 2\n")
    with pytest.raises(trace.TraceError, match="backwards"):
        trace.read_text(spark, str(path), {"x": INT})
    path.write_text("5: x = 1\n5: x = 2\n")
    spec = compile_spec("in x: Events[Int]\nout x + 1")
    with pytest.raises(Exception, match="two events of x"):
        events(spec.outputs, trace.read_text(spark, str(path), {"x": INT})).collect()


def test_csv_trace(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('time,x,l\n1,3,"a"\n2,,\n4..5,1 + 1,\n6,,"b, c"\n')
    line = trace.read_csv(spark, str(path), {"x": INT, "l": STRING})
    assert {tuple(r) for r in line.df.collect()} == {(1, 3, "a"), (2, None, None), (4, 2, None), (5, 2, None), (6, None, "b, c")}


def test_json_trace_with_keys(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('{"k": "a", "ts": 1, "x": 5}\n{"k": "b", "ts": 1, "x": 7}\n{"k": "a", "ts": 3, "x": 6}\n')
    spec = compile_spec("in x: Events[Int]\nout prev(x) as p")
    got = events(spec.outputs, trace.read_json(spark, str(path), {"x": INT}, ("k",)))
    assert {tuple(r) for r in got.collect()} == {("a", 3, "p", "5")}


def test_empty_trace_still_has_tick_zero(spark, tmp_path):
    path = tmp_path / "in.trace"
    path.write_text("# nothing\n")
    spec = compile_spec(SPEC)
    line = trace.read_text(spark, str(path), {n: s.type for n, s in spec.inputs.items()})
    assert shown(events(spec.outputs, line)) == {(0, "n", "0"), (0, "all", "List()")}


def test_failed_output_raises_with_its_time(spark, tmp_path):
    path = tmp_path / "in.trace"
    path.write_text("1: x = 2\n3: x = 0\n")
    spec = compile_spec("in x: Events[Int]\nout 6 / x as q\nout if x == 0 then 0 else 6 / x as safe")
    line = trace.read_text(spark, str(path), {"x": INT})
    with pytest.raises(Exception, match=r"Division by zero \(at 3\)"):
        events({"q": spec.outputs["q"]}, line).collect()
    assert shown(events({"safe": spec.outputs["safe"]}, line)) == {(1, "safe", "3"), (3, "safe", "0")}


def test_command_line_looks(tmp_path, capsys):
    path = tmp_path / "a.spec"
    path.write_text("in x: Events[Int]\nout x + 1 as y\nout sample(x, 3) as s")
    assert cli.main([str(path), "--list-in-streams", "--list-out-streams", "--node-count", "--recursion", "--depth"]) == 0
    found = capsys.readouterr().out.split()
    assert found[:3] == ["x", "y", "s"] and all(x.isdigit() for x in found[3:])
    path.write_text("out z")
    assert cli.main([str(path), "--verify-only"]) == 1


def test_standard_input_is_evaluated_as_it_comes(tmp_path, capsys, monkeypatch):
    path = tmp_path / "a.spec"
    path.write_text("in x: Events[Int]\nin u: Events[Unit]\nout sum(x) as total\nout delay(const(3, u), u) as late\n@raw out x as bare")
    seen = []

    def lines():
        for line in ("1: x = 4\n", "2: u\n", "3: other = 1\n", "9: x = 5\n", "12: x = 6\n"):
            seen.append(capsys.readouterr().out)
            yield line

    monkeypatch.setattr("sys.stdin", lines())
    assert cli.main([str(path)]) == 0
    out = "".join(seen) + capsys.readouterr().out
    assert out.splitlines() == ["0: total = 0", "1: total = 4", "4", "5: late = ()", "9: total = 9", "5", "12: total = 15", "6"]
    assert "1: total = 4" in "".join(seen[:4])
    monkeypatch.setattr("sys.stdin", iter(["1: x = 4\n", "2: u\n", "9: x = 5\n"]))
    assert cli.main([str(path), "--stop-on", "late"]) == 0 and capsys.readouterr().out.splitlines() == ["0: total = 0", "1: total = 4", "4", "5: late = ()"]
    monkeypatch.setattr("sys.stdin", iter(["time,x,u\n", "1,4,\n", "2..3,,()\n"]))
    assert cli.main([str(path), "--csv", "--flatten-input"]) == 0 and capsys.readouterr().out.splitlines() == ["1: x = 4", "2: u = ()", "3: u = ()"]
    monkeypatch.setattr("sys.stdin", iter(["2: x = 4\n", "1: x = 1\n"]))
    assert cli.main([str(path)]) == 1 and "backwards" in capsys.readouterr().err
