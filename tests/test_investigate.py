from __future__ import annotations

import random

import pytest

from gneiss.operators import investigate as v

DECISIONS = "run_id string, turn int, kind string, tool string, arguments string, tokens long, model_ms long, tool_ms long, reason string"
RESULTS = "tool string, arguments string, observation string, error string"


def loop(record: dict[int, tuple], limits: dict) -> tuple:
    """One run as it goes: (steps, calls, tokens, ms, stop)."""
    steps = calls = tokens = ms = 0
    while True:
        if ms >= limits["wall_ms"]:
            return steps, calls, tokens, ms, v.WALL
        if steps >= limits["max_steps"]:
            return steps, calls, tokens, ms, v.STEPS
        said = record.get(steps + 1)
        if said is None:
            return steps, calls, tokens, ms, "model response unavailable: no recorded decision"
        kind, _, _, cost, model_ms, tool_ms, reason = said
        if kind not in ("tool", "finding", "abstain"):
            return steps, calls, tokens, ms, f"model response unavailable: {reason or 'unknown'}"
        steps, tokens, ms = steps + 1, tokens + (cost or 0), ms + (model_ms or 0)
        if tokens > limits["max_tokens"]:
            return steps, calls, tokens, ms, v.TOKENS
        if ms >= limits["wall_ms"]:
            return steps, calls, tokens, ms, v.WALL
        if kind == "abstain":
            return steps, calls, tokens, ms, reason or "model abstained"
        if kind == "finding":
            return steps, calls, tokens, ms, "finding"
        if calls >= limits["max_tool_calls"]:
            return steps, calls, tokens, ms, v.CALLS
        calls, ms = calls + 1, ms + (tool_ms or 0)
        if ms >= limits["wall_ms"]:
            return steps, calls, tokens, ms, v.WALL


@pytest.mark.parametrize("limits", [{"max_steps": 6, "max_tool_calls": 4, "max_tokens": 35, "wall_ms": 90}, {"max_steps": 3, "max_tool_calls": 9, "max_tokens": 99, "wall_ms": 80}])
def test_runs_by_a_plain_loop(spark, limits):
    rnd = random.Random(limits["max_steps"])
    runs = {f"r{k}": {t: (rnd.choice(["tool"] * 9 + ["finding", "abstain", "lost", None]), rnd.choice(["grep", "read_program", "other", None]), rnd.choice(["a", "b", None]), rnd.choice([None, 0, 5, 20]), rnd.choice([None, 1, 10, 30]), rnd.choice([None, 1, 10]), rnd.choice([None, "", "why"])) for t in range(1, rnd.randint(1, 12)) if rnd.random() < 0.97} for k in range(150)}
    rows = [(r, t, *d) for r, ds in runs.items() for t, d in ds.items()]
    said = spark.createDataFrame(rows + rows[:40] + [("not asked", 1, "finding", None, None, 1, 1, 1, None), ("r0", 0, "finding", None, None, 1, 1, 1, None)], DECISIONS)
    asked = spark.createDataFrame([(r,) for r in runs] + [("empty",), ("empty",)], "run_id string")
    results = spark.createDataFrame([("grep", "a", "x" * 5000, None), ("grep", "a", "y", None), ("grep", "b", None, "no such file"), ("read_program", None, "seen", None)], RESULTS)
    out = {r.run_id: r for r in v.trajectories(v.turns(asked, said, limits), results).collect()}
    assert set(out) == {*runs, "empty"}
    for run, record in {**runs, "empty": {}}.items():
        r = out[run]
        steps, calls, tokens, ms, stop = loop(record, limits)
        assert (r.steps, r.tool_calls, r.tokens_used, r.elapsed_ms, r.stop, r.budget_exhausted) == (steps, calls, tokens, ms, stop, stop in v.BUDGETS), run
        assert [(s.turn, s.tool, s.arguments) for s in r.transcript] == [(t, record[t][1], record[t][2]) for t in range(1, calls + 1)]
        for s in r.transcript:
            want = {("grep", "a"): ("x" * 3999 + "…", True, None), ("grep", "b"): (None, False, "no such file"), ("read_program", None): ("seen", False, None)}.get((s.tool, s.arguments))
            lost = "no recorded result" if s.tool in v.TOOLS else f"unsupported tool: {s.tool or 'null'}"
            assert (s.observation, s.truncated, s.error) == (want or (None, False, lost)) and s.failed == (s.error is not None)
    assert {r.stop for r in out.values()} >= ({v.WALL, v.TOKENS, v.CALLS, "finding"} if limits["max_steps"] == 6 else {v.STEPS, "finding"})


def test_one_run_that_holds_most_rows_costs_its_budget_only(spark):
    said = spark.range(1, 200_001).selectExpr("'hot' run_id", "cast(id as int) turn", "'tool' kind", "'grep' tool", "'a' arguments", "1L tokens", "1L model_ms", "1L tool_ms", "cast(null as string) reason")
    each = v.turns(spark.createDataFrame([("hot",)], "run_id string"), said)
    assert each.count() == 11 and each.filter("stop is not null").first().stop == v.CALLS
    assert v.turns(spark.createDataFrame([], "run_id string"), said).count() == 0
