"""Queries of replayed investigations, over the driver's events: a run a user, a decision an event in the order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.operators import hunts, investigate
from gneiss.operators.store import stored
from gneiss.plans.registry import _t, query

LIMITS = {"max_steps": 10, "max_tool_calls": 6, "max_tokens": 4_000, "wall_ms": 45_000}
#: Every turn that doesn't end a run is a call, so steps can only run out before calls do.
FEWER_STEPS = LIMITS | {"max_steps": 4}


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a decision, with k, its number."""
    e = _t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    e = e.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = F.when((F.col("event_type") == "purchase") & (F.col("k") % 2 == 0), "finding").when((F.col("event_type") == "error") & (F.col("k") % 9 == 0), "abstain").when((F.col("event_type") == "error") & (F.col("k") % 9 == 1), "lost").otherwise("tool")
    tool = F.when(F.col("event_type") == "view", "read_paragraph").when(F.col("event_type") == "click", "grep").otherwise(F.concat(F.lit("no_"), F.col("event_type")))
    return e.select(
        F.col("user_id").alias("run_id"), "turn", kind.alias("kind"), tool.alias("tool"), F.col("props").alias("arguments"), F.floor(F.col("value") * 10).alias("tokens"),
        (F.col("k") * 70).alias("model_ms"), (F.col("k") * 40).alias("tool_ms"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("k="), F.col("k").cast("string"))).alias("reason"), "k", "value",
    )


_SAID = """e AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS et, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
d AS (SELECT *, CASE WHEN et = 'purchase' AND k % 2 = 0 THEN 'finding' WHEN et = 'error' AND k % 9 = 0 THEN 'abstain' WHEN et = 'error' AND k % 9 = 1 THEN 'lost' ELSE 'tool' END AS kind,
CASE et WHEN 'view' THEN 'read_paragraph' WHEN 'click' THEN 'grep' ELSE 'no_' || et END AS tool, CAST(floor(value * 10) AS BIGINT) AS tokens, k * 70 AS model_ms, k * 40 AS tool_ms FROM e)"""

# the loop as it is written down: one state a turn, each from the one before
def _loop(limits: dict[str, int]) -> str:
    return f"""{_SAID}, users AS (SELECT DISTINCT user_id AS run_id FROM events), loop(run_id, turn, steps, calls, spent, ms, fails, good, stop) AS (
SELECT run_id, 0, 0, 0, 0, 0, 0, 0, CAST(NULL AS VARCHAR) FROM users
UNION ALL SELECT run_id, turn, steps + heard, calls + called, spent + heard * tokens, ms + heard * model_ms + called * tool_ms, fails + called * bad, greatest(good, called * (1 - bad) * reads),
  CASE WHEN early IS NOT NULL THEN early WHEN kind = 'none' THEN 'model response unavailable: no recorded decision' WHEN kind = 'lost' THEN 'model response unavailable: ' || CASE WHEN k % 2 = 0 THEN 'k=' || k ELSE 'unknown' END
  WHEN over IS NOT NULL THEN over WHEN kind = 'abstain' THEN CASE WHEN k % 2 = 0 THEN 'k=' || k ELSE 'model abstained' END WHEN kind = 'finding' THEN 'finding' WHEN called = 0 THEN 'tool-call budget exhausted'
  WHEN ms + model_ms + tool_ms >= {limits['wall_ms']} THEN 'wall-clock budget exhausted' END
FROM (SELECT *, CASE WHEN early IS NULL AND kind IN ('tool', 'finding', 'abstain') THEN 1 ELSE 0 END AS heard, CASE WHEN early IS NULL AND over IS NULL AND kind = 'tool' AND calls < {limits['max_tool_calls']} THEN 1 ELSE 0 END AS called
FROM (SELECT *, CASE WHEN ms >= {limits['wall_ms']} THEN 'wall-clock budget exhausted' WHEN steps >= {limits['max_steps']} THEN 'step budget exhausted' END AS early,
  CASE WHEN spent + tokens > {limits['max_tokens']} THEN 'token budget exhausted' WHEN ms + model_ms >= {limits['wall_ms']} THEN 'wall-clock budget exhausted' END AS over
FROM (SELECT l.run_id, l.turn + 1 AS turn, steps, calls, spent, ms, fails, good, coalesce(kind, 'none') AS kind, coalesce(k, 0) AS k, coalesce(tokens, 0) AS tokens, coalesce(model_ms, 0) AS model_ms, coalesce(tool_ms, 0) AS tool_ms,
  CASE WHEN tool LIKE 'no_%' OR k % 4 < 2 THEN 1 ELSE 0 END AS bad, CASE WHEN tool = 'read_paragraph' THEN 1 ELSE 0 END AS reads FROM loop l LEFT JOIN d ON d.run_id = l.run_id AND d.turn = l.turn + 1 WHERE l.stop IS NULL)))),
ended AS (SELECT * FROM loop WHERE stop IS NOT NULL)"""


_LOOP = _loop(LIMITS)


def _paths(spark: SparkSession, d: str, limits: dict[str, int] = LIMITS) -> tuple[DataFrame, DataFrame]:
    said = stored(_decisions(spark, d), "decisions")
    worked = F.col("k") % 4 >= 2
    results = said.select("tool", "arguments", F.when(worked, F.concat(F.lit("seen "), F.col("k").cast("string"))).alias("observation"), F.when(~worked, "not there").alias("error")).distinct()
    each = investigate.turns(said.select("run_id"), said, limits)
    return stored(investigate.trajectories(each, results), "trajectories"), said


@query(f"WITH RECURSIVE {_LOOP} SELECT run_id, CAST(steps AS BIGINT) AS steps, CAST(calls AS BIGINT) AS tool_calls, CAST(spent AS BIGINT) AS tokens_used, CAST(ms AS BIGINT) AS elapsed_ms, stop, stop LIKE '%exhausted' AS budget_exhausted, CAST(fails AS INTEGER) AS failed_calls FROM ended")
def investigation_loop(spark, d):
    """Every run to its end: what it spent, which budget it broke, and its calls that gave an error."""
    out, _ = _paths(spark, d)
    return out.select("run_id", "steps", "tool_calls", "tokens_used", "elapsed_ms", "stop", "budget_exhausted", F.size(F.filter("transcript", lambda s: s["failed"])).alias("failed_calls"))


def _breaches(limits: dict[str, int]) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {_loop(limits)} SELECT {limits['max_steps']} AS max_steps, stop, count(*) AS runs, CAST(sum(spent) AS BIGINT) AS tokens_used, CAST(max(ms) AS BIGINT) AS slowest_ms FROM ended WHERE stop LIKE '%exhausted' GROUP BY stop)"


@query(f"{_breaches(LIMITS)} UNION ALL {_breaches(FEWER_STEPS)}")
def breaches_by_budget(spark, d):
    """The runs that broke each budget, with many steps allowed and with few."""
    broken = lambda limits: _paths(spark, d, limits)[0].filter("budget_exhausted").withColumn("max_steps", F.lit(limits["max_steps"]))
    return broken(LIMITS).unionByName(broken(FEWER_STEPS)).groupBy("max_steps", "stop").agg(F.count("*").alias("runs"), F.sum("tokens_used").alias("tokens_used"), F.max("elapsed_ms").alias("slowest_ms"))


@query(f"""WITH RECURSIVE {_LOOP}, judged AS (SELECT ended.run_id, stop, k, value,
  array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'type differs' END, CASE WHEN good = 0 THEN 'missing tools: read_paragraph' END, CASE WHEN k % 4 <> 0 THEN 'no dead paragraph' END], lambda x: x IS NOT NULL), '; ') AS errors,
  array_to_string(list_filter([CASE WHEN k % 3 = 2 THEN 'reachability wasn''t verified' END, CASE WHEN k % 3 = 2 OR k % 7 = 0 THEN 'no reachability evidence' END], lambda x: x IS NOT NULL), '; ') AS unproved
FROM ended LEFT JOIN d USING (run_id, turn)), told AS (SELECT *, CASE WHEN stop <> 'finding' THEN stop WHEN errors <> '' THEN 'policy evidence guard: ' || errors WHEN k % 11 = 0 THEN 'verification unavailable; refusing emission' WHEN value >= 90 THEN 'unverifiable'
WHEN unproved <> '' THEN 'policy result guard: ' || unproved END AS reason FROM judged)
SELECT run_id, reason IS NULL AS emitted, reason, CAST(CASE WHEN reason IS NULL THEN 2 END AS INTEGER) AS tier, CASE WHEN reason IS NULL THEN 0.85::DOUBLE END AS confidence FROM told""")
def hunt_outcomes(spark, d):
    """The outcome of each run: the evidence guard of its class over its own transcript, its verdict, and the confidence of the tier."""
    paths, said = _paths(spark, d)
    hunted = hunts.TYPES[5]
    k, none = F.col("k"), F.lit(None).cast("string")
    findings = said.filter("kind = 'finding'").select(
        "run_id", "turn", F.lit(hunted).alias("drift_type"), F.when(k % 5 == 0, hunts.TYPES[0]).otherwise(hunted).alias("predicted_type"), F.lit(True).alias("has_prediction"), F.lit(True).alias("same_clause"),
        F.expr("cast(array() as array<struct<program: string, paragraph: string, file: string, line_start: int, line_end: int>>)").alias("loci"), F.lit(False).alias("is_interprocedural"), F.lit("why").alias("rationale"), none.alias("target_path"),
        F.expr("cast(array() as array<struct<program: string, file: string, line: int>>)").alias("line_level"), none.alias("program_level"), none.alias("paragraph_level"), none.alias("literal"), none.alias("comparator"), F.when(k % 4 == 0, "P9").alias("dead_paragraph"),
        none.alias("clause_kind"), F.expr("cast(array() as array<string>)").alias("clause_values"), none.alias("clause_comparator"), F.expr("cast(map() as map<string, struct<values: array<string>, comparator: string>>)").alias("leaves"),
    )
    reached = F.when((k % 3 < 2) & (k % 7 != 0), "P9 is not reached (forest_roots + reachable_from)").otherwise("present: 9")
    verdicts = said.filter("kind = 'finding' AND k % 11 <> 0").select("run_id", "turn", (F.col("value") < 90).alias("verified"), F.when(k % 3 < 2, 2).otherwise(3).alias("tier"), reached.alias("evidence"), F.when(F.col("value") >= 90, "unverifiable").alias("rejected"))
    return investigate.outcomes(paths, findings, verdicts).select("run_id", "emitted", "reason", "tier", "confidence")
