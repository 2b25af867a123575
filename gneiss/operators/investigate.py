"""Investigations replayed from recorded decisions: the bounded loop, its four budgets, tool dispatch, guard, verification, confidence.

A run asks a model again and again: a decision is a tool call, a finding, an abstention or a failure, and the loop stops it at
the first budget that is used up. Replayed, a run's decisions are rows by turn, and no state has to be carried by hand: what was
spent before a turn is a sum over the turns before it, whether the loop stops there an expression over that, and the end of the
run its first stop. Nothing of a run beyond its step budget can matter, so a run has max_steps rows at most in its window,
however many its record holds.

    decisions   run_id, turn (from 1), kind (tool, finding, abstain; anything else failed), tool, arguments, tokens, model_ms, tool_ms, reason
    results     tool, arguments, observation, error (what each call gave)
    findings    run_id, turn and the columns of gneiss.operators.hunts that a guard reads, without transcript
    verdicts    run_id, turn, verified, tier, evidence, rejected (as hunts.verified gives them)

Order within a turn: time and steps are looked at before the model is asked, tokens and time after it, the number of calls
before a call and time after it. A finding is emitted only if its guard has no error, it is verified and, for dead code, by
reachability. A turn without a record is a model that doesn't answer. Of repeated records of a turn the least counts; nulls
of numbers are 0; a run without decisions ends at its first turn; calls of unknown tools or without a result are observations of
an error and never end a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import hunts
from gneiss.operators.store import stored

#: The tools that may be called, the limits of a run, the characters of an observation, what ends a run.
TOOLS = ("read_paragraph", "read_program", "find_callers", "find_callees", "trace_variable", "slice_on", "resolve_copybook", "get_data_layout", "grep", "run_cobol", "search_regulations")
LIMITS = {"max_steps": 12, "max_tool_calls": 10, "max_tokens": 20_000, "wall_ms": 120_000}
SEEN_CHARS = 4000
WALL, STEPS, TOKENS, CALLS = "wall-clock budget exhausted", "step budget exhausted", "token budget exhausted", "tool-call budget exhausted"
BUDGETS = (WALL, STEPS, TOKENS, CALLS)


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def turns(runs: DataFrame, decisions: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Each turn of each run up to its end: run_id, turn, kind, tool, arguments, reason, called, answered, tokens_used, calls, elapsed_ms and stop.

    stop is why the run ends with this turn (`finding` for one that is proposed), null before; answered tells whether the model was
    heard in this turn, called whether a tool was; the sums include the turn.
    """
    most = limits["max_steps"]
    fields = ["kind", "tool", "arguments", "tokens", "model_ms", "tool_ms", "reason"]
    own = decisions.filter(F.col("turn").between(1, most)).groupBy("run_id", F.col("turn").cast("int").alias("turn")).agg(F.min(F.struct(*fields)).alias("d")).select("run_id", "turn", "d.*").withColumn("recorded", F.lit(True))
    every = runs.select("run_id").distinct()
    order = Window.partitionBy("run_id").orderBy("turn")
    # the turns that follow on one another, and one more, in which nothing is recorded
    own = own.join(every, "run_id", "left_semi").withColumn("n", F.row_number().over(order)).filter("n = turn").drop("n")
    after = every.join(own.groupBy("run_id").agg(F.max("turn").alias("last")), "run_id", "left").select("run_id", (F.coalesce("last", F.lit(0)) + 1).alias("turn"))
    t = own.unionByName(after, allowMissingColumns=True).withColumn("recorded", F.coalesce("recorded", F.lit(False)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_tool = F.coalesce(F.col("kind") == "tool", F.lit(False))
    took = _n("model_ms") + F.when(is_tool, _n("tool_ms")).otherwise(0)
    t = t.withColumns({"calls_before": F.coalesce(F.sum(is_tool.cast("long")).over(before), F.lit(0)), "ms_before": F.coalesce(F.sum(took).over(before), F.lit(0)), "tokens_before": F.coalesce(F.sum(_n("tokens")).over(before), F.lit(0))})
    late = lambda ms: ms >= limits["wall_ms"]
    heard = F.col("ms_before") + _n("model_ms")
    early = F.when(late(F.col("ms_before")), WALL).when(F.col("turn") > most, STEPS)
    failed = F.when(~F.col("recorded"), "model response unavailable: no recorded decision").when(~F.coalesce(F.col("kind").isin("tool", "finding", "abstain"), F.lit(False)), F.concat(F.lit("model response unavailable: "), F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown"))))
    spent = F.when(F.col("tokens_before") + _n("tokens") > limits["max_tokens"], TOKENS).when(late(heard), WALL)
    said = F.when(F.col("kind") == "abstain", F.coalesce(F.nullif("reason", F.lit("")), F.lit("model abstained"))).when(F.col("kind") == "finding", "finding")
    full = F.when(is_tool & (F.col("calls_before") >= limits["max_tool_calls"]), CALLS)
    slow = F.when(is_tool & late(heard + _n("tool_ms")), WALL)
    answered = early.isNull() & failed.isNull()
    called = answered & spent.isNull() & is_tool & full.isNull()
    t = t.withColumns({"stop": F.coalesce(early, failed, spent, said, full, slow), "answered": answered, "called": called})
    t = t.withColumn("ends_at", F.min(F.when(F.col("stop").isNotNull(), F.col("turn"))).over(Window.partitionBy("run_id"))).filter("turn <= ends_at")
    sums = {
        "tokens_used": F.col("tokens_before") + F.when(F.col("answered"), _n("tokens")).otherwise(0),
        "calls": F.col("calls_before") + F.col("called").cast("long"),
        "elapsed_ms": F.col("ms_before") + F.when(F.col("answered"), _n("model_ms")).otherwise(0) + F.when(F.col("called"), _n("tool_ms")).otherwise(0),
    }
    return t.withColumns(sums).select("run_id", "turn", "kind", "tool", "arguments", "reason", "answered", "called", *sums, "stop")


def summarised(observation: Column) -> Column:
    """An observation of at most SEEN_CHARS characters, the last of which shows that there was more."""
    return F.when(F.length(observation) > SEEN_CHARS, F.concat(F.substring(observation, 1, SEEN_CHARS - 1), F.lit("…"))).otherwise(observation)


def dispatched(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (run_id, turn, tool, arguments) with observation, truncated and error, by the recorded results; of several the least counts."""
    one = results.groupBy("tool", F.coalesce("arguments", F.lit("")).alias("__a")).agg(F.min(F.struct("observation", "error")).alias("r"))
    known = F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False))
    out = calls.withColumn("__a", F.coalesce("arguments", F.lit(""))).join(one, ["tool", "__a"], "left")
    error = F.when(~known, F.concat(F.lit("unsupported tool: "), F.coalesce("tool", F.lit("null")))).when(F.col("r").isNull(), "no recorded result").otherwise(F.col("r.error"))
    seen = F.when(error.isNull(), F.col("r.observation"))
    return out.withColumns({"observation": summarised(seen), "truncated": F.coalesce(F.length(seen) > SEEN_CHARS, F.lit(False)), "error": error}).drop("__a", "r")


def trajectories(each: DataFrame, results: DataFrame) -> DataFrame:
    """One row a run: run_id, steps (answers heard), tool_calls, tokens_used, elapsed_ms, stop, ended_at, budget_exhausted and transcript, its calls in order."""
    each = stored(each, "turns")
    seen = dispatched(each.filter("called").select("run_id", "turn", "tool", "arguments"), results)
    step = F.struct("turn", "tool", "arguments", F.col("error").isNotNull().alias("failed"), "observation", "truncated", "error")
    script = seen.groupBy("run_id").agg(F.array_sort(F.collect_list(step)).alias("transcript"))
    last = F.max_by(F.struct("turn", "tokens_used", "calls", "elapsed_ms", "stop"), "turn").alias("e")
    ends = each.groupBy("run_id").agg(last, F.sum(F.col("answered").cast("long")).alias("steps"))
    out = ends.join(script, "run_id", "left")
    none = F.filter("transcript", lambda s: F.lit(False))
    empty = F.from_json(F.lit("[]"), script.schema["transcript"].dataType)
    return out.select("run_id", "steps", F.col("e.calls").alias("tool_calls"), "e.tokens_used", "e.elapsed_ms", "e.stop", F.col("e.turn").alias("ended_at"), F.col("e.stop").isin(*BUDGETS).alias("budget_exhausted"), F.coalesce("transcript", none, empty).alias("transcript"))


def outcomes(paths: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """trajectories with emitted, reason (why the run abstained), tier, evidence and confidence.

    The evidence guard of the hunted class sees the transcript up to the finding. A finding without a record has no prediction;
    one without a verdict isn't verified.
    """
    proposed = paths.filter("stop = 'finding'").withColumn("turn", F.col("ended_at"))
    one = lambda df, name: df.groupBy("run_id", F.col("turn").cast("int").alias("turn")).agg(F.first(F.struct(*[c for c in df.columns if c not in ("run_id", "turn")])).alias(name))
    joined = proposed.join(one(findings, "f"), ["run_id", "turn"], "left").join(one(verdicts, "v"), ["run_id", "turn"], "left")
    guarded = hunts.guarded(joined.select("run_id", "transcript", "f.*", "v"))
    evidence = hunts.d6_evidence(F.col("v.tier"), F.coalesce("v.evidence", F.lit("")))
    dead = F.col("drift_type") == hunts.TYPES[5]
    say = lambda head, errors: F.concat(F.lit(head), F.array_join(errors, "; "))
    why = (
        F.when(F.size("errors") > 0, say("policy evidence guard: ", F.col("errors"))).when(F.col("v").isNull(), "verification unavailable; refusing emission")
        .when(~F.coalesce("v.verified", F.lit(False)), F.coalesce("v.rejected", F.lit("finding was not verified"))).when(dead & (F.size(evidence) > 0), say("policy result guard: ", evidence))
    )
    judged = guarded.select("run_id", why.alias("why"), F.when(why.isNull(), F.col("v.tier")).alias("tier"), F.when(why.isNull(), F.col("v.evidence")).alias("evidence"))
    confidence = F.element_at(F.create_map(*(F.lit(x) for pair in hunts.CONFIDENCE.items() for x in pair)), F.col("tier"))
    out = paths.join(judged, "run_id", "left")
    emitted = (F.col("stop") == "finding") & F.col("why").isNull()
    return out.withColumns({"emitted": emitted, "reason": F.when(~emitted, F.coalesce("why", "stop")), "confidence": F.when(emitted, confidence)}).drop("why")


def replayed(runs: DataFrame, decisions: DataFrame, results: DataFrame, findings: DataFrame, verdicts: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """The outcome of every run (run_id); see outcomes()."""
    return outcomes(stored(trajectories(turns(runs, decisions, limits), results), "trajectories"), findings, verdicts)
