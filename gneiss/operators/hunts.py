"""Guards of findings and the ladder that verifies them, as expressions over rows.

A finding is one row:
    drift_type (that is hunted), predicted_type, has_prediction, same_clause (booleans), loci array<struct<program, paragraph, file,
    line_start, line_end>>, is_interprocedural, rationale, target_path, line_level array<struct<program, file, line>>, program_level,
    paragraph_level, literal, comparator, dead_paragraph (of its claim; null without), transcript array<struct<tool, failed boolean,
    observation>>, clause_kind, clause_values array<string>, clause_comparator, leaves map<path, struct<values array<string>,
    comparator>>.
Errors are arrays of short texts, empty if a finding is sound; a null counts as absent throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classes of drift, and what has to be looked at for each.
TYPES = ("D1_stale_threshold", "D2_missing_rule", "D3_contradictory", "D4_stale_reference_data", "D5_boundary_error", "D6_dead_code", "D7_conformant")
ABSENCE = ("find_callees", "find_callers", "grep", "slice_on")
TOKENS = {"strictly_greater": ">", "at_least": ">=", "strictly_less": "<", "at_most": "<=", "equal": "=", "not_equal": "<>"}
CONFIDENCE = {1: 0.95, 2: 0.85, 3: 0.60}
SHORTCUTS = (".git", "git log", "git diff", "mtime", "modified time", "provenance.mutation", "gold_rationale", "drift_type")


def tools_used(transcript: Column) -> Column:
    """The tools of the steps that worked and saw something, in order."""
    good = F.filter(transcript, lambda s: ~F.coalesce(s["failed"], F.lit(False)) & (F.coalesce(s["observation"], F.lit("")) != ""))
    return F.transform(good, lambda s: s["tool"])


def observations(transcript: Column, tool: str) -> Column:
    """What the steps of one tool that worked saw, those that are JSON."""
    own = F.filter(transcript, lambda s: (s["tool"] == tool) & ~F.coalesce(s["failed"], F.lit(False)))
    return F.filter(F.transform(own, lambda s: s["observation"]), lambda o: F.try_parse_json(o).isNotNull())


def missing_tools(transcript: Column, wanted: tuple[str, ...]) -> Column:
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), tools_used(transcript)))
    return F.when(F.size(lacking) > 0, F.concat(F.lit("missing tools: "), F.array_join(lacking, ", ")))


def _token(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in TOKENS.items() for x in pair)), name)


def _all(*errors: Column) -> Column:
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def _when(wrong: Column, said: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(True)), F.lit(said))


def guard(drift_type: str) -> Column:
    """The errors of a finding of this class."""
    t, has = F.col("transcript"), F.coalesce(F.col("has_prediction"), F.lit(False))
    used = tools_used(t)
    base = [F.when(~has, "no prediction"), F.when(has & ~F.coalesce(F.col("predicted_type") == drift_type, F.lit(False)), "type differs"), F.when(has & ~F.coalesce(F.col("same_clause"), F.lit(False)), "clause differs")]
    composite = F.coalesce(F.col("clause_kind") == "composite", F.lit(False))
    leaf = F.element_at("leaves", F.col("target_path"))
    no_path, no_leaf = composite & F.col("target_path").isNull(), composite & F.col("target_path").isNotNull() & leaf.isNull()
    path = [F.when(has & no_path, "no target path"), F.when(has & no_leaf, "target path leads nowhere")]
    comparator = F.when(composite, leaf["comparator"]).otherwise(F.col("clause_comparator"))
    values = F.when(composite, leaf["values"]).otherwise(F.col("clause_values"))
    names = lambda vs: F.exists(vs, lambda v: F.contains(F.lower("rationale"), F.lower(v)))
    read = missing_tools(t, ("read_paragraph",))
    n = lambda tool: F.size(F.filter(used, lambda x: x == tool))
    lacks_claim = F.col("literal").isNull() & F.col("comparator").isNull() & F.col("dead_paragraph").isNull()
    if drift_type == TYPES[0]:
        looked = F.arrays_overlap(used, F.array(F.lit("read_paragraph"), F.lit("resolve_copybook"), F.lit("grep")))
        in_file = F.exists("loci", lambda x: F.coalesce(x["file"], F.lit("")) != "")
        own = [F.when(~looked, read), F.when(in_file, missing_tools(t, ("resolve_copybook",))), F.when(F.col("clause_kind").isNull(), "no current value"), *path, F.when(has & values.isNotNull() & ~names(values), "rationale lacks the value"), F.when(F.col("literal").isNull(), "no literal")]
    elif drift_type == TYPES[1]:
        own = [missing_tools(t, ABSENCE)]
        for tool in ABSENCE:
            seen, empty = observations(t, tool), {"grep": "$.matches[0]", "slice_on": "$.statements[0]"}.get(tool, "$[0]")
            own += [F.when(F.size(seen) == 0, F.lit(f"{tool}: nothing seen")).when(F.exists(seen, lambda o: F.get_json_object(o, empty).isNotNull()), F.lit(f"{tool}: not absent"))]  # noqa: B023  # used at once
        own += [F.when(has & (F.coalesce(F.size("line_level"), F.lit(0)) <= 0), "no insertion point")]
    elif drift_type == TYPES[2]:
        programs = F.size(F.array_distinct(F.transform("loci", lambda x: x["program"])))
        own = [F.when(n("read_paragraph") < 2, "two paragraphs have to be read"), F.when(has & (F.size("loci") < 2), "one locus only"), F.when(has & (programs > 1) & ~F.col("is_interprocedural"), "several programs but not interprocedural"), F.when(has & ~F.lower("rationale").rlike("conflict|contradict|disagree"), "no conflict named"), F.when(has & lacks_claim, "no claim")]
    elif drift_type == TYPES[3]:
        own = [missing_tools(t, ("resolve_copybook",)), F.when(~F.coalesce(F.col("clause_kind") == "enum_set", F.lit(False)), "no set of values").when(has & ~names(F.col("clause_values")), "rationale lacks an entry")]
    elif drift_type == TYPES[4]:
        own = [read, F.when(~has | F.col("clause_kind").isNull(), "no typed value"), *path, F.when(has & comparator.isNull(), "clause has no comparator"), F.when(has & F.col("comparator").isNull(), "no source comparator").when(has & (F.col("comparator") == _token(comparator)), "comparators agree")]
    elif drift_type == TYPES[5]:
        own = [read, F.when(F.col("dead_paragraph").isNull(), "no dead paragraph")]
    else:
        conforms = (F.col("program_level") == "conformant") & (F.col("paragraph_level") == "conformant") & (F.coalesce(F.size("line_level"), F.lit(0)) <= 0)
        unproved = F.col("literal").isNull() & F.col("comparator").isNull()
        own = [read, F.when(has & ~F.coalesce(conforms, F.lit(False)), "labels aren't conformant"), F.when(has & unproved, "no literal or comparator"), *(F.when(~unproved, e) for e in path), F.when(has & ~unproved & F.col("comparator").isNotNull() & comparator.isNotNull() & (F.col("comparator") != _token(comparator)), "comparators differ")]
    return _all(*base, *own)


def guarded(findings: DataFrame) -> DataFrame:
    """findings with errors, by the guard of each one's class; a class that isn't known is an error."""
    errors = F.array(F.concat(F.lit("no hunt for "), F.coalesce("drift_type", F.lit("null"))))
    for t in TYPES:
        errors = F.when(F.col("drift_type") == t, guard(t)).otherwise(errors)
    return findings.withColumn("errors", errors)


def d6_evidence(tier: Column, evidence: Column) -> Column:
    """The errors of a verified D6 finding: dead code is what reachability says, and nothing else."""
    return _all(F.when(~F.coalesce(tier == 2, F.lit(False)), "reachability wasn't verified"), F.when(~F.coalesce(evidence.contains("forest_roots + reachable_from"), F.lit(False)), "no reachability evidence"))


# the ladder ---------------------------------------------------------------------------------------------------------


def executed(expected: Column, ran: Column) -> Column:
    """(outcome, detail) of running: ran is struct<available, compiled boolean, stdout>, as an executor gives it; expected what is to be seen, null without a probe."""
    out = lambda o, d: F.struct(F.lit(o).alias("outcome"), (F.lit(d) if isinstance(d, str) else d).alias("detail"))
    return (
        F.when(expected.isNull(), out("unavailable", "no probe")).when(ran.isNull() | ~F.coalesce(ran["available"], F.lit(False)), out("unavailable", "no executor"))
        .when(~F.coalesce(ran["compiled"], F.lit(False)), out("unavailable", "does not compile")).when(F.contains(ran["stdout"], expected), out("verified", F.concat(F.lit("seen: "), expected))).otherwise(out("refuted", F.concat(F.lit("not seen: "), expected)))
    )


def static(code: Column, literal: Column, comparator: Column, dead_paragraph: Column, reached: Column) -> Column:
    """(outcome, detail) by the code of the locus (null if there is none to read) or, for a dead paragraph, by whether it is reached (null: no graph)."""
    out = lambda o, d: F.struct(F.lit(o).alias("outcome"), (F.lit(d) if isinstance(d, str) else d).alias("detail"))
    dead = F.when(reached.isNull(), out("unavailable", "no graph")).when(reached, out("refuted", F.concat(dead_paragraph, F.lit(" is reached")))).otherwise(out("verified", F.concat(dead_paragraph, F.lit(" is not reached (forest_roots + reachable_from)"))))
    none = literal.isNull() & comparator.isNull()
    lacking = lambda x: x.isNotNull() & ~F.contains(code, x)
    read = F.when(code.isNull(), out("unavailable", "locus can't be read")).when(lacking(literal), out("refuted", F.concat(F.lit("absent: "), literal))).when(lacking(comparator), out("refuted", F.concat(F.lit("absent: "), comparator))).when(none, out("unavailable", "nothing to check")).otherwise(out("verified", F.concat_ws(" ", F.lit("present:"), literal, comparator)))
    return F.when(dead_paragraph.isNotNull(), dead).when(none & code.isNotNull(), out("unavailable", "no claim")).otherwise(read)


def entailed(holds: Column, score: Column) -> Column:
    """(outcome, detail) of whether the clause says what is claimed."""
    detail = F.concat(F.lit("P="), F.coalesce(score.cast("string"), F.lit("?")))
    return F.when(holds.isNull(), F.struct(F.lit("unavailable").alias("outcome"), F.lit("no entailer").alias("detail"))).otherwise(F.struct(F.when(holds, "verified").otherwise("refuted").alias("outcome"), detail.alias("detail")))


def verified(rows: DataFrame, one: Column, two: Column, three: Column, citation_ok: Column) -> DataFrame:
    """rows with attempts array<struct<tier, outcome, detail>>, tier, verified, evidence, confidence and rejected.

    Tiers are tried in order up to the first that verifies. A clause that doesn't say what is claimed rejects the finding, whatever
    the code shows: its evidence is kept and its tier isn't. one, two and three are what executed(), static() and entailed() give;
    any other executor's struct<outcome, detail> does as well, and null means there is none.
    """
    each = [F.coalesce(x, F.struct(F.lit("unavailable").alias("outcome"), F.lit("none").alias("detail"))) for x in (one, two, three)]
    out = rows.withColumn("__a", F.array(*(F.struct(F.lit(i).alias("tier"), x["outcome"].alias("outcome"), x["detail"].alias("detail")) for i, x in enumerate(each, 1))))
    at = F.get(F.filter("__a", lambda a: a["outcome"] == "verified"), F.lit(0))
    out = out.withColumn("__at", at).withColumn("__c", F.coalesce(citation_ok, F.lit(False)))
    ok = F.col("__at").isNotNull() & F.col("__c")
    confidence = F.element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair)), F.col("__at.tier"))
    out = out.withColumns({
        "attempts": F.slice("__a", 1, F.coalesce("__at.tier", F.lit(3))), "verified": ok, "tier": F.when(ok, F.col("__at.tier")), "evidence": F.coalesce("__at.detail", F.lit("no tier verifies it")),
        "confidence": F.when(ok, confidence), "rejected": F.when(F.col("__at").isNull(), "unverifiable").when(~F.col("__c"), "citation"),
    })
    return out.drop("__a", "__at", "__c")


def best_of(outcomes: DataFrame, key: str = "instance_id") -> DataFrame:
    """One row a key: the verified outcome of most confidence, then lowest tier, then first hunt; if none is verified, the first hunt's. outcomes: key, hunt, verified, confidence, tier."""
    order = F.struct((~F.col("verified")).alias("a"), F.when(F.col("verified"), -F.col("confidence")).alias("b"), F.when(F.col("verified"), F.col("tier")).alias("c"), "hunt")
    return outcomes.groupBy(key).agg(F.min_by(F.struct(*outcomes.columns), order).alias("r")).select("r.*")


def assessed(records: DataFrame) -> DataFrame:
    """records with replayable, evidence_path_ok, code_fact_ok, budget_ok, shortcut_free and reasons.

    records: predicted_type, transcript, tier, evidence, verified, has_finding, gold_lines and predicted_lines (arrays of
    struct<program, file, line>), token_counts array, tokens_used, max_steps, max_tool_calls, max_tokens. A null transcript is no
    trajectory.
    """
    t = F.col("transcript")
    used = F.transform(F.filter(t, lambda s: ~F.coalesce(s["failed"], F.lit(False))), lambda s: s["tool"])
    kind = F.col("predicted_type")
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), used)) == 0
    path = (
        F.when(kind == TYPES[0], F.arrays_overlap(used, F.array(*map(F.lit, ("read_paragraph", "resolve_copybook", "grep"))))).when(kind == TYPES[1], has(*ABSENCE))
        .when(kind == TYPES[2], F.size(F.filter(used, lambda x: x == "read_paragraph")) >= 2).when(kind == TYPES[3], has("resolve_copybook")).otherwise(has("read_paragraph"))
    )
    path = F.coalesce(path & kind.isNotNull(), F.lit(False))
    shared = F.array_intersect("predicted_lines", "gold_lines")
    seen = F.lower(F.array_join(F.transform(t, lambda s: s["observation"]), " "))
    grounded = F.exists(shared, lambda x: F.contains(seen, F.lower(x["program"])) & F.contains(seen, x["line"].cast("string")))
    fact = (
        F.when(kind == TYPES[5], (F.col("tier") == 2) & F.col("evidence").contains("forest_roots + reachable_from")).when(kind == TYPES[1], F.size(shared) > 0)
        .when(kind == TYPES[6], path & (F.coalesce(F.size("predicted_lines"), F.lit(0)) <= 0)).otherwise(grounded)
    )
    fact = F.coalesce(fact & kind.isNotNull(), F.lit(False))
    spent = F.aggregate("token_counts", F.lit(0).cast("long"), lambda s, x: s + x)
    budget = (F.size(t) <= F.col("max_tool_calls")) & (F.size("token_counts") <= F.col("max_steps")) & (spent == F.col("tokens_used")) & (F.col("tokens_used") <= F.col("max_tokens"))
    said = F.lower(F.to_json(t))
    clean = ~F.exists(F.array(*map(F.lit, SHORTCUTS)), lambda s: F.contains(said, s))
    unverified = F.col("has_finding") & ~F.coalesce(F.col("verified"), F.lit(False))
    none = t.isNull()
    out = records.withColumns({
        "replayable": ~none & ~F.coalesce(unverified, F.lit(False)), "evidence_path_ok": ~none & path, "code_fact_ok": ~none & fact,
        "budget_ok": ~none & F.coalesce(budget, F.lit(False)), "shortcut_free": none | F.coalesce(clean, F.lit(True)),
    })
    wrong = _all(F.when(~F.col("evidence_path_ok"), "evidence path"), F.when(~F.col("code_fact_ok"), "code fact"), F.when(~F.col("budget_ok"), "budget"), F.when(~F.col("shortcut_free"), "shortcut"), F.when(F.coalesce(unverified, F.lit(False)), "unverified finding"))
    return out.withColumn("reasons", F.when(none, F.array(F.lit("no trajectory"))).otherwise(wrong))


def faithful(records: DataFrame, key: str = "instance_id") -> DataFrame:
    """faithful: the citation is the gold clause, whole, and the assessment found path, fact and no shortcut; a record without one isn't."""
    same = (F.col("cited_doc") == F.col("gold_doc")) & (F.col("cited_clause") == F.col("gold_clause")) & F.col("cited_version").eqNullSafe(F.col("gold_version")) & (F.col("cited_text") == F.col("gold_text"))
    flags = F.col("evidence_path_ok") & F.col("code_fact_ok") & F.col("shortcut_free")
    return records.withColumn("faithful", F.coalesce(same & flags, F.lit(False)))
