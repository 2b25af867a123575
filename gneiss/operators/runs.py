"""Runs of a system over instances: what it may see, what it is asked, what is kept of it, and what is left to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a system under test sees of an instance; everything else is gold.
VISIBLE = ("instance_id", "program", "files", "doc", "clause_id", "clause_text")
#: Lines shown around a locus.
AROUND = 10


def run_key(*parts: Column) -> Column:
    """A hash of the parts as JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256)


def context(instances: DataFrame, visible: tuple[str, ...] = VISIBLE) -> DataFrame:
    """instances without gold: the visible columns, by an allow-list."""
    return instances.select(*(c for c in visible if c in instances.columns))


def retrieval_context(instances: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """context() with passages: the k best texts found for each instance (instance_id, rank, text)."""
    own = hits.filter(F.col("rank") <= k).groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("passages"))
    return context(instances).join(own, "instance_id", "left").withColumn("passages", F.coalesce("passages", F.expr("cast(array() as array<string>)")))


def slice_context(instances: DataFrame, statements: DataFrame) -> DataFrame:
    """context() with the statements of the true slice (instance_id, line_start, text), in the order of lines."""
    own = statements.groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "text"))), lambda x: x["text"]).alias("statements"))
    return context(instances).join(own, "instance_id", "left").withColumn("statements", F.coalesce("statements", F.expr("cast(array() as array<string>)")))


def outcomes(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """One record an instance: answers (instance_id, predicted_type, abstained, failure) beside gold (instance_id, drift_type). No answer is a failure, and a failure has no prediction."""
    both = gold.join(answers, "instance_id", "left")
    infra = F.col("failure").isNotNull() | F.col("abstained").isNull()
    return both.withColumn("infra", infra).withColumn("failure", F.when(infra, F.coalesce("failure", F.lit("no answer")))).withColumn("abstained", F.when(infra, False).otherwise(F.col("abstained"))).withColumn("predicted_type", F.when(~F.col("infra") & ~F.col("abstained"), F.col("predicted_type")))


def left_to_do(wanted: DataFrame, done: DataFrame, key: str = "run_key") -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with those of equal key replaced by new ones, and the others of new added."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def coverage(records: DataFrame) -> DataFrame:
    """(answered, abstained, infra, reason, tier, n): how many records ended in each way."""
    said = ~F.col("abstained") & ~F.col("infra")
    return records.groupBy(said.alias("answered"), "abstained", "infra", "reason", "tier").agg(F.count("*").alias("n"))


# prompts ------------------------------------------------------------------------------------------------------------


def shown(lines: DataFrame, loci: DataFrame, around: int = AROUND) -> DataFrame:
    """(instance_id, ord, excerpt): the numbered lines about each locus (instance_id, ord, program, line_start, line_end), marked with > inside it."""
    l_ = lines.select(F.col("program").alias("p"), "line_no", F.rtrim("text").alias("text"))
    near = loci.join(l_, (F.col("program") == F.col("p")) & F.col("line_no").between(F.col("line_start") - around, F.col("line_end") + around))
    mark = F.when(F.col("line_no").between(F.col("line_start"), F.col("line_end")), ">").otherwise(" ")
    one = F.struct("line_no", F.concat(mark, F.lpad(F.col("line_no").cast("string"), 5, " "), F.lit("  "), F.col("text")).alias("t"))
    return near.groupBy("instance_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("excerpt"))


def judge_prompts(instances: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(instance_id, prompt): the claim, its clause and the excerpts; the answer is to be JSON of verdict and reason. instances: instance_id, drift_type, clause_text, rationale."""
    own = excerpts.groupBy("instance_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "excerpt"))), lambda x: x["excerpt"]), "\n--\n").alias("code"))
    said = F.format_string("Claimed: %s\nRule: %s\nReason: %s\nCode:\n%s\nAnswer with JSON: {\"verdict\": \"plausible\", \"implausible\" or \"unsure\", \"reason\": \"...\"}", "drift_type", "clause_text", "rationale", F.coalesce("code", F.lit("")))
    return instances.join(own, "instance_id", "left").select("instance_id", said.alias("prompt"))


def hunt_prompt(drift_type: Column, clause_text: Column, program: Column) -> Column:
    return F.format_string("Look for %s in %s against this rule, and show evidence from the tools or abstain:\n%s", drift_type, program, clause_text)


# entailment ---------------------------------------------------------------------------------------------------------

HOLDS = 0.5


def entailment_key(premise: Column, hypothesis: Column) -> Column:
    return F.sha1(F.concat_ws("␟", premise, hypothesis).cast("binary"))


def entailed(pairs: DataFrame, cache: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """pairs (premise, hypothesis) with score and holds, from a cache (key, score) or else a scorer of pairs (adds score); without one a miss is an error."""
    keyed = pairs.withColumn("key", entailment_key(F.col("premise"), F.col("hypothesis")))
    known = keyed.join(cache.select("key", "score"), "key", "left")
    if scorer is None:
        score = F.when(F.col("score").isNull(), F.raise_error(F.concat(F.lit("not cached: "), F.col("key"))).cast("double")).otherwise(F.col("score"))
        out = known.withColumn("score", score)
    else:
        missed = scorer(known.filter("score is null").select("key", "premise", "hypothesis").distinct()).select("key", F.col("score").alias("__s"))
        out = known.join(missed, "key", "left").withColumn("score", F.coalesce("score", "__s")).drop("__s")
    return out.withColumn("holds", F.col("score") >= HOLDS)


def entailment_cache(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, score) of the distinct pairs."""
    return scorer(pairs.select(entailment_key(F.col("premise"), F.col("hypothesis")).alias("key"), "premise", "hypothesis").distinct()).select("key", "score")


# plans of mutations -------------------------------------------------------------------------------------------------


def seed_plan(hosted: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, skipped): bases (program, record_id) with the clause they host, and the clauses (record_id) that no base hosts."""
    return hosted.join(clauses, "record_id"), clauses.join(hosted.select("record_id"), "record_id", "left_anti").select("record_id")


def regulated(leaves: DataFrame) -> DataFrame:
    """value: every number that a rule sets, whatever program it is for. leaves: value, as JSON; truth values and texts are none."""
    return leaves.filter(F.col("value").rlike(r"^-?\d+(\.\d+)?$")).select(F.col("value").cast("double").alias("value")).distinct()


def flattened(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, leaf) of every leaf of a column of current values in JSON, composites at any depth; paths are dotted, leaves left as JSON text.

    A composite's value holds named parts, each a value in turn; a leaf is the value of what is no composite, or itself where it has none. A
    round opens all composites of one depth, of all rows at once; there are as many as the deepest has levels. A null has one null leaf.
    """
    from gneiss.operators.store import stored

    todo, out = rows.select(key, F.lit(None).cast("string").alias("path"), F.col(value).alias("json")), None
    composite = F.coalesce(F.get_json_object("json", "$.kind") == "composite", F.lit(False))
    while True:
        todo = stored(todo, "values")
        leaf = todo.filter(~composite).select(key, "path", F.coalesce(F.get_json_object("json", "$.value"), F.col("json")).alias("leaf"))
        out = leaf if out is None else out.unionByName(leaf)
        inner = todo.filter(composite).select(key, "path", F.explode(F.map_entries(F.from_json(F.get_json_object("json", "$.value"), "map<string,string>"))).alias("e"))
        todo = inner.select(key, F.concat_ws(".", "path", "e.key").alias("path"), F.col("e.value").alias("json"))
        if todo.isEmpty():
            return out
