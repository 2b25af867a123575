"""Dealing instances into splits by group, sampling by class, and the judge's policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.store import stored

SPLITS = ("train", "dev", "test")
#: The shares of the splits.
SHARES = (0.5, 1 / 6, 1 / 3)


def operator_of(note: Column) -> Column:
    """The operator that a mutation note begins with."""
    return F.trim(F.split(note, ";", 2)[0])


#: Groups that one round moves at most, and the share of a cell's rows that it may be off its target.
BATCH, TOLERANCE = 1_000, 0.005


def _draw(seed: int, group: str) -> Column:
    """A number in [0, 1) by a hash of seed and group."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _drawn(draw: Column, shares: tuple[float, ...]) -> Column:
    out = F.lit(SPLITS[-1])
    for k in range(len(SPLITS) - 2, -1, -1):
        out = F.when(draw < sum(shares[: k + 1]), SPLITS[k]).otherwise(out)
    return out


class _Dealt:
    """Groups with their split and cells; held in the shared folder, moved round by round. The driver sees a cell's sums and the groups of one move."""

    def __init__(self, cells: DataFrame, seed: int, shares: tuple[float, ...]):
        # cells: group, cell, type, n, fixed
        self.seed = seed
        spark = cells.sparkSession
        self.rows = stored(cells.withColumn("split", F.when(F.col("fixed"), "test").otherwise(_drawn(_draw(seed, "group"), shares))), "dealt")
        share = spark.createDataFrame(list(zip(SPLITS, map(float, shares), strict=True)), "split string, share double")
        totals = cells.groupBy("cell").agg(F.sum("n").alias("total"))
        self.want = stored(totals.crossJoin(F.broadcast(share)).select("cell", "split", "total", (F.col("total") * F.col("share")).alias("want")), "want")  # three rows a cell

    def off(self) -> DataFrame:
        """cell, split, total and d, how many rows a split has beyond its target."""
        held = self.rows.groupBy("cell", "split").agg(F.sum("n").alias("n"))
        return self.want.join(held, ["cell", "split"], "left").select("cell", "split", "total", (F.coalesce("n", F.lit(0)) - F.col("want")).alias("d"))

    def move(self, groups: list, to: str) -> None:
        moved = F.broadcast(self.rows.sparkSession.createDataFrame([(g,) for g in groups], self.rows.select("group").schema))
        here = self.rows.join(moved.withColumn("__to", F.lit(to)), "group", "left")
        self.rows = stored(here.withColumn("split", F.coalesce("__to", "split")).drop("__to"), "dealt")

    def balance(self) -> None:
        """Move groups while a cell's counts come nearer to the targets, by squared distance over all cells."""
        stuck: set[tuple] = set()
        while True:
            off = stored(self.off(), "off")
            a, b = off.alias("a"), off.alias("b")
            pairs = a.join(b, F.expr("a.cell = b.cell AND a.d > 0 AND b.d < 0")).select("a.cell", F.col("a.split").alias("s"), F.col("b.split").alias("t"), F.least("a.d", -F.col("b.d")).alias("need"), "a.total")
            pairs = pairs.filter(F.col("need") > F.greatest(F.lit(0.5), TOLERANCE * F.col("total")))
            worst = next((r for r in pairs.orderBy(F.desc("need"), "cell", "s", "t").limit(len(stuck) + 1).collect() if (r["cell"], r["s"], r["t"]) not in stuck), None)
            if worst is None:
                return
            source, to = off.filter(F.col("split") == worst["s"]).select("cell", F.col("d").alias("ds")), off.filter(F.col("split") == worst["t"]).select("cell", F.col("d").alias("dt"))
            free = self.rows.filter(~F.col("fixed") & (F.col("split") == worst["s"]))
            change = F.sum(2 * F.col("n") * (F.col("n") - F.col("ds") + F.col("dt")))
            scored = free.join(source, "cell").join(to, "cell").groupBy("group").agg(change.alias("change"), F.sum(F.when(F.col("cell") == worst["cell"], F.col("n")).otherwise(0)).alias("n"))
            best = scored.filter("n > 0 AND change < -1e-9").orderBy("change", _draw(self.seed, "group"), "group").limit(BATCH).collect()
            if not best:
                stuck.add((worst["cell"], worst["s"], worst["t"]))
                continue
            stuck.clear()
            taken, n = [], 0
            for r in best:
                if taken and n + r["n"] > worst["need"]:
                    break
                taken.append(r["group"])
                n += r["n"]
            before, cost = self.rows, off.agg(F.sum(F.col("d") * F.col("d"))).first()[0]
            self.move(taken, worst["t"])
            if len(taken) > 1 and self.off().agg(F.sum(F.col("d") * F.col("d"))).first()[0] >= cost:  # together they overshoot elsewhere
                self.rows = before
                self.move(taken[:1], worst["t"])

    def repair(self, floors: DataFrame) -> None:
        """Move groups into splits that have fewer rows of a type than their floor, from splits that stay at or above theirs; what can't be met is left."""
        floors = stored(floors.select("split", F.col("drift_type").alias("type"), F.col("floor").cast("long").alias("floor")), "floors")
        given_up: set[tuple] = set()
        while True:
            held = self.rows.groupBy("split", "type").agg(F.sum("n").alias("n"))
            grid = stored(held.join(floors, ["split", "type"], "full").select("split", "type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("floor", F.lit(0)).alias("floor")), "grid")
            low = grid.filter("n < floor").orderBy(F.desc(F.col("floor") - F.col("n")), "split", "type").limit(len(given_up) + 1).collect()
            low = next((r for r in low if (r["split"], r["type"]) not in given_up), None)
            if low is None:
                return
            spare = grid.select("split", "type", (F.col("n") - F.col("floor")).alias("spare"))
            free = self.rows.filter(~F.col("fixed") & (F.col("split") != low["split"])).groupBy("group", "split", "type").agg(F.sum("n").alias("n")).join(spare, ["split", "type"])
            able = free.groupBy("group", "split").agg(F.min(F.col("spare") - F.col("n")).alias("left"), F.sum("n").alias("rows"), F.sum(F.when(F.col("type") == low["type"], F.col("n")).otherwise(0)).alias("n"))
            best = able.filter("n > 0 AND left >= 0").orderBy(F.desc(F.col("n") / F.col("rows")), _draw(self.seed, "group"), "group").first()
            if best is None:
                given_up.add((low["split"], low["type"]))
                continue
            self.move([best["group"]], low["split"])


def build_splits(instances: DataFrame, seed: int, shares: tuple[float, ...] = SHARES, floors: DataFrame | None = None) -> DataFrame:
    """instances (base, drift_type, is_interprocedural, real) with split. Groups are bases; those with a real instance go to test.

    Groups are dealt by a hash of seed and base, which keeps the shares in expectation; then whole groups are moved until each cell (type and
    stratum) is within TOLERANCE of its target or no move helps, and, with floors (split, drift_type, floor), until each split has as many of
    a type as its floor asks or no move can give them without taking another split below its own. Every round scores all moves in Spark: a
    bases' table is read and written, and the driver sees one cell and at most BATCH groups. split_errors() tells what is left.
    """
    cell = F.concat_ws("/", "drift_type", F.when(F.col("is_interprocedural"), "interprocedural").otherwise("local"))
    cells = instances.groupBy(F.col("base").alias("group"), cell.alias("cell"), F.col("drift_type").alias("type")).agg(F.count("*").alias("n"))
    real = instances.filter("real").select(F.col("base").alias("group"), F.lit(True).alias("fixed")).distinct()
    dealt = _Dealt(cells.join(real, "group", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False))), seed, shares)
    dealt.balance()
    if floors is not None:
        dealt.repair(floors)
    return instances.join(dealt.rows.select(F.col("group").alias("base"), "split").distinct(), "base", "left")


def split_errors(dealt: DataFrame, floors: DataFrame) -> DataFrame:
    """(problem, what, n): groups in several splits, rows without one, and cells below their floor. floors: split, drift_type, floor."""
    torn = dealt.groupBy("base").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("group in several splits").alias("problem"), F.col("base").alias("what"), "n")
    loose = dealt.filter("split is null").groupBy("base").agg(F.count("*").alias("n")).select(F.lit("no split").alias("problem"), F.col("base").alias("what"), "n")
    counts = dealt.groupBy("split", "drift_type").agg(F.count("*").alias("n"))
    low = floors.join(counts, ["split", "drift_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).filter("n < floor").select(F.lit("below its floor").alias("problem"), F.concat_ws("/", "split", "drift_type").alias("what"), "n")
    return torn.unionByName(loose).unionByName(low)


def group_split(rows: DataFrame, group: str, seed: int, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """rows with split, drawn by a hash of the group: no counts and no shuffle, for any number of groups; shares hold in expectation."""
    return rows.withColumn("split", _drawn(_draw(seed, group), shares))


def stratified_sample(rows: DataFrame, n: int, seed: str, by: str = "drift_type", stratum: str = "is_interprocedural", key: str = "instance_id") -> DataFrame:
    """n rows: one of each class, both strata as far as there are any, then class by class in turn; each class in the order of a hash of seed and key."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
    ranked = rows.withColumn("__k", rank).filter(F.col("__k") <= n)
    best = rows.withColumn("__o", order).groupBy(stratum).agg(F.min(F.struct("__o", key)).alias("__f")).select(F.col(f"__f.{key}").alias(key), F.lit(1).alias("__must"))
    # the first of a stratum that the first of each class leaves out comes right after these
    firsts = ranked.filter("__k = 1").select(stratum).distinct().withColumn("__has", F.lit(1))
    need = rows.join(best, key, "left_semi").join(firsts, stratum, "left_anti").select(key, F.lit(0).alias("__turn"))
    late = ranked.join(need, key, "left").withColumn("__turn", F.when(F.col("__k") == 1, -1).otherwise(F.coalesce("__turn", "__k")))
    extra = rows.join(need, key).withColumn("__k", F.lit(n + 1)).select(*late.columns)
    return late.unionByName(extra).withColumn("__d", F.row_number().over(Window.partitionBy(key).orderBy("__turn"))).filter("__d = 1").orderBy("__turn", by, key).limit(n).drop("__k", "__turn", "__d")


def drop_policy(verdicts: DataFrame, overrides: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(instance_id, raw, effective, fate, overridden). verdicts, overrides and adjudications: instance_id, verdict.

    An override counts before an adjudication of an unsure one, and that before the raw verdict; an override that changes nothing, or is
    of no judged instance, is an error. fate is kept (plausible), dropped (implausible) or held (unsure).
    """
    o = overrides.select("instance_id", F.col("verdict").alias("over"))
    a = adjudications.select("instance_id", F.col("verdict").alias("ruled"))
    both = verdicts.select("instance_id", F.col("verdict").alias("raw")).join(o, "instance_id", "full").join(a, "instance_id", "left")
    wrong = F.when(F.col("raw").isNull(), F.lit("override of nothing judged: ")).when(F.col("over") == F.col("raw"), F.lit("override changes nothing: "))
    effective = F.coalesce("over", F.when(F.col("raw") == "unsure", F.col("ruled")), "raw")
    effective = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("instance_id").cast("string"))).cast("string")).otherwise(effective)
    out = both.select("instance_id", "raw", effective.alias("effective"), F.col("over").isNotNull().alias("overridden"))
    return out.withColumn("fate", F.when(F.col("effective") == "plausible", "kept").when(F.col("effective") == "implausible", "dropped").otherwise("held"))


def override_metrics(policy: DataFrame) -> DataFrame:
    """(n, overridden, rate) of what drop_policy() gives."""
    return policy.agg(F.count("*").alias("n"), F.sum(F.col("overridden").cast("int")).alias("overridden")).withColumn("rate", F.round(F.col("overridden") / F.greatest(F.col("n"), F.lit(1)), 9))


def parse_verdict(text: Column) -> Column:
    """struct<verdict, reason> of a judge's answer: JSON of just these, with a verdict that there is. Anything else is an error."""
    map_ = F.from_json(text, "map<string,string>")
    ok = F.coalesce(F.array_sort(F.map_keys(map_)) == F.array(F.lit("reason"), F.lit("verdict")), F.lit(False)) & F.coalesce(F.element_at(map_, "verdict").isin("plausible", "implausible", "unsure"), F.lit(False)) & (F.trim(F.coalesce(F.element_at(map_, "reason"), F.lit(""))) != "")
    verdict = F.when(ok, F.element_at(map_, "verdict")).otherwise(F.raise_error(F.concat(F.lit("no verdict: "), F.coalesce(F.substring(text, 1, 80), F.lit("null")))).cast("string"))
    return F.struct(verdict.alias("verdict"), F.element_at(map_, "reason").alias("reason"))


#: How models' names tell their families.
FAMILIES = {"claude": "anthropic", "gpt": "openai", "o1": "openai", "gemini": "google", "gemma": "google", "llama": "meta", "mistral": "mistral", "mixtral": "mistral", "qwen": "alibaba", "deepseek": "deepseek"}


def family_of(model: Column) -> Column:
    """The family that a model's name tells, or null."""
    out = F.lit(None).cast("string")
    for start, family in reversed(FAMILIES.items()):
        out = F.when(F.lower(F.trim(model)).rlike(rf"(^|[/:_ -]){start}"), family).otherwise(out)
    return out


def independent(judge_model: Column, judge_family: Column, system_family: Column) -> Column:
    """An error text, or null: a judge has to say its family, truly, and it must not be the system's."""
    own, named = F.lower(F.trim(judge_family)), family_of(judge_model)
    return F.when(F.coalesce(own, F.lit("")) == "", "no family").when(named.isNotNull() & (named != own), "name and family differ").when(own == F.lower(F.trim(system_family)), "judge is of the system's family")


def semantic_mutations(instances: DataFrame) -> DataFrame:
    """(drift_type, n, distinct): instances, and different edits among them: of one base, operator and old and new fragment."""
    return instances.groupBy("drift_type").agg(F.count("*").alias("n"), F.count_distinct("base", "op", "old", "new").alias("distinct"))


def reconstructed(known: DataFrame, built: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, problem) of every instance that only one of two sets has, or that both have with another text."""
    a, b = known.select(key, F.col("text").alias("a")), built.select(key, F.col("text").alias("b"))
    both = a.join(b, key, "full").withColumn("problem", F.when(F.col("b").isNull(), "not rebuilt").when(F.col("a").isNull(), "not known").when(F.col("a") != F.col("b"), "differs"))
    return both.filter("problem is not null").select(key, "problem")
