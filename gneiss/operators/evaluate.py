"""Evaluation operators over records of gold and prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import ratio
from gneiss.operators.store import stored


#: Rows of two numbers that are broadcast.
BROADCAST_ROWS = 500_000


def _n(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def detection(records: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts, precision, recall and F1. records: gold, predicted, abstained and, if there, infra (booleans).

    Abstaining is a miss only where gold is positive. Rows that an infrastructure error (infra) left without an answer don't count.
    """
    if "infra" in records.columns:
        records = records.filter(~F.col("infra"))
    said = ~F.col("abstained")
    counts = records.groupBy(*by).agg(
        _n(said & F.col("gold") & F.col("predicted")).alias("tp"),
        _n(said & ~F.col("gold") & F.col("predicted")).alias("fp"),
        _n(F.col("gold") & (F.col("abstained") | ~F.col("predicted"))).alias("fn"),
        _n(said & ~F.col("gold") & ~F.col("predicted")).alias("tn"),
        F.count("*").alias("n"),
        _n(said).alias("answered"),
    )
    return rates(counts)


def rates(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": F.round(p, 9), "recall": F.round(r, 9), "f1": F.round(ratio(2 * p * r, p + r), 9), "answer_rate": F.round(ratio(F.col("answered"), F.col("n")), 9), "answered_accuracy": F.round(ratio(F.col("tp") + F.col("tn"), F.col("answered")), 9)})


def strata(records: DataFrame, by: str) -> DataFrame:
    """detection() overall and for each value of by; stratum is `all` overall."""
    more = ["infra"] if "infra" in records.columns else []
    spread = records.select(F.explode(F.array(F.lit("all"), F.col(by).cast("string"))).alias("stratum"), "gold", "predicted", "abstained", *more)
    return detection(spread, ["stratum"])


def classification(records: DataFrame, classes: list[str]) -> DataFrame:
    """Per-class precision, recall, F1 and support; one pass over the records. records: gold, predicted."""
    each = records.select(F.explode(F.array(*map(F.lit, classes))).alias("label"), "gold", "predicted")
    hit, said, true = F.col("gold").eqNullSafe(F.col("predicted")) & (F.col("gold") == F.col("label")), F.col("predicted") == F.col("label"), F.col("gold") == F.col("label")
    counts = each.groupBy("label").agg(_n(hit).alias("tp"), _n(said).alias("said"), _n(true).alias("support"))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return counts.select("label", "tp", "support", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(ratio(2 * p * r, p + r), 9).alias("f1"))


def macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.sum("support").alias("support"))


def localization(records: DataFrame, k: int) -> DataFrame:
    """Accuracy at k and mean Jaccard of gold and predicted arrays."""
    inter, union = F.size(F.array_intersect("gold", "predicted")), F.size(F.array_union("gold", "predicted"))
    hit = F.coalesce(F.arrays_overlap("gold", F.slice("predicted", 1, k)), F.lit(False))
    return records.agg(F.count("*").alias("n"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 9).alias("accuracy"), F.round(F.avg(ratio(inter, union)), 9).alias("jaccard"))


def calibration(records: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of confidence: count, mean confidence, accuracy. records: confidence, correct."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return records.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def brier_ece(records: DataFrame, bins: int = 10) -> DataFrame:
    right = F.when(F.col("correct"), 1.0).otherwise(0.0)
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    binned = records.groupBy(at.alias("bin")).agg(F.count("*").alias("m"), F.sum("confidence").alias("c"), F.sum(right).alias("r"), F.sum((F.col("confidence") - right) * (F.col("confidence") - right)).alias("b"))
    return binned.agg(F.sum("m").alias("n"), F.round(F.sum("b") / F.sum("m"), 6).alias("brier"), F.round(F.sum(F.abs(F.col("c") - F.col("r"))) / F.sum("m"), 6).alias("ece"))


def faithfulness(records: DataFrame) -> DataFrame:
    """Cited and faithful counts of each tier and of all (tier null)."""
    return records.rollup("tier").agg(F.count("*").alias("n"), _n(F.col("faithful")).alias("n_faithful"), F.round(F.avg(F.when(F.col("faithful"), 1.0).otherwise(0.0)), 9).alias("rate"))


def versioned(records: DataFrame) -> DataFrame:
    """Loci with exactly two rows, two versions and two verdicts. records: locus, version, verdict, correct."""
    return records.groupBy("locus").agg(F.count("*").alias("n"), F.countDistinct("version").alias("versions"), F.countDistinct("verdict").alias("verdicts"), F.min(F.when(F.col("correct"), 1).otherwise(0)).alias("both_right")).filter("n = 2 and versions = 2 and verdicts = 2").select("locus", "both_right")


def before(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """rows with before: the sum of value over the rows of the same group that come earlier. Groups are cut into ranges, whose sums are added up."""
    dealt = rows.repartitionByRange(*by, order).withColumn("__p", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    whole = dealt.groupBy(*by, "__p").agg(F.sum(value).alias("__s"))  # a row a group and range
    earlier = whole.withColumn("__e", F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__i", inside).join(earlier, [*by, "__p"]).withColumn("before", F.col("__i") + F.col("__e")).drop("__p", "__i", "__e")


def auc(records: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Mann-Whitney AUC, ties a half, from counts of each value, in ranges of values: no task sorts them all. records: positive (boolean)."""
    counts = records.groupBy(*by, F.col(value).alias("v")).agg(_n(F.col("positive")).alias("p"), _n(~F.col("positive")).alias("q"))
    return before(counts, list(by), "v", "q").withColumnRenamed("before", "below").groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u")).select(*by, "n_pos", "n_neg", F.round(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).otherwise(0.5), 9).alias("auc"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    from math import exp, lgamma, log

    if p <= 0 or p >= 1:
        return 1.0 if p <= 0 or k >= n else 0.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1)))


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson, by bisection, for a pair of counts."""

    def solve(above) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if above(mid) else (low, mid)
        return (low + high) / 2

    if not 0 <= k <= n or n == 0:
        raise ValueError(f"{k} of {n} is no share")
    tail = (1 - level) / 2
    return (0.0 if k == 0 else solve(lambda p: 1 - binomial_cdf(k - 1, n, p) < tail)), (1.0 if k == n else solve(lambda p: binomial_cdf(k, n, p) > tail))


def _drawn(pairs: DataFrame, draws: int, seed: int, totals, columns: str) -> DataFrame:
    """draw and the sums of totals(rng, delta, n, draws) over the distinct deltas; each has its own stream by seed and value, however the rows are dealt."""

    def run(batches):
        import struct

        import numpy as np
        import pyarrow as pa

        sums = None
        for batch in batches:
            for delta, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array(totals(np.random.default_rng([seed, struct.unpack("<Q", struct.pack("<d", delta))[0]]), delta, n, draws), float)
                sums = own if sums is None else sums + own
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(1, draws + 1), pa.int64()), *map(pa.array, sums)], names=["draw", *columns.split()])

    groups = pairs.filter("delta is not null").groupBy(F.col("delta").cast("double").alias("delta")).agg(F.count("*").alias("n"))
    each = groups.mapInArrow(run, ", ".join(["draw long", *(f"{c} double" for c in columns.split())]))
    return each.groupBy("draw").agg(*(F.sum(c).alias(c) for c in columns.split()))


def resampled(pairs: DataFrame, draws: int, seed: int) -> DataFrame:
    """Poisson-bootstrap means of delta, a draw: n equal deltas weigh Poisson(n) together. pairs: id, delta."""

    def totals(rng, delta, n, draws):
        weight = rng.poisson(n, draws)
        return weight, weight * delta

    return _drawn(pairs, draws, seed, totals, "w wd").select("draw", (F.col("wd") / F.greatest(F.col("w"), F.lit(1.0))).alias("mean"))


def exact_resampled(pairs: DataFrame, draws: int, seed: int, key: str = "id") -> DataFrame:
    """draw (from 0), n and mean of delta over resamples of exactly as many rows as there are, drawn with replacement.

    Pick j of a draw is the row whose number is an md5 of seed, draw and j, modulo the count. Rows are numbered in the order of their key's
    md5, then key: within buckets of equal first digits, plus the rows of the buckets before, so no task sorts them all. Picks are made
    where they are joined: with the rows broadcast while they are few, by a shuffle of numbers beyond that. Rows without a delta are left out; without
    any row there is no draw.
    """
    own = pairs.filter("delta is not null").select(F.md5(F.col(key).cast("string").cast("binary")).alias("h"), F.col(key).alias("key"), F.col("delta").cast("double").alias("delta")).withColumn("bucket", F.substring("h", 1, 3))
    sizes = own.groupBy("bucket").agg(F.count("*").alias("size"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).select("bucket", "before")  # 4,096 rows at most
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "key"))
    numbered = stored(own.withColumn("k", inside).join(F.broadcast(before), "bucket").select((F.col("before") + F.col("k") - 1).alias("at"), "delta"), "numbered")
    n = numbered.count()
    if not n:
        return numbered.sparkSession.createDataFrame([], "draw long, n long, mean double")
    j, draw = F.col("id") % n, F.expr(f"id div {n}L")
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), j.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % n
    picks = numbered.sparkSession.range(draws * n).select(draw.alias("draw"), pick.alias("at"))
    rows = F.broadcast(numbered) if n <= BROADCAST_ROWS else numbered
    return picks.join(rows, "at").groupBy("draw").agg(F.count("*").alias("n"), (F.sum("delta") / n).alias("mean"))


def randomization_p(pairs: DataFrame, draws: int, seed: int) -> DataFrame:
    """Sign-flip p of the mean delta: (extreme + 1) / (draws + 1). Of n equal deltas, Binomial(n, 1/2) keep their sign."""

    def totals(rng, delta, n, draws):
        return (2 * rng.binomial(n, 0.5, draws) - n) * delta, [n * delta] * draws

    flipped = _drawn(pairs, draws, seed, totals, "s o").select(F.abs("s").alias("s"), F.abs("o").alias("o"))
    return flipped.agg(((_n(F.col("s") >= F.col("o") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def unique(records: DataFrame, key: str) -> DataFrame:
    """records; a key that occurs twice is an error, found as the result is made."""
    n = records.groupBy(key).agg(F.count("*").alias("__n"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("several records of "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return records.join(n, key).filter(checked).select(*records.columns)


def located(records: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """(dimension, k, n, accuracy, overlap) over rows whose gold is drift.

    records: drift, answered (neither abstained nor an infrastructure error, and drift predicted), and for each dimension of programs,
    paragraphs and lines the arrays gold_<dimension> and predicted_<dimension>. Accuracy and overlap (Jaccard) are shares of all
    such rows, answered or not; rows without gold values add nothing to the overlap.
    """
    rows = []
    for d in ("programs", "paragraphs", "lines"):
        gold, said = F.array_distinct(F.col(f"gold_{d}")), F.array_distinct(F.col(f"predicted_{d}"))
        both = F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, said)) / F.size(F.array_union(gold, said))).otherwise(0.0)
        for k in ks:
            rows.append(F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("k"), (F.size(F.array_intersect(gold, F.slice(said, 1, k))) > 0).alias("hit"), both.alias("overlap")))
    each = records.filter("drift").select("answered", F.explode(F.array(*rows)).alias("x")).select("x.*", "answered")
    share = lambda v: F.round(F.sum(F.when(F.col("answered"), v).otherwise(0.0)) / F.count("*"), 9)
    return each.groupBy("dimension", "k").agg(F.count("*").alias("n"), share(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("accuracy"), share(F.col("overlap")).alias("overlap"))


def paired(left: DataFrame, right: DataFrame, key: str = "instance_id") -> DataFrame:
    """One row a key that both have: (key, a, b) of their column correct."""
    return left.select(key, F.col("correct").alias("a")).join(right.select(key, F.col("correct").alias("b")), key)


#: What has to be met, and the draws of the interval.
LEAST_F1, LEAST_DELTA, MOST_P, LEAST_PAIRS = 0.70, 0.10, 0.05, 20


def go_no_go(facts: DataFrame) -> DataFrame:
    """status, issues and the decisions behind it, for each row of facts.

    facts: n_agent, n_dense, n_oracle (records of each system), labels_complete, pairs (that flip a verdict), infra (failures),
    fully_paired, f1, delta, low (of its interval), p. Whatever is missing makes it NOT_EVALUABLE and is an issue.
    """
    missing = [F.when(F.coalesce(F.col(f"n_{s}"), F.lit(0)) == 0, F.lit(f"{s}: no records")) for s in ("agent", "dense", "oracle")]
    early = F.filter(F.array(*missing, F.when(~F.col("labels_complete"), F.lit("labels are incomplete"))), lambda x: x.isNotNull())
    late = F.filter(F.array(F.when(F.col("pairs") < LEAST_PAIRS, F.concat(F.lit("pairs: "), F.col("pairs").cast("string"))), F.when(F.col("infra") > 0, F.lit("infrastructure failures")), F.when(~F.col("fully_paired"), F.lit("rows are not fully paired"))), lambda x: x.isNotNull())
    issues = F.when(F.size(early) > 0, early).otherwise(late)
    f1_met = F.col("f1") >= LEAST_F1
    delta_met = (F.col("delta") >= LEAST_DELTA) & (F.col("low") > 0) & (F.col("p") < MOST_P)
    status = F.when(F.size("issues") > 0, "NOT_EVALUABLE").when(f1_met & delta_met, "GO").otherwise("NO_GO")
    sound = F.size("issues") == 0
    return facts.withColumn("issues", issues).withColumn("status", status).withColumn("f1_met", F.when(sound, f1_met)).withColumn("delta_met", F.when(sound, delta_met))


def shortfalls(counts: DataFrame, floors: DataFrame, strict: bool = False) -> DataFrame:
    """(name, floor, n, short) of every floor (name, floor); counts (name, n). With strict an unmet one is an error."""
    out = floors.join(counts, "name", "left").select("name", "floor", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    out = out.withColumn("short", F.greatest(F.lit(0), F.col("floor") - F.col("n")).cast("long"))
    if strict:
        failed = F.when(F.col("short") > 0, F.raise_error(F.concat(F.lit("floor not met: "), F.col("name"))).cast("long")).otherwise(F.col("short"))
        out = out.withColumn("short", failed)
    return out


def plausibility(verdicts: DataFrame, least: float = 0.9) -> DataFrame:
    """(n, plausible, rate, passed) of the raw verdicts; overrides don't count."""
    plausible = F.sum(F.when(F.col("verdict") == "plausible", 1).otherwise(0))
    return verdicts.agg(F.count("*").alias("n"), plausible.alias("plausible")).withColumn("rate", F.round(ratio(F.col("plausible"), F.col("n")), 9)).withColumn("passed", F.col("rate") >= least)


def agreement(reviews: DataFrame, verdicts: DataFrame, exactly: int = 15) -> DataFrame:
    """(n, agreed, rate) of human reviews (instance_id, verdict) with the judge's; there have to be so many, of different instances that it judged."""
    both = reviews.select("instance_id", F.col("verdict").alias("human")).join(verdicts.select("instance_id", F.col("verdict").alias("judge")), "instance_id", "left")
    sums = both.agg(F.count("*").alias("n"), F.count_distinct("instance_id").alias("ids"), F.count("judge").alias("known"), F.sum(F.when(F.col("human") == F.col("judge"), 1).otherwise(0)).alias("agreed"))
    right = (F.col("n") == exactly) & (F.col("ids") == exactly) & (F.col("known") == exactly)
    n = F.when(right, F.col("n")).otherwise(F.raise_error(F.lit(f"{exactly} reviews of different judged instances are wanted")).cast("long"))
    return sums.select(n.alias("n"), "agreed", F.round(F.col("agreed") / exactly, 9).alias("rate"))


def logistic_probe(rows: DataFrame, features: list[str], steps: int = 500, rate: float = 0.15, decay: float = 0.02) -> tuple[float, list[float]]:
    """(intercept, weights) of a logistic model of label (0 or 1) on standardised features, by full-batch gradient descent.

    Equal rows are counted first, and each step is one sum over what is left, in Spark: the driver has the weights and one row of
    gradients a step, whatever the number of rows. Population deviations, 0 counted as 1; logits are held within 30. Without rows all is 0.
    """
    x = [F.col(f"x{i}") for i in range(len(features))]
    counted = rows.select(F.col("label").cast("double").alias("y"), *(F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features))).groupBy("y", *x).agg(F.count("*").cast("double").alias("n"))
    counted = stored(counted, "probe")
    at = counted.agg(F.sum("n").alias("n"), *(F.sum(c * F.col("n")).alias(f"s{i}") for i, c in enumerate(x))).first()
    total = at["n"]
    if not total:
        return 0.0, [0.0] * len(features)
    mean = [at[f"s{i}"] / total for i in range(len(x))]
    spread = counted.agg(F.lit(0).alias("o"), *(F.sqrt(F.sum((c - m) * (c - m) * F.col("n")) / total).alias(f"d{i}") for i, (c, m) in enumerate(zip(x, mean, strict=True)))).first()
    z = stored(counted.select("y", "n", *(((c - m) / (spread[f"d{i}"] or 1.0)).alias(f"x{i}") for i, (c, m) in enumerate(zip(x, mean, strict=True)))), "standardised")
    bias, weights = 0.0, [0.0] * len(x)
    for _ in range(steps):
        logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((c * w for c, w in zip(x, weights, strict=True)), F.lit(bias))))
        off = (1 / (1 + F.exp(-logit)) - F.col("y")) * F.col("n")
        g = z.agg(F.sum(off).alias("b"), *(F.sum(off * c).alias(f"g{i}") for i, c in enumerate(x))).first()
        bias -= rate * g["b"] / total
        weights = [w - rate * (g[f"g{i}"] / total + decay * w) for i, w in enumerate(weights)]
    return float(bias), [float(w) for w in weights]


def interval(records: DataFrame, draws: int, seed: int) -> tuple[float, float, float]:
    """(delta, low, high): how much better F1 of system a is than that of b on the same rows, and its 95 per cent bootstrap interval.

    records: gold, a, b (predicted; null where it abstained or failed). F1 depends on how many rows there are of each combination
    only, so these are counted, and a resample is one multinomial draw of them: exact, whatever the number of rows.
    """
    import numpy as np

    cells = records.groupBy("gold", "a", "b").agg(F.count("*").alias("n")).collect()  # at most 2 x 3 x 3 rows
    if not cells:
        raise ValueError("no paired rows")

    def f1(counts, side):
        tp = sum(n for c, n in zip(cells, counts, strict=True) if c["gold"] and c[side])
        fp = sum(n for c, n in zip(cells, counts, strict=True) if not c["gold"] and c[side])
        fn = sum(n for c, n in zip(cells, counts, strict=True) if c["gold"] and not c[side])
        return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0

    own = np.array([c["n"] for c in cells])
    drawn = np.random.default_rng(seed).multinomial(own.sum(), own / own.sum(), draws)
    deltas = [f1(d, "a") - f1(d, "b") for d in drawn]
    low, high = np.percentile(deltas, [2.5, 97.5])
    return f1(own, "a") - f1(own, "b"), float(low), float(high)
