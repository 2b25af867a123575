"""Queries of what is made in rounds: a probe by gradient descent, splits repaired until their gates hold, paths, nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import evaluate, graph, runs, splits
from gneiss.plans.registry import _EDGES, _SEEDS, _edges, _pairs, _seeds, _t, query

_STEPS, _RATE, _DECAY = 4, 0.15, 0.02


def _probe_sql() -> str:
    """Each step as a relation of its own, from the one before."""
    parts = [
        "r AS (SELECT CAST(quality AS DOUBLE) AS y, CAST(n_chars AS DOUBLE) AS a, CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) AS b FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)",
        "z AS (SELECT y, (a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END AS a, (b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END AS b FROM r, (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM r))",
        "s0 AS (SELECT 0.0::DOUBLE AS c, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb)",
    ]
    for k in range(_STEPS):
        off = "(1 / (1 + exp(-greatest(-30, least(30, c + wa * a + wb * b)))) - y)"
        parts.append(f"s{k + 1} AS (SELECT any_value(c) - {_RATE} * avg{off} AS c, any_value(wa) - {_RATE} * (avg({off} * a) + {_DECAY} * any_value(wa)) AS wa, any_value(wb) - {_RATE} * (avg({off} * b) + {_DECAY} * any_value(wb)) AS wb FROM z, s{k})")
    return f"WITH {', '.join(parts)} SELECT unnest(['intercept', 'n_chars', 'commas']) AS feature, unnest([round(c, 8), round(wa, 8), round(wb, 8)]) AS weight FROM s{_STEPS}"


@query(_probe_sql())
def logistic_probe(spark, d):
    """Whether a document's length and commas tell its quality: the weights after a few steps."""
    docs = _t(spark, d, "documents").filter("text is not null").join(_t(spark, d, "labels"), "doc_id")
    rows = docs.select(F.col("quality").alias("label"), "n_chars", F.expr("length(text) - length(replace(text, ',', ''))").alias("commas"))
    bias, weights = evaluate.logistic_probe(rows, ["n_chars", "commas"], _STEPS, _RATE, _DECAY)
    said = [("intercept", bias), *zip(("n_chars", "commas"), weights, strict=True)]
    return spark.createDataFrame([(n, round(w, 8)) for n, w in said], "feature string, weight double")


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """Orders as instances: a group for each customer, a type for each priority; customers with a very dear order are held for test."""
    o = _t(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("base"), F.col("o_orderpriority").alias("drift_type"), (F.col("o_orderstatus") == "F").alias("is_interprocedural"), (F.col("o_totalprice") > 499_000).alias("real"))
    floors = rows.groupBy("drift_type").agg(F.count("*").alias("n")).withColumn("split", F.explode(F.array(*map(F.lit, splits.SPLITS)))).select("split", "drift_type", F.floor(F.col("n") / 7).alias("floor"))
    return splits.build_splits(rows, 2600, floors=floors)


@query("""WITH g AS (SELECT o_orderpriority AS drift_type, unnest(['train', 'dev', 'test']) AS split FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT split, drift_type, TRUE AS near, TRUE AS floor_met, (SELECT count(DISTINCT o_custkey) FROM orders) AS groups, (SELECT count(*) FROM orders) AS instances, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS real_elsewhere FROM g""")
def split_gates(spark, d):
    """Every gate of the splits: each cell near its share, each floor met, no group in two splits, none left out, real ones in test."""
    dealt = splits.stored(_dealt(spark, d), "instances")
    share = F.element_at(F.create_map(*(F.lit(x) for pair in zip(splits.SPLITS, splits.SHARES, strict=True) for x in pair)), F.col("split"))
    total = dealt.groupBy("drift_type").agg(F.count("*").alias("total"))
    gates = dealt.groupBy("split", "drift_type").agg(F.count("*").alias("n")).join(total, "drift_type")
    groups = dealt.groupBy("base").agg(F.count_distinct("split").alias("k"), F.max("real").alias("real"), F.min("split").alias("split"))
    whole = groups.agg(F.count("*").alias("groups"), F.sum((F.col("k") != 1).cast("long")).alias("torn"), F.sum((F.col("real") & (F.col("split") != "test")).cast("long")).alias("real_elsewhere"))
    n = dealt.agg(F.count("*").alias("instances"))
    near = F.abs(F.col("n") - share * F.col("total")) <= 0.02 * F.col("total")
    return gates.select("split", "drift_type", near.alias("near"), (F.col("n") >= F.floor(F.col("total") / 7)).alias("floor_met")).crossJoin(F.broadcast(whole.crossJoin(n)))  # one row


@query(f"""WITH RECURSIVE {_EDGES}, {_SEEDS}, r(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 60), far AS (SELECT node, min(depth) AS depth FROM r GROUP BY node),
parents AS (SELECT e.dst AS node, min(e.src) AS parent FROM e JOIN far a ON a.node = e.src JOIN far b ON b.node = e.dst AND b.depth = a.depth + 1 GROUP BY e.dst),
p(node, depth, path) AS (SELECT node, depth, CAST(node AS VARCHAR) FROM far WHERE depth = 0 UNION ALL SELECT parents.node, depth + 1, path || '>' || parents.node FROM p JOIN parents ON parent = p.node)
SELECT node, CAST(depth AS INTEGER) AS depth, path FROM p""")
def shortest_paths(spark, d):
    """From the seeds to every part in reach, by the least predecessor."""
    return graph.shortest_paths(_edges(spark, d), _seeds(spark, d)).select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""SELECT c_custkey AS id, unnest(['segment', 'place.nation', 'place.more.name', 'place.more.deep.same', 'place.more.deep.two']) AS path,
unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name, CAST(c_custkey AS VARCHAR), '[1,2]']) AS leaf FROM customer WHERE c_nationkey > 0 UNION ALL SELECT c_custkey, NULL, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 0""")
def flattened_values(spark, d):
    """Values of four levels for each customer, and plain ones for those of the first nation."""
    c = _t(spark, d, "customer")
    one = lambda kind, value: F.concat(F.lit(f'{{"kind":"{kind}","value":'), value, F.lit("}"))
    many = lambda **parts: one("composite", F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}")))
    text = lambda name: one("text", F.concat(F.lit('"'), F.col(name), F.lit('"')))
    number = lambda name: one("number", F.col(name).cast("string"))
    deep = many(same=number("c_custkey"), two=F.lit('{"kind":"enum_set","value":[1,2]}'))
    whole = many(segment=text("c_mktsegment"), place=many(nation=number("c_nationkey"), more=many(name=text("c_name"), deep=deep)))
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") > 0, whole).otherwise(number("c_custkey")).alias("current"))
    return runs.flattened(rows, "id", "current")

_DRAWS = 150


@query(f"""WITH p AS (SELECT row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS at_row, CAST(quality - toxic AS DOUBLE) AS delta FROM labels WHERE quality - toxic IS NOT NULL), n AS (SELECT count(*) AS n FROM p),
picks AS (SELECT id // n AS draw, CAST('0x' || substr(md5('4405|' || (id // n) || '|' || (id % n)), 1, 15) AS BIGINT) % n AS at_row FROM n, range(n * {_DRAWS}) r(id))
SELECT CAST(draw AS BIGINT) AS draw, count(*) AS n, round(sum(delta) / count(*), 9) AS mean FROM picks JOIN p USING (at_row) GROUP BY draw""")
def exact_bootstrap(spark, d):
    """The mean difference over resamples of just as many rows as there are."""
    return evaluate.exact_resampled(_pairs(spark, d), _DRAWS, 4405).select("draw", "n", F.round("mean", 9).alias("mean"))
