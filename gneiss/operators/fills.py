"""Filling a benchmark: candidates taken one after another, each the one that most quotas still ask for, until none helps.

A quota asks for a number of instances with a value in a dimension (a class, an operator, a stratum). The rule is a sequence: of all
candidates left, take that which counts towards most unmet quotas, the first in rank among equals; stop when none counts
towards any. Made one by one that would be a job an instance; but which candidates are best changes only when a quota is
met. So a round ranks the best ones, takes as many in order as come before (and with) the one that meets a quota, and
nothing else: the same choice as one by one. A round meets a quota or exhausts the best candidates of one sum of unmet
quotas, so there are no more rounds than quotas times dimensions and one, whatever the number of candidates; and a shortfall
is proved by there being no candidate left that counts.

The driver sees the quotas and what they ask for: the taken, and each round no more candidates than are still missing. Nulls in a
dimension count towards no quota. Candidates with one id count once. A quota of 0 or less is met. Equal ranks go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.store import stored


def _helped(dimensions: list[str], left: dict[tuple[str, str], int]) -> Column:
    """The unmet quotas that a candidate counts towards, as an array of `dimension=value`."""
    asked = {d: [v for (dim, v), n in left.items() if dim == d and n > 0] for d in dimensions}
    each = [F.when(F.col(d).isin(*asked[d]), F.concat(F.lit(d + "="), F.col(d))) for d in dimensions if asked[d]]
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<string>")


def filled(candidates: DataFrame, quotas: DataFrame, dimensions: list[str], rank: str = "rank", total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(taken, shortfall). candidates: instance_id, rank and a text column for each dimension; quotas: dimension, value, need.

    taken: the candidates with turn, from 1, in the order in which they were taken. shortfall: dimension, value, need and missing of the
    quotas that stay unmet. With total, the first ones in rank fill up to that many after the quotas.
    """
    own = candidates.select("instance_id", rank, *dimensions).groupBy("instance_id").agg(F.min(F.struct(rank, *dimensions)).alias("c")).select("instance_id", "c.*")
    own = stored(own, "candidates")
    spark, schema = own.sparkSession, own.schema
    left = {(r["dimension"], r["value"]): r["need"] for r in quotas.groupBy("dimension", "value").agg(F.max("need").alias("need")).collect() if r["dimension"] in dimensions}
    need = dict(left)
    taken: list[tuple] = []
    kept = own.schema.names

    def rest() -> DataFrame:
        # as many rows as the quotas ask for in all
        return own.join(F.broadcast(spark.createDataFrame(taken, schema).select("instance_id")), "instance_id", "left_anti") if taken else own

    while any(n > 0 for n in left.values()):
        free = rest().withColumn("helps", _helped(dimensions, left)).withColumn("score", F.size("helps")).filter("score > 0")
        top = free.agg(F.max("score")).first()[0]
        if top is None:
            break
        best = free.filter(F.col("score") == top)
        bound = sum(n for n in left.values() if n > 0)
        for r in best.orderBy(rank, "instance_id").limit(bound).collect():
            taken.append(tuple(r[c] for c in kept))
            met = False
            for h in r["helps"]:
                d, v = h.split("=", 1)
                left[d, v] -= 1
                met = met or left[d, v] == 0
            if met:
                break
    if total is not None and len(taken) < total:
        taken += [tuple(r[c] for c in kept) for r in rest().orderBy(rank, "instance_id").limit(total - len(taken)).collect()]
    numbered = own.limit(0).withColumn("turn", F.lit(0)).schema
    out = spark.createDataFrame([(*t, k) for k, t in enumerate(taken, 1)], numbered)
    short = [(d, v, int(need[d, v]), int(n)) for (d, v), n in left.items() if n > 0]
    return out, spark.createDataFrame(short, "dimension string, value string, need int, missing int")
