from __future__ import annotations

import hashlib
import random

import pytest

from gneiss.operators import evaluate, fills, graph, runs, splits

QUOTAS = "dimension string, value string, need int"
CANDIDATES = "instance_id string, rank int, kind string, op string"


def one_by_one(rows: list[tuple], need: dict, total: int | None) -> tuple[list, dict]:
    """The candidate that most unmet quotas ask for, again and again."""
    left, taken, rest = dict(need), [], {r[0]: r for r in sorted(rows, key=lambda r: -r[1])}
    helps = lambda r: [q for q in (("kind", r[2]), ("op", r[3])) if left.get(q, 0) > 0]
    while True:
        best = min(rest.values(), key=lambda r: (-len(helps(r)), r[1], r[0]), default=None)
        if best is None or not helps(best):
            break
        for q in helps(best):
            left[q] -= 1
        taken.append(best[0])
        del rest[best[0]]
    for r in sorted(rest.values(), key=lambda r: (r[1], r[0])):
        if total is not None and len(taken) < total:
            taken.append(r[0])
    return taken, {q: n for q, n in left.items() if n > 0}


@pytest.mark.parametrize("total", [None, 40])
def test_fills_are_those_of_one_by_one(spark, total):
    rnd = random.Random(total or 1)
    rows = [(f"i{k:03}", rnd.randrange(60), rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y"])) for k in range(150)]
    need = {("kind", "a"): 12, ("kind", "b"): 3, ("kind", "c"): 60, ("kind", "z"): 2, ("op", "x"): 20, ("op", "y"): 0}
    taken, short = fills.filled(spark.createDataFrame(rows + rows[:9], CANDIDATES), spark.createDataFrame([(*q, n) for q, n in need.items()], QUOTAS), ["kind", "op"], total=total)
    want, left = one_by_one(rows, need, total)
    assert [r.instance_id for r in sorted(taken.collect(), key=lambda r: r.turn)] == want
    assert {(r.dimension, r.value): r.missing for r in short.collect()} == left and ("kind", "z") in left


def test_nothing_to_fill(spark):
    taken, short = fills.filled(spark.createDataFrame([], CANDIDATES), spark.createDataFrame([("kind", "a", 2), ("kind", "b", 0)], QUOTAS), ["kind", "op"])
    assert taken.count() == 0 and [tuple(r) for r in short.collect()] == [("kind", "a", 2, 2)]


def test_resamples_have_the_size_of_the_sample(spark):
    rows = [(i, float(i * i % 17) if i % 5 else None) for i in range(120)]
    out = {r.draw: (r.n, r["mean"]) for r in evaluate.exact_resampled(spark.createDataFrame(rows, "id long, delta double").repartition(3), 20, 9).collect()}
    kept = [d for _, d in sorted((hashlib.md5(str(i).encode()).hexdigest(), d) for i, d in rows if d is not None)]
    for b in range(20):
        picks = [kept[int(hashlib.md5(f"9|{b}|{j}".encode()).hexdigest()[:15], 16) % len(kept)] for j in range(len(kept))]
        assert out[b][0] == len(kept) and abs(out[b][1] - sum(picks) / len(picks)) < 1e-9
    assert evaluate.exact_resampled(spark.createDataFrame([], "id long, delta double"), 3, 1).count() == 0


def test_the_probe_by_plain_gradients(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    x = np.round(rnd.normal(3, 2, (60, 2)), 1)
    y = (x[:, 0] + rnd.normal(0, 1, 60) > 3).astype(float)
    bias, weights = evaluate.logistic_probe(spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(y, x, strict=True)], "label int, a double, b double"), ["a", "b"], steps=6)
    z = (x - x.mean(0)) / x.std(0)
    c, w = 0.0, np.zeros(2)
    for _ in range(6):
        off = 1 / (1 + np.exp(-(z @ w + c))) - y
        c, w = c - 0.15 * off.mean(), w - 0.15 * (z.T @ off / 60 + 0.02 * w)
    assert abs(bias - c) < 1e-9 and np.allclose(weights, w, atol=1e-9)


def test_shortest_paths_by_search(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(40)] + [(0, 100)]
    got = {r.node: list(r.path) for r in graph.shortest_paths(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,), (7,)], "node int")).collect()}
    far, front = {0: 0, 7: 0}, [0, 7]
    while front:
        new = sorted({d for s, d in edges if s in front and d not in far})
        far |= {n: far[front[0]] + 1 for n in new}
        front = new
    assert set(got) == set(far)
    for n, path in got.items():
        assert path[-1] == n and len(path) == far[n] + 1 and far[path[0]] == 0
        assert all(a == min(s for s, d in edges if d == b and far.get(s) == far[b] - 1) for a, b in zip(path, path[1:], strict=False))


def test_values_at_any_depth(spark):
    deep = '{"kind":"money","value":5}'
    for k in range(6):
        deep = f'{{"kind":"composite","value":{{"l{k}":{deep},"s{k}":{{"kind":"flag","value":true}}}}}}'
    got = {(r.id, r.path): r.leaf for r in runs.flattened(spark.createDataFrame([(1, deep), (2, '{"kind":"x","value":"a"}'), (3, None), (4, "7")], "id int, v string"), "id", "v").collect()}
    assert got[1, "l5.l4.l3.l2.l1.l0"] == "5" and got[1, "l5.l4.s3"] == "true" and len([k for k in got if k[0] == 1]) == 7
    assert got[2, None] == "a" and got[3, None] is None and got[4, None] == "7"


def test_splits_meet_their_floors_or_tell(spark):
    rows = [(f"b{i % 40}", "D1" if i % 40 else "D2", False, i % 40 == 1) for i in range(400)]
    df = spark.createDataFrame(rows, "base string, drift_type string, is_interprocedural boolean, real boolean")
    floors = spark.createDataFrame([("dev", "D1", 60), ("train", "D2", 5), ("dev", "D2", 5), ("test", "D1", 50)], "split string, drift_type string, floor int")
    dealt = splits.build_splits(df, 5, floors=floors)
    n = {(r.split, r.drift_type): r["count"] for r in dealt.groupBy("split", "drift_type").count().collect()}
    assert n["dev", "D1"] >= 60 and n["test", "D1"] >= 50 and {r.split for r in dealt.filter("real").collect()} == {"test"}
    # one group has all of D2, so one of two splits must do without
    assert sorted((r.problem, r.what) for r in splits.split_errors(dealt, floors).collect()) in ([("below its floor", "dev/D2")], [("below its floor", "train/D2")])
