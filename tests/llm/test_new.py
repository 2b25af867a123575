"""Trees, runs and shards against brute force; items of a benchmark in any case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, found

from gneiss.llm import merkle, numbering, runs, sharding
from gneiss.llm.common import scratch

LEAVES = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# op6 ----------------------------------------------------------------------------------------------------------------

ITEMS = [
    "A farmer sells 12 apples at 3 dollars each and 5 pears at 2 euros each, how much money does the farmer get in 4 weeks?",
    "The pump moves 40 liters of water every 5 minutes, so how many liters of water does it move in 3 hours and 10 min?",
    "Ein Bäcker in der Straße verkauft 12 Brote zu je 500 g und 30 große Brötchen, wie viele kg Gebäck sind das nach 2 Wochen?",
    "Une usine située à côté du château remplit 250 bouteilles de 75 cl chaque jour, combien de litres cela fait-il après 3 années?",
    "El niño corrió 12 km el lunes y 8 km el miércoles, ¿cuántos metros más corrió el lunes que el miércoles de esa semana?",
    "Weiß 12 km Fluß",
]


@pytest.mark.parametrize("case", [str.upper, str.lower, str.title, str.swapcase, str])
def test_copies_in_any_case_are_found(spark, case):
    docs = spark.createDataFrame([(k, f"Before that. {case(t)} And after.") for k, t in enumerate(ITEMS)] + [(99, "a clean text of 12 km and 5 MINUTES")], DOCS)
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    from gneiss.llm import decontaminate

    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(k, k) for k in range(len(ITEMS))}


def test_other_units_and_case_are_another_asking(spark):
    item = ITEMS[1]
    again = item.replace("40", "55").replace("liters", "GALLONS").upper()
    assert found(spark, again, "the pump moves water and nothing else at all of that kind", item=item) == {(0, 1): True}


# op11 ---------------------------------------------------------------------------------------------------------------


def plain_proofs(rows: list[tuple], fanout: int, grown: bool) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded root) of rows of LEAVES, one level after another."""
    encode = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(encode, r)))

    def tree(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
            out.append(nodes)
        return out

    keys = sorted({r[2] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in keys}
    trees = {k: tree([leaf(r) for r in own[k]]) for k in keys}
    over = tree([trees[k][-1][0] for k in keys]) if keys else []
    out = []
    for j, k in enumerate(keys):
        for i, r in enumerate(own[k]):
            told = list(r)
            if grown and r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                told[3] += 1
            fold, proof = leaf(told), ""
            for levels, at in ((trees[k], i), (over, j)):
                for nodes in levels[:-1]:
                    run = at // fanout * fanout
                    left, right = "".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])
                    proof, fold, at = proof + left + right, sha(left + fold + right), at // fanout
            out.append((r[0], leaf(r), trees[k][-1][0], over[-1][0], sha(proof), fold))
    return out


def leaf_rows(n: int) -> list[tuple]:
    rnd = random.Random(n)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, "s"]), rnd.choice([None, "", "a", "a", "a", "b", "é", "zz"]), rnd.choice([None, 5, 7]), rnd.choice([None, "", "t x", "ü" * 999])) for _ in range(n)]
    return rows + rows[: n // 5]


@pytest.mark.parametrize(("n", "fanout", "levels"), [(1, 2, 1), (17, 2, 1), (200, 2, 3), (200, 3, 2), (150, 5, 1), (300, 2, 10)])
def test_superblocks_make_the_proofs_of_plain_trees(spark, n, fanout, levels):
    rows = leaf_rows(n)
    docs = spark.createDataFrame(rows, LEAVES).repartition(5)
    for c in ("key", "at", "node", "id", "root", "__tie", "order"):
        docs = docs.withColumn(c, F.lit("clash"))
    grown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.proved(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": grown}, fanout, levels).collect()
    got = sorted(map(str, ((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in out)))
    assert got == sorted(map(str, plain_proofs(rows, fanout, True)))
    assert all(r.verified == (r.folded_root == r.root) for r in out) and (n == 1 or any(r.verified for r in out))


def test_tampered_rows_do_not_verify(spark):
    rows = [(i, "s", "en", 5, f"text {i}") for i in range(100)]
    out = merkle.tampered(spark.createDataFrame(rows, LEAVES)).collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in out) and len(out) == 100
    assert merkle.tampered(spark.createDataFrame([], LEAVES)).count() == 0
    with pytest.raises(ValueError, match="children"):
        merkle.proved(spark.createDataFrame(rows, LEAVES), "lang", "doc_id", ["text"], fanout=1)


def test_one_row_changes_only_its_own_path(spark):
    rows = [(i, "s", "en" if i % 3 else "de", 5, f"text {i}") for i in range(64)]
    read = lambda r: {x.doc_id: x for x in merkle.tampered(spark.createDataFrame(r, LEAVES)).collect()}
    one, two = read(rows), read([*rows[:63], (63, "s", "de", 5, "other")])
    assert one[1].subroot == two[1].subroot and one[1].root != two[1].root and one[0].subroot != two[0].subroot


def test_numbers_within_keys_have_no_gap(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 5 + ["a", None]), rnd.randrange(50)) for _ in range(3000)] + [("hot", 7)] * 2000
    stored = scratch(numbering.tied(spark.createDataFrame(rows, "k string, v int").repartition(7)), "t")
    out = numbering.numbered(stored, "k", ["v"], []).collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r["__at"], r.v) for r in out if r.k == key)
        assert [a for a, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for k, v in rows if k == key)
        assert {r["__of"] for r in out if r.k == key} == {len(mine)}


# op12 ---------------------------------------------------------------------------------------------------------------


def plain_runs(x: list) -> list[tuple[int, int, int]]:
    """Every period's stretches of words that equal the word a period on."""
    out: dict = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def noisy(rnd: random.Random) -> list[int]:
    x = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 50))]
    if rnd.random() < 0.6:
        y = [rnd.randrange(3) for _ in range(rnd.randint(1, 9))]
        at = rnd.randint(0, len(x))
        x = x[:at] + y * rnd.randint(2, 9) + y[: rnd.randint(0, len(y))] + x[at:]
    return x


@pytest.mark.parametrize("packed", [1 << 21, 1])
def test_runs_by_brute_force(monkeypatch, packed):
    monkeypatch.setattr(runs, "PACKED", packed)
    rnd = random.Random(9)
    for _ in range(3000):
        x = noisy(rnd)
        assert runs.repetitions(np.array(x, np.int64)) == plain_runs(x)


def test_z_functions():
    rnd = random.Random(2)
    for _ in range(300):
        s = [rnd.randrange(2) for _ in range(rnd.randint(0, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs.z_function(s) == want and runs.z_function(s, 4) == want[:5]


def test_run_digests_and_collapsed_texts(spark):
    rnd = random.Random(4)
    texts = [" ".join("w%d" % k for k in noisy(rnd)) for _ in range(300)]
    texts += [None, "", " \x0b\n", "go " * 5000, "a\x1cb " * 8 + "\x85 c", "la la la la la", "la " * 6, "x " * 3 + "y", texts[0], texts[0]]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no " * 9)], DOCS).withColumn("n_runs", F.lit("clash"))
    out = {r.doc_id: r for r in runs.digests(docs).collect()}
    for i, text in [*enumerate(texts), (None, "no " * 9)]:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        want = plain_runs(words)
        gone = {k for a, n, q in want for k in range(a + q, a + n)}
        best = min(want, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = out[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in want))
        assert r.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert runs.digests(docs.limit(0)).count() == 0


def test_collapsing_texts(spark):
    docs = spark.createDataFrame([(1, "Say it: no no no no no no no. Ok"), (2, None), (3, "a b a b a b a b a b c"), (4, "plain words")], DOCS).withColumn("runs", F.lit("clash"))
    out = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in runs.collapse_runs(docs).collect()}
    assert out == {1: ("Say it: no no. Ok", [(2, 6, 1)]), 2: (None, []), 3: ("a b c", [(0, 10, 2)]), 4: ("plain words", [])}


# op13 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [*range(1, 40), 257, 1000, 4099])
def test_the_permutation_can_be_undone(n):
    at = sharding.permuted(np.arange(n), n, 5)
    assert sorted(at.tolist()) == list(range(n))
    for row in range(0, n, 1 + n // 40):
        shard, slot = sharding.place(row, n, 3, 5)
        assert at[row] == 3 * slot + shard and sharding.row_at(shard, slot, n, 3, 5) == row
    with pytest.raises(ValueError, match="no slot"):
        sharding.row_at(0, n, n)


def test_the_permutation_mixes():
    at = sharding.permuted(np.arange(20_000), 20_000).astype(float)
    other = sharding.permuted(np.arange(20_000), 20_000, 77).astype(float)
    assert abs(np.corrcoef(at, np.arange(20_000))[0, 1]) < 0.03 and abs(np.corrcoef(at[1:], at[:-1])[0, 1]) < 0.03 and abs(np.corrcoef(at, other)[0, 1]) < 0.03


def test_shards_are_even_reproducible_and_computable(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["same text"] * 4 + [f"text é {i}", None, "", "x" * 70_000])) for i in range(500)] + [(None, "no id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.repartition(9).withColumns({c: F.lit("clash") for c in ("shard", "slot", "row", "size", "key", "id", "n", "__at")})
    out, again = sharding.sharded(docs).collect(), sharding.sharded(clash).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 503
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1] or "")))
    want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", *sharding.place(k, len(rows)), None)) for k, (i, t) in enumerate(order))
    assert sorted(str(tuple(r)) for r in out) == want
    assert sharding.sharded(docs.limit(0)).count() == 0 and [tuple(r)[4:6] for r in sharding.sharded(docs.limit(1)).collect()] == [(0, 0)]


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(101)], DOCS)
    told = sharding.write_shards(docs, f"{tmp_path}/s", 4).orderBy("shard").collect()
    assert [(r.shard, r.rows, r.last_slot) for r in told] == [(0, 26, 25), (1, 25, 24), (2, 25, 24), (3, 25, 24)]
    back = spark.read.parquet(f"{tmp_path}/s").collect()
    assert {r.doc_id: (r.shard, r.slot) for r in back} == {i: sharding.place(i, 101, 4) for i in range(101)} and all(r.text == f"text {r.doc_id}" for r in back)
    with pytest.raises(ValueError, match="unique"):
        sharding.write_shards(docs.union(docs.limit(1)), f"{tmp_path}/t", 4)
    with pytest.raises(ValueError, match="in the way"):
        sharding.write_shards(docs.withColumn("slot", F.lit(1)), f"{tmp_path}/t", 4)


# op10 ---------------------------------------------------------------------------------------------------------------


def test_every_language_is_learned(spark, monkeypatch):
    """1,100 languages of one word each, one of them a single row repeated ten thousand times."""
    rnd = random.Random(8)
    word = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1100)]
    free = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(free[k], f"{w} {w}", f"l{k:04}") for k, w in enumerate(word)] + [(free[5], f"{word[5]} {word[5]}", "l0005")] * 10_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from gneiss.llm import langid

    model = langid.fit(docs)
    assert model.langs == tuple(f"l{k:04}" for k in range(1100))
    assert all(model.predict(f"{w} {w}")[0] == f"l{k:04}" for k, w in enumerate(word))
    monkeypatch.setattr(langid, "MOST_LANGS", 1000)
    with pytest.raises(ValueError, match="1100 languages"):
        langid.fit(docs)


def test_distances_by_plain_ranks():
    from gneiss.llm import langid

    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, 200))) for _ in range(40)]
    profiles = {f"p{k}": langid.ranked(*langid.ngrams(t), 50).tolist() for k, t in enumerate(texts[:12])}
    model = langid.model_of(profiles, 50)
    for t in texts:
        own = langid.ranked(*langid.ngrams(t), 50).tolist()
        far = {p: sum(abs(i - own_rank) if (i := {c: k for k, c in enumerate(codes)}.get(c)) is not None else 50 for own_rank, c in enumerate(own)) for p, codes in profiles.items()}
        best = min(sorted(far), key=lambda p: (far[p], p))
        lang, score = model.predict(t)
        assert far[lang] == far[best] and abs(score - (1 - far[best] / (50 * len(own)))) < 1e-12


# op9 ----------------------------------------------------------------------------------------------------------------


def test_digests_are_of_the_present_rules():
    from gneiss.llm import licenses

    assert sha(repr(licenses.REWRITES)) == licenses.DIGESTS_MADE_WITH
