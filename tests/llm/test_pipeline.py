"""run() with all five stages on a small table, against a plain restatement of each stage."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict


import corpus_pipeline
import pytest
from test_llm import brute_components, words

from gneiss.llm import bpe, langid
from gneiss.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept boolean, __x int"
ITEM = "the baker sold 12 loaves on one day and 30 rolls on another day so how many more rolls than loaves did the baker sell"


def profile_of(texts, size=langid.PROFILE):
    """The ranked n-grams of some texts, as tuples of code points: 32 stands for the end of a word."""
    found = Counter()
    for text in texts:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            s = f" {w} "
            found.update(w)
            found.update(s[i : i + 2] for i in range(len(s) - 1))
            found.update(s[i : i + 3] for i in range(len(s) - 2))
    order = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(found, key=lambda g: (-found[g], order(g)))[:size]


def out_of_place(text, profiles):
    """(language, score) by the plain sum of rank differences."""
    own = profile_of([text])
    if not own or not profiles:
        return "und", 0.0
    far = {}
    for lang, p in profiles.items():
        at = {g: i for i, g in enumerate(p)}
        far[lang] = sum(abs(at[g] - i) if g in at else langid.PROFILE for i, g in enumerate(own))
    best = min(far, key=lambda x: (far[x], x))
    return best, 1 - far[best] / (langid.PROFILE * len(own))


def language_stage(rows):
    by = defaultdict(list)
    for r in rows:
        if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 4 != 2:
            by[r[2]].append(r[1])
    profiles = {k: profile_of(v) for k, v in by.items()}
    out = []
    for r in rows:
        lang, score = out_of_place(r[1] or "", profiles)
        if lang != "und" and score >= corpus_pipeline.LEAST_LIKE:
            out.append(r)
    return out


def line_stage(rows):
    seen, gone = {}, defaultdict(set)
    texts = {(r[0], r[1]) for r in rows if r[0] is not None}
    for doc, text in sorted(texts):
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone[doc, text] |= {i, i + 1, i + 2}
                seen.setdefault(w, (doc, i))
    out = []
    for r in rows:
        drop = gone.get((r[0], r[1]), ())
        left = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in drop)
        if not drop or re.search(r"\S", left):
            out.append((r[0], left, *r[2:4], len(left) if drop else r[4], *r[5:]))
    return out


def near_stage(rows):
    found = brute_components([(i, r[1]) for i, r in enumerate(rows)])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[found[i][1]].append((r[0], i))
    return [rows[min(group)[1]] for group in least.values()]


@pytest.mark.parametrize("seed", [1])
def test_run_of_all_five_stages(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(i, words(rnd, rnd.randint(40, 90), "abcdefgh" if i % 2 else "mnopqrst"), "xx" if i % 2 else "yy", f"s{i % 3}", i, "clash", False, i) for i in range(48)]
    cut = lambda t: t[: len(t) // 2] + "\n" + "one line here\nand a second\nand the third\n" + t[len(t) // 2 :]
    rows += [(100 + i, cut(rows[i][1] + words(rnd, 30, "abcdefgh" if i % 2 else "mnopqrst")), "xx" if i % 2 else "yy", "s", 1, "c", True, 0) for i in range(4)]
    rows += [(200 + i, rows[i][1] + " abba", "xx", "s", 1, "c", True, 0) for i in range(6)]
    rows += [rows[5], rows[5], (300, "12 34 !", "xx", "s", 7, None, None, None), (301, None, None, None, None, None, None, None), (302, "", "xx", "s", 0, "c", True, 0)]
    rows += [(400, rows[7][1] + " " + ITEM.replace("12", "7").replace("30", "45") + " " + rows[8][1], "xx", "s", 1, "c", True, 0), (401, "жшщ ъыь эюя ёйц " * 20, None, "s", 1, "c", True, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = near_stage(line_stage(language_stage(rows)))
    assert any(r[0] == 400 for r in want) and not any(r[0] in (300, 301, 302, 401) for r in want)
    want = [r for r in want if r[0] != 400]
    path, pattern = tokenizer()
    enc = bpe.encoder(path, pattern)
    of = lambda t: (len(ids := enc.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted((r[0], *of(r[1])) for r in want)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert {(r.doc_id, r.score, r.kept) for r in docs.collect()} == {(r[0], r[5], r[6]) for r in want}


def test_stages_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == empty.columns)


def test_language_distance_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, words(rnd, 30, ("abcdeé", "defghi", "hijkab")[i % 3]), "abc"[i % 3]) for i in range(90)]
    rows += [(200, "x", None), (201, "defg abcd " * 30, None), (202, words(rnd, 30_000, "abcdefghijk"), None), (201, "defg abcd " * 30, None), (203, "Ǆ ß İ", None)]
    by = defaultdict(list)
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            by[lang].append(t)
    profiles = {k: profile_of(v) for k, v in by.items()}
    out = langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows)
    for r, (_, text, _) in zip(out, rows, strict=True):
        want = out_of_place(text, profiles)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-9
