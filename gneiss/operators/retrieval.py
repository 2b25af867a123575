"""Retrieval: BM25, dense scores, fusion of whole rankings, reranking, anchors and ranking metrics.

Texts are tokenised once for a set of queries: words are rows, so that stemming is compiled code, and only counts of the queries'
terms, and of all others together, are shuffled. Ranks are found by counting better rows, never by sorting a corpus in one
task. queries (query_id, ...) are the small side, in any number that fits one array of some hundred rows a query.

Null texts have no words. Documents that match nothing score 0 and rank last, by id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import STOPWORDS, coverage, stem, token_set, tokens
from gneiss.operators import vectors as blocks
from gneiss.operators.store import stored

K1, B = 1.5, 0.75
FUSED = 60
MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")
#: Results that are reranked.
HEAD = 20


def terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term) of every token, one row each: what functions.text.tokens() gives, exploded before it is stemmed."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    return words.filter((F.length("w") > 1) & ~F.col("w").isin(STOPWORDS)).select(key, stem(F.col("w")).alias("term"))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term and tf; partial counts before the shuffle."""
    return terms(docs, "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class Index:
    """Postings in a table, and the number and mean length of all documents."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame

    @staticmethod
    def build(docs: DataFrame, asked: DataFrame | None = None) -> Index:
        """asked: a column term; if given, other terms are only counted."""
        every = terms(docs, "doc_id")
        if asked is not None:
            known = asked.select(F.col("term").alias("known")).distinct()
            every = every.join(known, F.col("term") == F.col("known"), "left").select("doc_id", F.col("known").alias("term"))
        held = stored(every.groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "postings")
        lengths = held.groupBy("doc_id").agg(F.sum("tf").alias("length"))
        totals = docs.agg(F.count("*").alias("n")).crossJoin(held.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all")))  # one row each
        return Index(held.filter("term is not null"), lengths, totals.select("n", (F.col("all") / F.greatest(F.col("n"), F.lit(1))).alias("mean")))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, index: Index | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every pair with a term in common; a term repeated in a query counts again. Frequencies are over all documents."""
    asked = terms(queries, "query_id").groupBy("query_id", "term").agg(F.count("*").alias("times"))
    index = index or Index.build(docs, asked)
    known = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = known.groupBy("term").agg(F.count("*").alias("df"))
    hits = known.join(asked.join(df, "term"), "term").join(index.lengths, "doc_id").crossJoin(F.broadcast(index.totals))  # totals is one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("times") * part), 6).alias("score"))


#: Terms of queries that are broadcast at once, and of which a set is made for each document.
ASKED = 50_000


def covering(docs: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """The columns of docs without its text, query_id and overlap of every pair in which a document has at least that share, above 0, of a query's distinct terms.

    Of m terms such a document lacks fewer than any m - least * m + 1 of them, so it has one of a query's so many rarest (among queries),
    and only pairs that share one are compared. Documents aren't moved and no pair is counted over rows: their terms meet the broadcast ones of queries
    where they are read. Queries of more than ASKED terms go in several rounds, each of which reads the documents.
    """
    # numbered before it is exploded: in one select every term would have a number of its own
    numbered = queries.select(F.monotonically_increasing_id().alias("key"), "query_id", "text")
    each = numbered.select("key", "query_id", F.explode(token_set(F.col("text"))).alias("term"))
    by_rarity = F.struct(F.count("*").over(Window.partitionBy("term")).alias("n"), (-F.length("term")).alias("l"), "term")
    asked = each.withColumn("x", by_rarity).groupBy("key", "query_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["term"]).alias("asked"))
    # overlaps are compared as rounded, so what is asked for is a little less
    m = F.size("asked")
    asked = stored(asked.withColumn("rare", F.slice("asked", F.lit(1), (m - F.ceil(m * (least - 1e-6)) + 1).cast("int"))), "asked")
    rounds = max(-(-(asked.agg(F.sum(F.size("asked"))).first()[0] or 0) // ASKED), 1)
    kept = [c for c in docs.columns if c != "text"]
    # exploded from an array of its own, a document's set is made once and not anew for each use
    held = docs.select(*kept, F.explode(F.array(token_set(F.col("text")))).alias("held"))
    overlap = F.round(coverage(F.col("asked"), F.col("held")), 6)
    found = None
    for k in range(rounds):
        own = asked.filter(F.pmod(F.hash("key"), F.lit(rounds)) == k)
        pick = own.select("key", F.explode("rare").alias("term"))
        # one row; a document's set goes along with the few terms of its own that are rare, not with all
        some = held.crossJoin(F.broadcast(pick.agg(F.collect_set("term").alias("all")))).select(*kept, "held", F.explode(F.array_intersect("held", "all")).alias("term"))
        met = some.join(F.broadcast(pick), "term").join(F.broadcast(own), "key")
        # a pair that shares several of the rarest is met as often: the first of them counts
        pairs = met.withColumn("overlap", overlap).filter((F.col("overlap") >= least) & (F.get(F.array_intersect("rare", "held"), F.lit(0)) == F.col("term"))).select(*kept, "query_id", "overlap")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller doc_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def filled(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """top(), filled up to k with documents that match nothing, by id, at score 0. A query that misses some needs none but the first 2k ids to fill them."""
    best = stored(top(scores, k), "best")
    n = best.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.select("query_id").distinct().join(n, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id")
    first = docs.select("doc_id").distinct().orderBy("doc_id").limit(2 * k)
    spare = short.crossJoin(F.broadcast(first)).join(best, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("score"))  # 2k rows
    return top(best.select("query_id", "doc_id", "score").unionByName(spare), k)


def dense(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the dot product of each query with all vectors, whose lengths may differ: the shorter counts. A stated query set against all rows, not an all-pairs join."""
    asked = queries.select("query_id", F.col("embedding").alias("q"))
    return vectors.crossJoin(asked).select("query_id", F.col("vec_id").alias("doc_id"), _dot(F.col("q"), F.col("embedding")).alias("score"))


def _dot(x: Column, y: Column) -> Column:
    n = F.least(F.size(x), F.size(y))
    return F.round(F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v), 6)


def _place(value: Column, array: str) -> Column:
    """How many entries of a sorted array of structs are smaller than value, by binary search."""
    n = F.size(array)
    steps = F.transform(F.reverse(F.sequence(F.lit(0), F.length(F.bin(n)) - 1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) < value, at + s).otherwise(at))


def ranks(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank) of the wanted pairs (query_id, doc_id, score), all of which are among scores.

    Each row of scores is placed among its query's wanted ones and counted there; sums of these counts are the ranks.
    """
    key = lambda: F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"))
    sorted_ = wanted.groupBy("query_id").agg(F.array_sort(F.collect_set(key())).alias("w"))
    counts = scores.join(sorted_, "query_id").groupBy("query_id", _place(key(), "w").alias("p")).agg(F.count("*").alias("n"))
    by_place = counts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("ns"))
    zero = F.lit(0).cast("long")
    sums = F.aggregate(F.sequence(F.lit(0), F.size("w") - 1), F.struct(zero.alias("sum"), F.expr("cast(array() as array<bigint>)").alias("all")), lambda a, i: F.struct((a["sum"] + F.coalesce(F.element_at("ns", i), zero)).alias("sum"), F.concat(a["all"], F.array(a["sum"] + F.coalesce(F.element_at("ns", i), zero))).alias("all")))["all"]
    each = sorted_.join(by_place, "query_id").select("query_id", F.explode(F.zip_with("w", sums, lambda w, r: F.struct(w["d"].alias("doc_id"), r.alias("rank")))).alias("x"))
    return each.select("query_id", "x.doc_id", F.col("x.rank").cast("int").alias("rank"))


def _unmatched_ranks(scores: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank) of wanted pairs that have no score: behind all that have, by id."""
    ids = wanted.select("doc_id").distinct().agg(F.array_sort(F.collect_list(F.struct("doc_id"))).alias("w"))  # some hundred a query
    at = docs.select("doc_id").distinct().crossJoin(F.broadcast(ids)).groupBy(_place(F.struct("doc_id"), "w").alias("p")).agg(F.count("*").alias("n"))
    all_ = ids.select(F.posexplode("w").alias("p", "x")).select("p", F.col("x.doc_id").alias("doc_id"))
    upto = all_.join(at.withColumnRenamed("p", "q"), F.col("q") <= F.col("p")).groupBy("doc_id").agg(F.sum("n").alias("before"))  # both sides bounded by ids
    own = wanted.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("doc_id"))).alias("w"))
    counts = scores.join(own, "query_id").groupBy("query_id", _place(F.struct("doc_id"), "w").alias("p")).agg(F.count("*").alias("n"))
    matched = scores.groupBy("query_id").agg(F.count("*").alias("m"))
    smaller = own.select("query_id", F.posexplode("w").alias("p", "x")).join(counts.select("query_id", F.col("p").alias("q"), "n"), "query_id", "left").groupBy("query_id", F.col("x.doc_id").alias("doc_id")).agg(F.coalesce(F.sum(F.when(F.col("q") <= F.col("p"), F.col("n"))), F.lit(0)).alias("less"))
    return smaller.join(upto, "doc_id").join(matched, "query_id", "left").select("query_id", "doc_id", (F.coalesce("m", F.lit(0)) + F.col("before") - F.col("less")).cast("int").alias("rank"))


def hybrid(lexical: DataFrame, vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best by reciprocal rank fusion of the whole rankings, that of lexical scores and that of vectors (vec_id, embedding).

    Only the FUSED + 2k best of either ranking can be among them: what is in neither scores at most 2 / (2 FUSED + 2k + 1), and the
    k best of one ranking at least 1 / (FUSED + k) each. The ranks of those in the other ranking are counted.
    """
    deep = FUSED + 2 * k
    lexical = stored(lexical, "lexical")
    a, b = stored(filled(lexical, docs, queries, deep), "deep"), stored(top(blocks.best(vectors, queries, deep), deep), "deep")
    pair = ["query_id", "doc_id"]
    not_a = b.select(pair).join(a.select(pair), pair, "left_anti")
    # of documents only: a vector may belong to none
    not_a = not_a.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select(pair)
    not_b = a.select(pair).join(b.select(pair), pair, "left_anti")
    with_score = lexical.join(not_a, pair, "left_semi")
    rest = not_a.join(lexical.select(pair), pair, "left_anti")
    in_a = a.select(*pair, "rank").unionByName(ranks(lexical, with_score)).unionByName(_unmatched_ranks(lexical, docs, rest))
    told = not_b.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    in_b = b.select(*pair, "rank").unionByName(blocks.ranks(vectors, queries, told.select(*pair, _dot(F.col("q"), F.col("embedding")).alias("score"))))
    return top(fuse([in_a, in_b]), k)


def fuse(rankings: list[DataFrame], k: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank)."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def covers(pairs: DataFrame) -> DataFrame:
    """The scorer that needs no model: the share of the query's words that the text has. pairs: query_id, doc_id, query, text."""
    return pairs.select("query_id", "doc_id", F.round(coverage(tokens(F.col("query")), tokens(F.col("text"))), 6).alias("score"))


def rerank(head: DataFrame, queries: DataFrame, docs: DataFrame, k: int, scorer: Callable[[DataFrame], DataFrame] = covers) -> DataFrame:
    """The k best of head (query_id, doc_id) by a scorer of pairs of texts."""
    pairs = head.select("query_id", "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    return top(scorer(pairs), k)


def search(mode: str, queries: DataFrame, docs: DataFrame, k: int = 5, vectors: DataFrame | None = None, scorer: Callable | None = covers, only: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """The k best of each query in one of MODES. queries: query_id, text and, but for bm25, embedding. only: the doc_ids that may be found; frequencies stay those of all documents."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "bm25" and vectors is None:
        raise ValueError(f"{mode} needs vectors")
    if mode == "hybrid_rerank" and scorer is None:
        raise ValueError(f"{mode} needs a scorer")
    may = docs if only is None else docs.join(only.select("doc_id"), "doc_id", "left_semi")
    lexical = None
    if mode != "dense":
        lexical = bm25(docs, queries, index=index)
        lexical = lexical if only is None else lexical.join(only.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "score")
    if mode != "bm25" and only is not None:
        vectors = vectors.join(only.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    if mode == "bm25":
        return filled(lexical, may, queries, k)
    if mode == "dense":
        return top(blocks.best(vectors, queries, k), k)
    best = hybrid(lexical, vectors, may, queries, k if mode == "hybrid" else HEAD)
    return best if mode == "hybrid" else rerank(best, queries, docs, k, scorer)


def stub_search(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """The k texts that hold the largest share of a query's words; none of those that hold no word. queries: query_id, text."""
    asked = terms(queries, "query_id").distinct()
    m = asked.groupBy("query_id").agg(F.count("*").alias("m"))
    held = terms(docs, "doc_id").join(asked.select("term").distinct(), "term", "left_semi").distinct()
    return top(asked.join(held, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c")).join(m, "query_id").select("query_id", "doc_id", F.round(F.col("c") / F.col("m"), 6).alias("score")), k)


def anchored(hits: DataFrame, k: int) -> DataFrame:
    """One hit a (query_id, anchor): the best score at the first rank; hits without an anchor go."""
    best = hits.filter("anchor is not null").groupBy("query_id", "anchor").agg(F.min("rank").alias("first_rank"), F.max("score").alias("best_score"))
    order = Window.partitionBy("query_id").orderBy("first_rank", "anchor")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def search_clauses(mode: str, queries: DataFrame, docs: DataFrame, k: int = 5, **more) -> DataFrame:
    """The k best anchors (docs also has anchor) of each query: of the max(4k, 20) best documents."""
    hits = search(mode, queries, docs, max(4 * k, 20), **more)
    return anchored(hits.join(docs.select("doc_id", "anchor"), "doc_id"), k)


def first_right(scores: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, rank) of each query's best right answer, null without one; right: (query_id, doc_id). Better rows are counted, not sorted."""
    of = lambda: F.struct((-F.col("score")).alias("s"), "doc_id")
    best = scores.join(right.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min(of()).alias("best"))
    counted = scores.join(best, "query_id", "left").groupBy("query_id").agg(F.sum(F.when(of() <= F.col("best"), 1)).alias("rank"))
    return counted.select("query_id", F.col("rank").cast("int").alias("rank"))


def metrics(ranks: DataFrame) -> DataFrame:
    """hit@1, hit@3 and MRR@5 over queries; rank is that of the first right answer, or null."""
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 9)
    return ranks.agg(F.count("*").alias("n"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), F.round(F.avg(F.when(F.col("rank") <= 5, 1.0 / F.col("rank")).otherwise(0.0)), 9).alias("mrr_5"))


def gold(queries: DataFrame, clauses: DataFrame) -> DataFrame:
    """queries (query_id, record_id) with the doc and clause_id of their record; a record that isn't there, or is there twice, is an error."""
    n = clauses.groupBy("record_id").agg(F.count("*").alias("__n"), F.first("doc").alias("doc"), F.first("clause_id").alias("clause_id"))
    joined = queries.join(n, "record_id", "left")
    wrong = F.when(F.col("__n").isNull(), F.lit("no record ")).when(F.col("__n") > 1, F.lit("several records "))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.coalesce("record_id", F.lit("null")))).cast("string")).otherwise(F.col("doc"))
    return joined.select("query_id", "record_id", checked.alias("doc"), "clause_id").filter(F.col("doc").isNotNull() | F.col("clause_id").isNotNull())


def described_queries(queries: DataFrame, cache: DataFrame, otherwise: Callable[[Column], Column]) -> DataFrame:
    """queries with described: the cache's (raw_query, description) where it has the text, else made. A cache that holds a query twice is an error."""
    once = cache.groupBy(F.col("raw_query").alias("text")).agg(F.first("description").alias("__d"), F.count("*").alias("__n"))
    found = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("cached twice: "), F.col("text"))).cast("string")).otherwise(F.col("__d"))
    return queries.join(once, "text", "left").select(*(queries[c] if c != "text" else F.col("text") for c in queries.columns), F.coalesce(found, otherwise(F.col("text"))).alias("described"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """The metrics of two sets of ranks (mode, query_id, rank) side by side: variant, mode and those of metrics()."""
    both = before.withColumn("variant", F.lit("raw")).unionByName(after.withColumn("variant", F.lit("described")))
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 9)
    return both.groupBy("variant", "mode").agg(F.count("*").alias("n"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), F.round(F.avg(F.when(F.col("rank") <= 5, 1.0 / F.col("rank")).otherwise(0.0)), 9).alias("mrr_5"))
