"""The registered queries: each operator on the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.text import coverage, described, described_sql, slug, tokens, tokens_sql
from gneiss.operators import evaluate, graph, mutate, retrieval, vectors

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


_LINES = "lines AS (SELECT doc_id, source, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents))"

# sources and text ---------------------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, length(line) AS n_chars FROM lines")
def scan_lines(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", "line", F.length("line").alias("n_chars"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines WHERE regexp_matches(line, '(?i)stupid|worthless') ORDER BY doc_id, line_no LIMIT 200")
def grep_capped(spark, d):
    return _lines(spark, d).filter(F.col("line").rlike("(?i)stupid|worthless")).select("doc_id", "line_no", "line").orderBy("doc_id", "line_no").limit(200)


@query(f"""WITH {_LINES}, n AS (SELECT *, trim(line) AS norm FROM lines), pages AS (SELECT source, count(DISTINCT doc_id) AS pages FROM n GROUP BY source),
rep AS (SELECT source, norm FROM n JOIN pages USING (source) GROUP BY source, norm, pages HAVING pages >= 3 AND count(DISTINCT doc_id) >= greatest(3, pages // 4))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM n ANTI JOIN rep USING (source, norm) WHERE NOT regexp_full_match(norm, '[0-9]+')""")
def strip_repeated_lines(spark, d):
    n = _lines(spark, d).withColumn("norm", F.trim("line"))
    pages = n.groupBy("source").agg(F.countDistinct("doc_id").alias("pages"))
    rep = n.groupBy("source", "norm").agg(F.countDistinct("doc_id").alias("held")).join(pages, "source").filter((F.col("pages") >= 3) & (F.col("held") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 4))))
    return n.join(rep.select("source", "norm"), ["source", "norm"], "left_anti").filter(~F.col("norm").rlike("^[0-9]+$")).select("doc_id", "line_no", "line")


@query(f"""WITH {_LINES}, h AS (SELECT *, CASE WHEN length(line) BETWEEN 1 AND 30 THEN 1 ELSE 0 END AS head FROM lines),
s AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM h)
SELECT doc_id, CAST(seg AS BIGINT) AS segment, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, CAST(sum(length(line)) AS BIGINT) AS n_chars, max(CASE WHEN head = 1 THEN line END) AS heading FROM s GROUP BY doc_id, seg""")
def segment_headings(spark, d):
    h = _lines(spark, d).withColumn("head", F.when(F.length("line").between(1, 30), 1).otherwise(0))
    s = h.withColumn("segment", F.sum("head").over(Window.partitionBy("doc_id").orderBy("line_no")))
    return s.groupBy("doc_id", "segment").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.length("line")).alias("n_chars"), F.max(F.when(F.col("head") == 1, F.col("line"))).alias("heading"))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines WHERE length(line) > 60)
SELECT doc_id, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, count(*) AS n_lines FROM k GROUP BY doc_id, line_no - n""")
def line_islands(spark, d):
    k = _lines(spark, d).filter(F.length("line") > 60).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    return k.groupBy("doc_id", (F.col("line_no") - F.col("n")).alias("run")).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines")).drop("run")


@query("""WITH e AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'click')
SELECT v.event_id, max(e.event_id) AS inside FROM events v JOIN e ON v.user_id = e.user_id AND v.ts >= e.ts AND (e.until IS NULL OR v.ts < e.until) GROUP BY v.event_id""")
def point_in_interval(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    # the interval that holds a point is the last to start before it: a window, not a range join; peers at one instant are all inside
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    start = F.max(F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))).over(w)
    return e.select("event_id", start.alias("s")).filter("s is not null").select("event_id", F.col("s.event_id").alias("inside"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY doc_id, term")
def tokenize_counts(spark, d):
    return retrieval.postings(_t(spark, d, "documents"))


@query(f"SELECT item_id, {described_sql('text')} AS described FROM benchmark")
def hyde_normalise(spark, d):
    return _t(spark, d, "benchmark").select("item_id", described(F.col("text")).alias("described"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, d):
    return _t(spark, d, "part").select("p_partkey", slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


# retrieval ----------------------------------------------------------------------------------------------------------

_BM25 = f"""tok AS (SELECT doc_id, {tokens_sql('text')} AS a FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(a) AS term FROM tok) GROUP BY ALL),
len AS (SELECT doc_id, len(a) AS length FROM tok), tot AS (SELECT count(*) AS n, avg(length) AS mean FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
ask AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM post JOIN ask USING (term) JOIN df USING (term) JOIN len USING (doc_id), tot GROUP BY query_id, doc_id),
every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(bm.score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN bm ON bm.query_id = b.item_id AND bm.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every)"""


def _asked(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text")


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def bm25_topk(spark, d):
    return retrieval.search("bm25", _asked(spark, d), _docs(spark, d), 5)


@query(f"WITH {_BM25}, f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every JOIN documents USING (doc_id) WHERE lang = 'en') SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 5")
def bm25_filtered(spark, d):
    return retrieval.search("bm25", _asked(spark, d), _docs(spark, d), 5, only=_t(spark, d, "documents").filter("lang = 'en'"))


_DENSE = "dn AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM embeddings v, embeddings q WHERE {asked}), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn)"


_HUNDREDS = _DENSE.format(asked="q.vec_id % 100 = 0")
_ITEMS = _DENSE.format(asked="q.vec_id IN (SELECT item_id FROM benchmark)")


def _hundreds(spark, d) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated query set of a search: every vector whose id is divisible by 100."""
    e = _t(spark, d, "embeddings")
    return e, e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


@query(f"WITH {_HUNDREDS} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM dr WHERE rank <= 10")
def dense_topk(spark, d):
    return retrieval.top(vectors.best(*_hundreds(spark, d), 10), 10)


_RRF = f"{_BM25}, {_ITEMS}, fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM r UNION ALL SELECT query_id, doc_id, rank FROM dr) GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu)"


def _search(spark, d, mode, k):
    """Every benchmark item as a query, with the vector of its id."""
    e = _t(spark, d, "embeddings")
    asked = _asked(spark, d).join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return retrieval.search(mode, asked, _docs(spark, d), k, vectors=e)


@query(f"WITH {_RRF} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 10")
def rrf_hybrid(spark, d):
    return _search(spark, d, "hybrid", 10)


_COVER = "CASE WHEN len(list_distinct({q})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({q}), list_distinct({t}))) / len(list_distinct({q})) END"


@query(f"WITH {_RRF}, h AS (SELECT fr.query_id, fr.doc_id, round({_COVER.format(q='qt', t='dt')}, 6) AS score FROM fr JOIN (SELECT item_id, {tokens_sql('text')} AS qt FROM benchmark) b ON b.item_id = fr.query_id JOIN (SELECT doc_id, {tokens_sql('text')} AS dt FROM documents) x ON x.doc_id = fr.doc_id WHERE fr.rank <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 5")
def rerank_head(spark, d):
    return _search(spark, d, "hybrid_rerank", 5)


@query(f"WITH {_BM25}, h AS (SELECT query_id, rank, score, nullif(source, 'src0') || '/' || lang AS anchor FROM r JOIN documents USING (doc_id) WHERE rank <= 20), g AS (SELECT query_id, anchor, min(rank) AS first_rank, max(score) AS best_score FROM h WHERE anchor IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, anchor) AS place FROM g) SELECT query_id, anchor, CAST(first_rank AS INTEGER) AS first_rank, best_score, CAST(place AS INTEGER) AS place FROM o WHERE place <= 5")
def anchor_dedup(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", F.concat(F.nullif("source", F.lit("src0")), F.lit("/"), "lang").alias("anchor"))
    return retrieval.search_clauses("bm25", _asked(spark, d), docs, 5)


@query(f"WITH {_HUNDREDS}, l AS (SELECT vec_id, label FROM embeddings), g AS (SELECT query_id, min(rank) AS rank FROM (SELECT query_id, CASE WHEN a.label = b.label THEN k END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM dn WHERE query_id <> doc_id) o JOIN l a ON a.vec_id = o.query_id JOIN l b ON b.vec_id = o.doc_id) GROUP BY query_id) SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 9) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 9) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 / rank ELSE 0.0 END), 9) AS mrr_5 FROM g")
def ir_metrics(spark, d):
    return retrieval.metrics(vectors.first_right(*_hundreds(spark, d)))


@query(f"WITH q AS (SELECT item_id, {tokens_sql('text')} AS qt FROM benchmark), t AS (SELECT doc_id, {tokens_sql('text')} AS dt, length(text) AS n FROM documents), o AS (SELECT item_id, doc_id, round({_COVER.format(q='qt', t='dt')}, 6) AS overlap, n FROM q, t), p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, n, doc_id) AS k FROM o WHERE overlap >= 0.8) SELECT item_id, doc_id, overlap FROM p WHERE k = 1")
def content_overlap_best(spark, d):
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    o = retrieval.covering(_t(spark, d, "documents").select("doc_id", F.length("text").alias("n"), "text"), items, 0.8)
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "n", F.asc_nulls_last("doc_id"))
    return o.withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.col("query_id").alias("item_id"), "doc_id", "overlap")


@query(f"WITH c AS (SELECT conv_id, turn, {tokens_sql('text')} AS p, lead({tokens_sql('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations), s AS (SELECT conv_id, turn, round({_COVER.format(q='h', t='p')}, 4) AS score, len(h) AS n FROM c WHERE h IS NOT NULL) SELECT conv_id, turn, score, n > 0 AND score >= 0.6 AS entailed FROM s")
def lexical_entailment(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("p"))
    c = c.withColumn("h", F.lead("p").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("h is not null")
    return c.select("conv_id", "turn", F.round(coverage(F.col("h"), F.col("p")), 4).alias("score"), F.size("h").alias("n")).select("conv_id", "turn", "score", ((F.col("n") > 0) & (F.col("score") >= 0.6)).alias("entailed"))


@query("WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations) SELECT conv_id, turn, sha1(text || chr(9247) || h) AS key FROM c WHERE h IS NOT NULL")
def entail_cache_key(spark, d):
    c = _t(spark, d, "conversations").withColumn("h", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("h is not null")
    return c.select("conv_id", "turn", F.sha1(F.concat_ws(chr(9247), "text", "h").cast("binary")).alias("key"))


# graph --------------------------------------------------------------------------------------------------------------

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_EDGES = f"e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, l_quantity, l_returnflag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS dst FROM lineitem) WHERE dst IS NOT NULL AND l_quantity > 48 AND l_returnflag = 'R')"
_ALL_EDGES = f"e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS dst FROM lineitem) WHERE dst IS NOT NULL)"
_SEEDS = "seeds AS (SELECT p_partkey AS node FROM part WHERE p_size <= 5)"
_REACH = f"{_EDGES}, {_SEEDS}, r(node) AS (SELECT node FROM seeds UNION SELECT dst FROM r JOIN e ON src = node)"


def _all_edges(spark, d) -> DataFrame:
    """A part leads to the next one of its order."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *_ORDER.split(", "))
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    return li.select(F.col("l_partkey").alias("src"), nxt.alias("dst"), F.lit("call").alias("kind"), "l_quantity", "l_returnflag").filter("dst is not null")


def _edges(spark, d) -> DataFrame:
    """The sparse stand-in graph of the queries with a fixpoint; with every edge all parts would be in reach of one another."""
    return _all_edges(spark, d).filter("l_quantity > 48 and l_returnflag = 'R'").select("src", "dst", "kind")


def _nodes(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_brand").alias("program"), F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"))


def _seeds(spark, d) -> DataFrame:
    return _t(spark, d, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("node"))


@query(f"WITH {_ALL_EDGES} SELECT src, dst FROM e")
def call_edges(spark, d):
    return graph.callees(_all_edges(spark, d))


@query(f"WITH {_ALL_EDGES} SELECT dst, count(*) AS n_callers, min(src) AS first_caller, max(src) AS last_caller FROM e GROUP BY dst")
def callers(spark, d):
    return graph.callers(_all_edges(spark, d))


@query(f"WITH {_ALL_EDGES} SELECT src, count(*) AS n_callees, min(dst) AS first_callee FROM e GROUP BY src")
def callees(spark, d):
    return graph.callees(_all_edges(spark, d)).groupBy("src").agg(F.count("*").alias("n_callees"), F.min("dst").alias("first_callee"))


@query("WITH c AS (SELECT conv_id AS program, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, role FROM conversations) SELECT program, src, dst FROM c WHERE dst IS NOT NULL AND role <> 'system'")
def fallthrough_edges(spark, d):
    return graph.fallthrough(_t(spark, d, "conversations").select(F.col("conv_id").alias("program"), F.col("turn").alias("node"), F.col("turn").alias("ord"), (F.col("role") == "system").alias("transfers")))


@query("SELECT p_brand AS program, min(p_partkey) AS node FROM part GROUP BY p_brand")
def entry_points(spark, d):
    return graph.entry_points(_nodes(spark, d))


@query(f"WITH {_EDGES} SELECT p_brand AS program, p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM e) AND p_partkey NOT IN (SELECT min(p_partkey) FROM part GROUP BY p_brand)")
def forest_roots(spark, d):
    return graph.forest_roots(_nodes(spark, d), _edges(spark, d))


@query(f"WITH RECURSIVE {_REACH} SELECT node FROM r")
def reachable(spark, d):
    return graph.reachable(_edges(spark, d), _seeds(spark, d))


@query(f"WITH RECURSIVE {_REACH} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)")
def dead_nodes(spark, d):
    return graph.dead(_nodes(spark, d), _edges(spark, d), _seeds(spark, d))


@query(f"WITH RECURSIVE {_EDGES}, {_SEEDS}, r(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 60) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def bfs_depth(spark, d):
    return graph.depths(_edges(spark, d), _seeds(spark, d))


@query(f"WITH RECURSIVE {_EDGES}, {_SEEDS}, r(node) AS (SELECT node FROM seeds UNION SELECT src FROM r JOIN e ON dst = node) SELECT node, p_brand AS guard FROM r JOIN part ON p_partkey = node")
def slice_fixpoint(spark, d):
    back = _edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reachable(back, _seeds(spark, d)).join(_nodes(spark, d).select("node", F.col("program").alias("guard")), "node")


@query("WITH c AS (SELECT conv_id AS program, min(turn) + 1 AS low, max(turn) AS high FROM conversations GROUP BY conv_id) SELECT program, low, high, turn AS node FROM c JOIN conversations ON conv_id = program AND turn BETWEEN low AND high WHERE low <= high")
def thru_expand(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("program"), F.col("turn").alias("node"), F.col("turn").alias("ord"))
    return graph.thru(c, c.groupBy("program").agg((F.min("ord") + 1).alias("low"), F.max("ord").alias("high")))


@query(f"WITH {_ALL_EDGES} SELECT src AS variable, 'use' AS kind, count(*) AS n FROM e GROUP BY src UNION ALL SELECT dst, 'def', count(*) FROM e GROUP BY dst")
def trace_def_use(spark, d):
    return graph.callees(_all_edges(spark, d)).select(F.explode(F.array(F.struct(F.col("src").alias("variable"), F.lit("use").alias("kind")), F.struct(F.col("dst").alias("variable"), F.lit("def").alias("kind")))).alias("x")).groupBy("x.variable", "x.kind").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT n_name AS name, r_name AS owner FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT upper(c_mktsegment), n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), g AS (SELECT name, count(DISTINCT owner) AS owners FROM f GROUP BY name) SELECT name || CASE WHEN owners > 1 THEN '?ambiguous' ELSE '' END AS name, owners FROM g")
def resolve_ambiguous(spark, d):
    nation, region, customer = (_t(spark, d, x) for x in ("nation", "region", "customer"))
    f = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("owner")).union(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.upper("c_mktsegment"), "n_name"))
    g = f.groupBy("name").agg(F.countDistinct("owner").alias("owners"))
    return g.select(F.concat("name", F.when(F.col("owners") > 1, "?ambiguous").otherwise("")).alias("name"), "owners")


@query("WITH x AS (SELECT CAST(r_regionkey AS BIGINT) * 1000000000 AS ord, 1 AS level, r_name AS name FROM region UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 1000000000 + (n_nationkey + 1) * 10000000, 2, n_name FROM nation UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 1000000000 + (n_nationkey + 1) * 10000000 + c_custkey + 1, 3, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT name, level, CASE level WHEN 2 THEN last_value(CASE WHEN level = 1 THEN name END IGNORE NULLS) OVER (ORDER BY ord) WHEN 3 THEN last_value(CASE WHEN level = 2 THEN name END IGNORE NULLS) OVER (ORDER BY ord) END AS parent FROM x")
def layout_parent(spark, d):
    nation, region, customer = (_t(spark, d, x) for x in ("nation", "region", "customer"))
    top = F.col("n_regionkey").cast("long")
    under = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    x = region.select(F.col("r_regionkey").cast("long").alias("record"), F.lit(0).cast("long").alias("ord"), F.lit(1).alias("level"), F.col("r_name").alias("name"))
    x = x.union(nation.select(top, (F.col("n_nationkey") + 1) * 10000000, F.lit(2), "n_name")).union(under.select(top, (F.col("n_nationkey") + 1) * 10000000 + F.col("c_custkey") + 1, F.lit(3), "c_name"))
    w = Window.partitionBy("record").orderBy("ord")
    last = lambda k: F.last(F.when(F.col("level") == k, F.col("name")), ignorenulls=True).over(w)
    return x.select("name", "level", F.when(F.col("level") == 2, last(1)).when(F.col("level") == 3, last(2)).alias("parent"))


# evaluation ---------------------------------------------------------------------------------------------------------

_REC = "rec AS (SELECT quality = 0 AS gold, n_chars < 1500 AS predicted, lang = 'es' AS abstained, lang, toxic FROM documents JOIN labels USING (doc_id) WHERE NOT (lang = 'fr' AND n_chars % 7 = 0))"
_DET = "count(*) FILTER (NOT abstained AND gold AND predicted) AS tp, count(*) FILTER (NOT abstained AND NOT gold AND predicted) AS fp, count(*) FILTER (gold AND (abstained OR NOT predicted)) AS fn, count(*) FILTER (NOT abstained AND NOT gold AND NOT predicted) AS tn, count(*) AS n, count(*) FILTER (NOT abstained) AS answered"
_RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(answered / nullif(n, 0), 0), 9) AS answer_rate, round(coalesce((tp + tn) / nullif(answered, 0), 0), 9) AS answered_accuracy"


def _records(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, d, "labels"), "doc_id").select((F.col("quality") == 0).alias("gold"), (F.col("n_chars") < 1500).alias("predicted"), (F.col("lang") == "es").alias("abstained"), ((F.col("lang") == "fr") & (F.col("n_chars") % 7 == 0)).alias("infra"), "lang", "toxic")


@query(f"WITH {_REC}, c AS (SELECT {_DET} FROM rec) SELECT *, {_RATES} FROM c")
def detection_prf(spark, d):
    return evaluate.detection(_records(spark, d))


@query(f"WITH {_REC}, c AS (SELECT coalesce(lang, 'all') AS stratum, {_DET} FROM rec GROUP BY GROUPING SETS ((), (lang))) SELECT *, {_RATES} FROM c")
def evaluate_strata(spark, d):
    return evaluate.strata(_records(spark, d), "lang")


_GUESS = "g AS (SELECT lang AS gold, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS predicted FROM documents), k AS (SELECT l AS label, count(*) FILTER (gold = l AND predicted = l) AS tp, count(*) FILTER (predicted = l) AS said, count(*) FILTER (gold = l) AS support FROM g, (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) v(l) GROUP BY l), m AS (SELECT label, tp, support, round(coalesce(tp / nullif(said, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(said + support, 0), 0), 9) AS f1 FROM k)"


def _classes(spark, d) -> DataFrame:
    g = _t(spark, d, "documents").select(F.col("lang").alias("gold"), F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")).alias("predicted"))
    return evaluate.classification(g, ["de", "en", "es", "fr", "it"])


@query(f"WITH {_GUESS} SELECT * FROM m")
def classification(spark, d):
    return _classes(spark, d)


@query(f"WITH {_GUESS} SELECT round(avg(f1), 9) AS macro_f1, CAST(sum(support) AS BIGINT) AS support FROM m")
def classification_macro(spark, d):
    return evaluate.macro(_classes(spark, d))


@query(f"WITH t AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS a FROM documents), p AS (SELECT x.a AS gold, y.a AS predicted FROM t x JOIN t y ON y.doc_id = x.doc_id + 1) SELECT count(*) AS n, round(avg(coalesce(len(list_intersect(gold, predicted)) / nullif(len(list_distinct(list_concat(gold, predicted))), 0), 0)), 9) AS jaccard FROM p")
def localization_jaccard(spark, d):
    t = _t(spark, d, "documents").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("gold"))
    p = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("gold").alias("predicted")), "doc_id")
    return evaluate.localization(p, 3).select("n", "jaccard")


@query("SELECT CAST(toxic + 1 AS INTEGER) AS tier, count(*) AS n, count(*) FILTER (quality = 1) AS n_faithful, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM labels GROUP BY ROLLUP (toxic)")
def faithfulness_rollup(spark, d):
    return evaluate.faithfulness(_t(spark, d, "labels").select((F.col("toxic") + 1).alias("tier"), (F.col("quality") == 1).alias("faithful")))


_CONF = "cf AS (SELECT (n_chars % 1000) / 1000.0 AS confidence, quality = 1 AS correct FROM documents JOIN labels USING (doc_id))"


def _conf(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id").select(((F.col("n_chars") % 1000) / 1000.0).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@query(f"WITH {_CONF} SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM cf GROUP BY 1")
def calibration_bins(spark, d):
    return evaluate.calibration(_conf(spark, d))


@query(f"WITH {_CONF}, b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS m, sum(confidence) AS c, sum(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS r, sum((confidence - CASE WHEN correct THEN 1.0 ELSE 0.0 END) ** 2) AS b FROM cf GROUP BY 1) SELECT CAST(sum(m) AS BIGINT) AS n, round(sum(b) / sum(m), 6) AS brier, round(sum(abs(c - r)) / sum(m), 6) AS ece FROM b")
def brier_ece(spark, d):
    return evaluate.brier_ece(_conf(spark, d))


@query("SELECT md5(text) AS locus, min(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS both_right FROM documents GROUP BY text HAVING count(*) = 2 AND count(DISTINCT source) = 2 AND count(DISTINCT doc_id % 2) = 2")
def versioned_pairs(spark, d):
    return evaluate.versioned(_t(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("locus"), F.col("source").alias("version"), (F.col("doc_id") % 2).alias("verdict"), (F.col("lang") == "en").alias("correct")))


_AUC = "ranked AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM x) SELECT {by} count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg, round((sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 9) AS auc FROM ranked"


@query("WITH x AS (SELECT quality = 1 AS positive, n_chars AS v, 'n_chars' AS feature FROM documents JOIN labels USING (doc_id)), " + _AUC.format(by=""))
def auc_rank(spark, d):
    x = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id").select((F.col("quality") == 1).alias("positive"), "n_chars")
    return evaluate.auc(x, "n_chars")


@query("WITH y AS (SELECT quality = 1 AS positive, n_chars, length(text) - length(replace(text, ' ', '')) AS spaces, len(string_split(text, chr(10))) AS n_lines FROM documents JOIN labels USING (doc_id)), x AS (SELECT positive, n_chars AS v, 'n_chars' AS feature FROM y UNION ALL SELECT positive, spaces, 'spaces' FROM y UNION ALL SELECT positive, n_lines, 'n_lines' FROM y), " + _AUC.format(by="feature,") + " GROUP BY feature")
def auc_per_feature(spark, d):
    y = _t(spark, d, "documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))).cast("long").alias("spaces"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    y = y.join(_t(spark, d, "labels"), "doc_id").withColumn("positive", F.col("quality") == 1)
    x = y.select("positive", F.explode(F.create_map(F.lit("n_chars"), "n_chars", F.lit("spaces"), "spaces", F.lit("n_lines"), "n_lines")).alias("feature", "v"))
    return evaluate.auc(x, "v", ["feature"])


@query(f"WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL), q AS (SELECT doc_id, tf, sum(tf) OVER (PARTITION BY doc_id) AS n FROM p) SELECT doc_id, CAST(max(n) AS BIGINT) AS n_tokens, round(-sum(tf / n * log2(tf / n)), 6) AS entropy FROM q GROUP BY doc_id")
def surface_features(spark, d):
    p = retrieval.postings(_t(spark, d, "documents"))
    # -sum(p log2 p) from sums, so that a document's total needs no second pass
    s = p.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.sum(F.col("tf") * F.log2("tf")).alias("w"))
    return s.select("doc_id", "n_tokens", F.round(F.log2("n_tokens") - F.col("w") / F.col("n_tokens"), 6).alias("entropy"))


# benchmark policy ---------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) SELECT doc_id, lang, CAST(k AS INTEGER) AS k FROM r ORDER BY k, lang LIMIT 50")
def stratified_sample(spark, d):
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return _t(spark, d, "documents").select("doc_id", "lang", F.row_number().over(w).alias("k")).filter("k <= 50").orderBy("k", "lang").limit(50)


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'implausible' WHEN quality = 1 THEN 'accepted' ELSE 'unsure' END AS verdict, toxic = 1 AND quality = 1 AS overridden FROM labels")
def drop_policy(spark, d):
    raw, over = F.when(F.col("quality") == 1, "accepted").otherwise("unsure"), F.when(F.col("toxic") == 1, "implausible")
    return _t(spark, d, "labels").select("doc_id", F.coalesce(over, raw).alias("verdict"), ((F.col("toxic") == 1) & (F.col("quality") == 1)).alias("overridden"))


@query("WITH g AS (SELECT DISTINCT source FROM documents), c AS (SELECT DISTINCT lang FROM documents), q AS (SELECT unnest([0, 1]) AS quality), n AS (SELECT source, lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT g.source, c.lang, CAST(q.quality AS INTEGER) AS quality, coalesce(n, 0) AS n, coalesce(n, 0) < 10 AS fragile FROM g, c, q LEFT JOIN n ON n.source = g.source AND n.lang = c.lang AND n.quality = q.quality")
def split_counts_zero_cells(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")
    n = docs.join(_t(spark, d, "labels"), "doc_id").groupBy("source", "lang", "quality").agg(F.count("*").alias("n"))
    langs = docs.agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    cells = docs.select("source").distinct().crossJoin(F.broadcast(langs)).select("source", F.explode("langs").alias("lang")).select("source", "lang", F.explode(F.array(F.lit(0), F.lit(1))).alias("quality"))
    return cells.join(n, ["source", "lang", "quality"], "left").select("source", "lang", "quality", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < 10).alias("fragile"))


@query("SELECT o_orderkey, sha256('{\"custkey\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS run_key FROM orders")
def run_key(spark, d):
    body = F.to_json(F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return _t(spark, d, "orders").select("o_orderkey", F.sha2(body.cast("binary"), 256).alias("run_key"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def resume_antijoin(spark, d):
    done = _t(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT doc_id, 'drift_' || lpad(CAST(CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[1:16] AS UBIGINT) % 1000000 AS VARCHAR), 6, '0') AS instance_id FROM documents")
def instance_id(spark, d):
    return _t(spark, d, "documents").select("doc_id", mutate.instance_id(F.col("doc_id").cast("string")).alias("instance_id"))


@query("SELECT l_orderkey, l_linenumber, l_quantity < 1 AS bad_quantity, l_discount > 0.08 AND l_tax > 0.06 AS bad_rate, l_shipdate < o_orderdate AS early FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 1 OR (l_discount > 0.08 AND l_tax > 0.06) OR l_shipdate < o_orderdate")
def constraint_quarantine(spark, d):
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rules = {"bad_quantity": F.col("l_quantity") < 1, "bad_rate": (F.col("l_discount") > 0.08) & (F.col("l_tax") > 0.06), "early": F.col("l_shipdate") < F.col("o_orderdate")}
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in rules.items())).filter("bad_quantity or bad_rate or early")


@query("WITH c AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) SELECT conv_id, CAST(max(used) AS BIGINT) AS used, min(turn) FILTER (used > 1500) AS breach FROM c GROUP BY conv_id")
def cumulative_budget(spark, d):
    c = _t(spark, d, "conversations").withColumn("used", F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.max("used").alias("used"), F.min(F.when(F.col("used") > 1500, F.col("turn"))).alias("breach"))


@query("WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS seen FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(seen, x)), ',') AS missing FROM s")
def hunt_guard_errors(spark, d):
    need = F.array(F.lit("click"), F.lit("purchase"), F.lit("view"))
    return _t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_except(need, F.collect_set("event_type")), ",").alias("missing"))


@query("SELECT doc_id, CASE WHEN toxic = 0 AND quality = 1 THEN 1 WHEN n_chars > 2000 THEN 2 WHEN quality = 1 THEN 3 END AS tier, CASE WHEN toxic = 0 AND quality = 1 THEN 1 WHEN n_chars > 2000 THEN 2 ELSE 3 END AS attempts, CASE WHEN toxic = 0 AND quality = 1 THEN 0.95::DOUBLE WHEN n_chars > 2000 THEN 0.85::DOUBLE WHEN quality = 1 THEN 0.6::DOUBLE END AS confidence FROM documents JOIN labels USING (doc_id)")
def tier_ladder(spark, d):
    x = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    one, two, three = (F.col("toxic") == 0) & (F.col("quality") == 1), F.col("n_chars") > 2000, F.col("quality") == 1
    ladder = lambda a, b, c: F.when(one, a).when(two, b).when(three, c)
    return x.select("doc_id", ladder(1, 2, 3).alias("tier"), F.when(one, 1).when(two, 2).otherwise(3).alias("attempts"), ladder(0.95, 0.85, 0.6).alias("confidence"))


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_linenumber, l_partkey)) AS best, max(l_extendedprice) AS score FROM lineitem GROUP BY l_orderkey")
def best_of_hunts(spark, d):
    order = F.struct("l_extendedprice", -F.col("l_linenumber"), "l_partkey")
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", order).alias("best"), F.max("l_extendedprice").alias("score"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def props_json(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


def _pairs(spark, d) -> DataFrame:
    return _t(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))


@query()
def bootstrap_delta(spark, d):
    return evaluate.resampled(_pairs(spark, d), 10_000, 4405).agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))


@query()
def randomization_p(spark, d):
    return evaluate.randomization_p(_pairs(spark, d), 20_000, 4405).select(F.round("p", 6).alias("p"))
