"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct WIDTH-word shingles (lower-cased A-Z, words between ASCII white space; fewer
words: the whole sequence as one shingle; no words: nothing). Its signature is SYMBOLS MinHash values, cut to BITS
bits each, in CHUNKS chunks. The distance of two signatures is the number of symbols that differ.

Multi-index: two signatures within CHUNKS * (ERRORS + 1) - 1 = 27 symbols of each other have, by pigeonhole, at least
one chunk with at most ERRORS = 1 differing symbol. All chunk errors that are allowed are enumerated, as the chunk
without each of its symbols in turn, and indexed; so every such pair meets under some key. What meets is confirmed on the
full sets, so no link is false.

What can be missed: a linked pair further apart than 27 symbols meets only if one of its 14 chunks has at most one
error, and a pair that meets is confirmed only within FAR symbols. At a similarity of exactly 0.75 the first fails by a
chance of 0.37 ** 14, under one in a million, and the second of under one in 10 ** 8; both fall steeply above it.

Pairs within a group of copies are never enumerated:
1. Documents with equal sets are one vertex, named by its place in the order of document ids (partial aggregation by
   set digest). Two texts under one id are two vertices.
2. Under each key every vertex is compared with the first one only: a number of pairs linear in the rows.
3. Components of the confirmed links are found. Where a key still holds several, all its vertices are compared with
   TURNS more pivots, by hashes. Only where a key then still holds several components are pairs across components
   compared, and those that the triangle inequality of Jaccard distance rules out, by the known distances to each
   component's pivot, aren't.
4. A key under which that would be more than CROWD pairs a vertex (a passage that many documents share) is crowded. Its
   vertices are joined by an exact way instead: of each set, ordered by how many of these vertices hold a shingle, the
   rarest n - ceil(0.75 n) + 1; two sets that are linked share one of those, at places that leave room for enough others,
   and a common passage isn't among them.
No key is dropped or cut. A family of texts that are all just less alike than 0.75 and share their rare shingles is
compared pair by pair, since nothing short of that tells which pairs are links.

Texts are read twice more after the sketch, for the sets of those that a pair needs: they are joined with those vertices
by broadcast within a counted bound, else by a shuffle.

Nulls, empty and repeated rows: null and blank texts have an empty set, link with nothing and are kept; rows with a
null id have a null component, link with nothing and are kept; repeated rows are one vertex, and rows with one id and
different texts get a result each, by their own text; ties do not occur, since a component is named by its smallest id;
an empty table gives an empty table; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import discard, scratch, small, values
from gneiss.llm.components import connected

WIDTH = 5
#: Linked if PER * intersection >= LEAST * union.
PER, LEAST = 100, 75
CHUNKS, CHUNK, ERRORS = 14, 5, 1
SYMBOLS, BITS = CHUNKS * CHUNK, 16
#: Candidates with more differing symbols than this are not confirmed: 6.2 standard deviations over the mean at similarity 0.75, under one link in 10 ** 8.
FAR = 40
#: Pairs across components, a vertex, beyond which a key is crowded.
CROWD = 4
#: Other pivots tried.
TURNS = 3
#: Shingles that are hashed at a time.
BLOCK = 4096
#: Vertices that are broadcast to find their texts; one takes some 100 bytes.
BROADCAST_SETS = 250_000

_GOLD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(_GOLD))
_TIMES, _PLUS = _SEEDS[:SYMBOLS, None] | np.uint64(1), _SEEDS[SYMBOLS:, None]


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()  # of bytes: A-Z only, and exactly ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = (x + h[i : len(h) - n + 1 + i]) * np.uint64(_GOLD)
        x ^= x >> np.uint64(32)
    x = np.sort(_mixed(x))
    return x[np.append(True, x[1:] != x[:-1])]


def signature(own: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of a set that isn't empty."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), BLOCK):
        np.minimum(least, (_TIMES * own[None, i : i + BLOCK] + _PLUS).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(64 - BITS)).astype(">u2")


def row_hash(text: str = "text") -> Column:
    """What tells texts under one id apart."""
    return F.xxhash64(F.lit("row"), F.col(text).cast("string"))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, n (size of the set), digest (of the set) and signature of every row; the last two are null for an empty set."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            n, digest, sign = [], [], []
            for text in values(batch.column(1)):
                own = shingles(text)
                n.append(len(own))
                digest.append(xxh3_128_digest(own.tobytes()) if len(own) else None)
                sign.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary())], names=["doc_id", "row_hash", "n", "digest", "signature"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), row_hash().alias("row_hash"))
    return texts.mapInArrow(run, "doc_id long, row_hash long, n long, digest binary, signature binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """vertex and the whole set as an array of longs, of every row (vertex, digest, text) whose set has that digest; a task gives a vertex once."""

    def run(batches):
        from xxhash import xxh3_128_digest

        seen = set()
        for batch in batches:
            vertices, own = [], []
            for vertex, digest, text in zip(*map(values, batch.columns), strict=True):
                if vertex not in seen and xxh3_128_digest((x := shingles(text)).tobytes()) == digest:
                    seen.add(vertex)
                    vertices.append(vertex)
                    own.append(x.view(np.int64))
            ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
            flat = np.concatenate(own) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(vertices, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["vertex", "members"])

    return docs.mapInArrow(run, "vertex long, members array<long>")


def index_keys(signature: str = "signature") -> Column:
    """A key for each chunk and each set of ERRORS symbols that it may differ in."""
    size = CHUNK * BITS // 8
    step = BITS // 8
    keys = []
    for chunk in range(CHUNKS):
        for out in range(CHUNK):
            at = chunk * size
            left = F.substring(signature, at + 1, out * step)
            right = F.substring(signature, at + (out + 1) * step + 1, size - (out + 1) * step)
            keys.append(F.xxhash64(F.lit(chunk * CHUNK + out), F.concat(left, right)))
    return F.array(*keys)


def _near_size(a: str, b: str) -> Column:
    return PER * F.least(a, b) >= LEAST * F.greatest(a, b)


def _differing(a: str, b: str) -> Column:
    step = BITS // 8
    return F.expr(f"aggregate(sequence(0, {SYMBOLS - 1}), 0, (n, i) -> n + if(substring({a}, {step} * i + 1, {step}) = substring({b}, {step} * i + 1, {step}), 0, 1))")


def _within(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sizes and signatures allow a link."""
    side = lambda x: vertices.select(F.col("vertex").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_near_size("n_a", "n_b")).filter(_differing("s_a", "s_b") <= FAR).select("a", "b", "n_a", "n_b")


def sets_of(ids: DataFrame, most: int, vertices: DataFrame, docs: DataFrame, keep) -> DataFrame:
    """vertex and members of the vertices in ids (vertex, distinct; at most so many), each once; sets are made again for these only."""
    wanted = vertices.select("vertex", "first_id", "digest").join(ids, "vertex", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text").cast("string").cast("binary").alias("text"))
    sets = keep(full_sets(texts.join(F.broadcast(wanted) if most <= BROADCAST_SETS else wanted, "first_id").select("vertex", "digest", "text")), "sets")
    # repeated documents that several tasks read
    again = sets.groupBy("vertex").agg(F.count("*").alias("held")).filter("held > 1")
    return sets if again.isEmpty() else keep(sets.dropDuplicates(["vertex"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b), a scratch table, with inter, the size of the intersection of the full sets. Only sets that stand on its own side of a pair move."""
    few = pairs.count() <= BROADCAST_SETS

    def side(x):
        ids = pairs.select(F.col(x).alias("vertex")).distinct()
        return sets.join(F.broadcast(ids) if few else ids, "vertex", "left_semi").select(F.col("vertex").alias(x), F.col("members").alias(f"m_{x}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("m_a", "m_b")).cast("long").alias("inter"))


def _linked() -> Column:
    return PER * F.col("inter") >= LEAST * (F.col("n_a") + F.col("n_b") - F.col("inter"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return decided(docs).drop("row_hash")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of its smallest id, and there of the smallest row_hash; of repeated rows any one."""
    paths = []
    out = scratch(decided(docs), "decided", paths)
    gone = out.filter(~F.col("kept")).select("doc_id", "row_hash").distinct()
    # a component whose smallest id has several rows
    several = out.filter(F.col("kept") & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id", "component_id").agg(F.count("*").alias("held"), F.min("row_hash").alias("first")).filter("held > 1")
    several = scratch(several.select("doc_id", "first"), "several", paths)
    also = out.filter("kept").join(several, "doc_id").filter(F.col("row_hash") != F.col("first")).select("doc_id", "row_hash").distinct()
    gone = scratch(gone.union(also), "gone")
    keyed = docs.withColumn("__row_hash", row_hash()).withColumn("__id", F.col("doc_id").cast("long"))
    left = keyed.join(small(gone.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__row_hash"))), ["__id", "__row_hash"], "left_anti")
    if several.isEmpty():
        discard(docs.sparkSession, paths)
        return left.select(*(f"`{c}`" for c in docs.columns))
    ids = several.select(F.col("doc_id").alias("__id"))
    once = left.join(ids, "__id", "left_semi").dropDuplicates(["__id", "__row_hash"])
    return left.join(ids, "__id", "left_anti").unionByName(once).select(*(f"`{c}`" for c in docs.columns))


def decided(docs: DataFrame) -> DataFrame:
    """What near_duplicates() gives, and the row_hash of each row's text."""
    spark, paths = docs.sparkSession, []
    keep = lambda df, name: scratch(df, name, paths)
    rows = scratch(sketch(docs), "sketch")
    by_set = rows.filter("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"))
    # numbers are given once, as the table is written; any later stage reads them
    vertices = scratch(by_set.orderBy("first_id", "digest").withColumn("vertex", F.monotonically_increasing_id()), "vertices")
    component = _components(vertices, docs, keep, paths)
    named = vertices.select("digest", "first_id", "vertex").join(component, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    of_set = scratch(named.join(named.groupBy("component").agg(F.min("first_id").alias("least_id")), "component").select("digest", "least_id"), "of_set")
    discard(spark, paths)
    return rows.join(of_set, "digest", "left").select(
        "doc_id",
        "row_hash",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components(vertices: DataFrame, docs: DataFrame, keep, paths: list[str]) -> DataFrame:
    """(vertex, component) of every vertex with a link."""
    keys = vertices.select("vertex", "n", F.explode(index_keys()).alias("key"))
    shared = keys.groupBy("key").agg(F.min("vertex").alias("lead"), F.count("*").alias("held")).filter("held > 1").select("key", "lead")
    met = keep(keys.join(shared, "key"), "met")  # key, vertex, n, lead

    stars = met.filter("vertex <> lead").select(F.col("lead").alias("a"), F.col("vertex").alias("b")).distinct()
    stars = keep(_within(stars, vertices), "stars")
    ids = stars.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    compared = keep(confirmed(stars, sets_of(ids, 2 * stars.count(), vertices, docs, keep)), "compared")
    component = connected(compared.filter(_linked()).select("a", "b"), paths)

    # groups of copies that aren't all like their first
    named = keep(_mixed_keys(met.drop("lead"), component), "mixed")
    ids = keep(named.select("vertex").distinct(), "ids")
    held = ids.count()
    if not held:
        return component
    sets = sets_of(ids, held, vertices, docs, keep)
    picked = [F.min_by(F.struct("vertex", "component"), F.xxhash64(F.lit(turn), "vertex")) for turn in range(TURNS)]
    pivot = named.groupBy("key").agg(F.array_distinct(F.array(*picked)).alias("p")).select("key", F.explode("p").alias("p"))
    pairs = named.join(pivot, "key").filter("component <> p.component").select(F.least("vertex", "p.vertex").alias("a"), F.greatest("vertex", "p.vertex").alias("b")).distinct()
    more = keep(confirmed(keep(_within(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"), vertices), "pivots"), sets), "compared")
    compared = keep(compared.union(more), "compared")
    if not more.filter(_linked()).isEmpty():
        component = connected(compared.filter(_linked()).select("a", "b"), paths)
        named = _mixed_keys(named.drop("component"), component)
    # each vertex' distance to its component's first vertex, where that was compared
    far = compared.select(F.col("a").alias("component"), F.col("b").alias("vertex"), (1 - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("off"))
    off = F.when(F.col("vertex") == F.col("component"), 0.0).otherwise(F.col("off"))
    open_ = keep(named.join(far, ["component", "vertex"], "left").withColumn("off", off), "open")
    if open_.isEmpty():
        return component
    across = _across(open_, compared, vertices, sets, keep)
    new = keep(across, "across")
    return connected(compared.filter(_linked()).select("a", "b").unionByName(new), paths) if not new.isEmpty() else component


def _mixed_keys(met: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of met under keys that hold several components, with the component."""
    named = met.join(component, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return named.join(mixed, "key")


def _across(met: DataFrame, compared: DataFrame, vertices: DataFrame, sets: DataFrame, keep) -> DataFrame:
    """Links between vertices that share a key but not, so far, a component. met: key, vertex, n, component, off."""
    load = met.groupBy("key", "component").agg(F.count("*").alias("h")).groupBy("key").agg(F.sum("h").alias("all"), F.sum(F.col("h") * F.col("h")).alias("within"))
    crowded = keep(load.select("key", (F.col("all") * F.col("all") - F.col("within") > 2 * CROWD * F.col("all")).alias("crowded")), "load")
    columns = ["key", "vertex", "n", "component", "off", "room"]
    by_key = met.join(crowded.filter("not crowded").select("key"), "key").withColumn("room", PER * F.col("n")).select(columns)
    if not crowded.filter("crowded").isEmpty():
        dense = met.join(crowded.filter("crowded").select("key"), "key").select("vertex", "n", "component", "off").distinct()
        # the two kinds of key are both hashes; if two were equal, that would be a candidate more
        by_key = by_key.union(keep(_rarest(dense, sets), "rarest").select(columns))
    found = _meeting(by_key, compared)
    untried = found.join(compared.select("a", "b"), ["a", "b"], "left_anti")
    return confirmed(keep(_within(untried, vertices), "untried"), sets).filter(_linked()).select("a", "b")


def _meeting(met: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs (a, b) of vertices of different components that meet under a key. met: key, vertex, n, component, off, room.

    room is PER * n - (PER + LEAST) * place, of the key among the ordered shingles (0 for other keys): the larger of two
    linked sets has at most room / LEAST members, where the key is the first that they share.
    """
    of = met.groupBy("key", "component").agg(F.max("room").alias("room"), F.min("n").alias("n"))
    end = lambda x: of.select("key", F.col("component").alias(f"c_{x}"), F.col("room").alias(f"room_{x}"), F.col("n").alias(f"n_{x}"))
    fits = (F.col("room_a") >= LEAST * F.col("n_b")) & (F.col("room_b") >= LEAST * F.col("n_a"))
    pairs = end("a").join(end("b"), "key").filter(F.col("c_a") < F.col("c_b")).filter(fits).select("key", "c_a", "c_b")
    # how far apart the components' pivots are known to be
    apart = compared.select(F.col("a").alias("c_a"), F.col("b").alias("c_b"), (1 - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("apart"))
    pairs = pairs.join(apart, ["c_a", "c_b"], "left")
    side = lambda x: met.select("key", F.col("component").alias(f"c_{x}"), F.col("vertex").alias(x), F.col("n").alias(f"n_{x}"), F.col("room").alias(f"room_{x}"), F.col("off").alias(f"off_{x}"))
    # apart <= off_a + distance(a, b) + off_b, so a larger one leaves no link; an unknown distance rules nothing out
    possible = F.coalesce(F.col("apart") <= F.col("off_a") + F.col("off_b") + (1 - LEAST / PER) + 1e-9, F.lit(True))
    found = pairs.join(side("a"), ["key", "c_a"]).join(side("b"), ["key", "c_b"]).filter(fits).filter(possible)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rarest(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each vertex in dense (vertex, n, component, off), the rarest shingles, as keys, with room."""
    members = sets.join(dense.select("vertex"), "vertex", "left_semi").select("vertex", F.explode("members").alias("key"))
    df = members.groupBy("key").agg(F.count("*").alias("df"))
    # a shingle of one vertex only joins nothing, but takes a place among the rarest
    ranked = members.join(df, "key").groupBy("vertex").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("r"))
    n = F.size("r")
    first = ranked.select("vertex", F.posexplode(F.slice("r", F.lit(1), n - F.ceil(n * LEAST / PER).cast("int") + 1)).alias("place", "x")).filter("x.df > 1")
    return first.select("vertex", F.col("x.key").alias("key"), "place").join(dense, "vertex").withColumn("room", PER * F.col("n") - (PER + LEAST) * F.col("place")).drop("place")
