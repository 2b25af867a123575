"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question asked again with other numbers or names has the
same template. Windows of WINDOW canonical words of every whole document are hash-joined with those of the benchmark,
and a match is compared word by word, so a chance equality of hashes counts for nothing. An item is looked up by kinds:

* NAMED: numbers, units and names (any word of a capital and a small letter) are placeholders;
* COUNTED: numbers and units, in any case, are. A language that capitalises its nouns, and a text in other case, lose no word here;
* VERBATIM: none are. It serves the items that the other two can't: those of fewer than SHORTEST words, and those of
  which too few windows count.

A window of the first two kinds counts if at least LITERALS of its words are no placeholders, and a kind serves an item
of which at least half of the windows count. Items of fewer than WINDOW words have one window, of their own length.

On a match the placeholders' values are compared. Within one alignment of an item with a document, each value of the item
must always stand for the same value of the document: a question asked anew renames its slots consistently, a chance
likeness doesn't. Where a value stands for several, only the windows that hold it are void, and of those not the verbatim
ones. An item is found if the windows left hold at least SHARE per cent of those of a kind that count; by VERBATIM, if
all its windows stand in a row.

Case counts only for what is a name: a copy of an item in capitals, small letters or title case has the item's COUNTED
template, units included, and where that serves no item, its VERBATIM one. Number words are words, so an item asked again in words is found only where enough
other windows remain.

Benchmarks are small and documents are not: the benchmark's windows are counted and broadcast within a bound, beyond
which the join shuffles rows of one window of words each; document windows move nowhere otherwise. Documents are read
once. Only matches are aggregated, by document and item.

Nulls, empty and repeated rows: null and empty texts, and those without a word, of either table, have no windows and match
nothing; documents with a null id can't be reported and are left out of matches; repeated documents share one result, as
do different texts under one id; repeated items are each reported under their own id; matches have no order, so ties do
not arise; an empty table of either kind matches nothing; characters that the operator uses as its own marks are taken out of
texts first; only doc_id, text and item_id are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import scratch

WINDOW = 8
LITERALS = 4
SHORTEST = 5
SHARE = 50
#: Windows of the benchmark that are broadcast; one takes some 300 bytes.
BROADCAST_WINDOWS = 200_000

KINDS = NAMED, COUNTED, VERBATIM = range(3)

#: Marks of the placeholders, from the private use area, and of a point or comma inside a number.
NUMBER, UNIT, NAME, POINT = "", "", "", ""
MARKS = NUMBER + UNIT + NAME + POINT

UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent mph kmh degrees degree"
).split()

#: (pattern, replacement) in order, for texts with a digit between added spaces.
NUMBERS = (
    (r"([0-9])[.,]([0-9])", f"$1{POINT}$2"),
    (r"([0-9])[.,]([0-9])", f"$1{POINT}$2"),
    (rf"([0-9]) ?(%|(?i:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}))([^\p{{L}}\p{{N}}])", f"$1 {UNIT}$2 $3"),
    (rf"([0-9]+(?:{POINT}[0-9]+)*)", f" {NUMBER}$1 "),
)
#: Letters whose capital form is other letters, so that a copy in capitals is the same words.
FOLDED = (("ß", "ss"), ("ẞ", "SS"))

#: Single characters where they can be, which Java matches by a bit set.
SPLIT = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum() and chr(c) != "%") + "\\xA1\\xAB\\xBB\\xBF\\x{2010}-\\x{2027}\\x{3000}-\\x{3002}]+"
CAPITAL = r"^\p{Lu}\p{Ll}"


def marked_words(text: str = "text") -> Column:
    """The words of a text in order; numbers and units after their mark. The first and the last may be empty."""
    own = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), [*((m, "") for m in MARKS), *FOLDED], F.col(text))
    spaced = F.concat(F.lit(" "), own, F.lit(" "))
    numbered = F.when(own.rlike("[0-9]"), reduce(lambda t, r: F.regexp_replace(t, *r), NUMBERS, spaced)).otherwise(own)
    return F.split(numbered, SPLIT, -1)


def _is_marked(word: Column) -> Column:
    return (word >= NUMBER) & (word < NAME)


def is_slot(word: Column, kind: int) -> Column:
    if kind == VERBATIM:
        return F.lit(False)
    return _is_marked(word) | word.rlike(CAPITAL) if kind == NAMED else _is_marked(word)


def in_template(word: Column, kind: int) -> Column:
    """What a word is in a template of a kind."""
    if kind == VERBATIM:
        return F.lower(word)
    plain = F.when(_is_marked(word), F.substring(word, 1, 1))
    return (plain.when(word.rlike(CAPITAL), F.lit(NAME)) if kind == NAMED else plain).otherwise(F.lower(word))


def value(word: Column) -> Column:
    """What stands in a slot."""
    return F.lower(F.when(_is_marked(word), F.substring(word, 2, 1 << 30)).otherwise(word))


def _hashes(kind: int) -> Column:
    """The hashes of all words in templates of a kind."""
    if kind == VERBATIM:
        return F.transform("words", lambda w: F.xxhash64(F.lower(w)))
    counted = F.transform("words", lambda w: F.when(_is_marked(w), F.xxhash64(F.substring(w, 1, 1))).otherwise(F.xxhash64(F.lower(w))))
    small_letter = lambda w: (w >= "a") & (w < "{")  # noqa: E731  # spares most words the pattern
    return counted if kind == COUNTED else F.zip_with("words", counted, lambda w, h: F.when(small_letter(w), h).when(w.rlike(CAPITAL), F.xxhash64(F.lit(NAME))).otherwise(h))


def _key(kind: int, length: int, hash_at) -> Column:
    """The key of one window: hash_at(i) is the hash of its word i. A window without a name has one key as NAMED and as COUNTED."""
    return F.xxhash64(F.lit(length if kind == VERBATIM else -length), *(hash_at(i) for i in range(length)))


def windows(texts: DataFrame, id_: str, sorts: list[tuple[int, int]]) -> DataFrame:
    """id, words, at (the first word) and key of every window of each (kind, length) in sorts.

    The hashes of words come from lambdas, once a word; windows are rows, and their keys compiled code.
    """
    out = texts.filter(F.col(id_).isNotNull() & F.col("text").isNotNull()).select(id_, F.filter(marked_words(), lambda w: w != "").alias("words"))
    out = out.withColumns({f"h{k}": _hashes(k) for k in sorted({k for k, _ in sorts})})
    # the outer form: else a filter on the words is inferred and pushed down, and makes them again
    out = out.withColumn("at", F.explode_outer(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))))
    none, each = F.expr("cast(array() as array<bigint>)"), []
    for length in sorted({n for _, n in sorts}):
        keys = {k: _key(k, length, lambda i: F.get(f"h{k}", F.col("at") + i)) for k, n in sorts if n == length}  # noqa: B023  # used at once
        one = F.array(*keys.values())
        if NAMED in keys and COUNTED in keys:
            one = F.when(keys[NAMED] == keys[COUNTED], F.array(*(c for k, c in keys.items() if k != NAMED))).otherwise(one)
        each.append(F.when(F.col("at") + length <= F.size("words"), one).otherwise(none))
    return out.select(id_, "words", "at", F.explode(F.concat(*each)).alias("key"))


def _by_kind(make) -> Column:
    return F.when(F.col("kind") == NAMED, make(NAMED)).when(F.col("kind") == COUNTED, make(COUNTED)).otherwise(make(VERBATIM))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, kind, length, item_at, key and own (the words) of every window that is looked up, and total, their number by kind."""
    words = benchmark.filter("item_id is not null and text is not null").select("item_id", F.filter(marked_words(), lambda w: w != "").alias("words"))
    words = words.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(WINDOW))).distinct()
    each = words.select("item_id", "length", F.size("words").alias("n"), F.explode(F.array(*map(F.lit, KINDS))).alias("kind"), "words")
    each = each.select("item_id", "length", "n", "kind", "words", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))).alias("item_at"))
    each = each.withColumn("own", F.slice("words", F.col("item_at") + 1, F.col("length"))).drop("words")
    literals = _by_kind(lambda k: F.size(F.filter("own", lambda w: ~is_slot(w, k))))
    counts = (F.col("kind") < VERBATIM) & (F.col("n") >= SHORTEST) & (literals >= F.least(F.lit(LITERALS), F.col("length") - 1))
    each = scratch(each.withColumn("counts", counts), "item_windows")
    served = each.filter(F.col("kind") < VERBATIM).groupBy("item_id", "kind").agg(F.sum(F.col("counts").cast("int")).alias("c"), F.count("*").alias("n")).filter("c > 0 and 2 * c >= n")
    used = each.filter("counts").join(served.select("item_id", "kind"), ["item_id", "kind"], "left_semi")
    rest = each.filter(F.col("kind") == VERBATIM).join(served.select("item_id"), "item_id", "left_anti")
    out = used.unionByName(rest)
    hashes = F.transform("own", lambda w: _by_kind(lambda k: F.xxhash64(in_template(w, k))))
    one = lambda n: _by_kind(lambda k: _key(k, n, lambda i: F.get("h", F.lit(i))))
    key = reduce(lambda e, n: e.when(F.col("length") == n, one(n)), range(2, WINDOW + 1), F.when(F.col("length") == 1, one(1)))
    total = out.groupBy("item_id", "kind").agg(F.countDistinct("item_at").alias("total"))
    return out.withColumn("h", hashes).withColumn("key", key).select("item_id", "kind", "length", "item_at", "key", "own").distinct().join(total, ["item_id", "kind"])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, kind, item_at, total, alignment, slots (item and doc values) and same (whether it isn't the hashes alone) of every window in common."""
    items = scratch(item_windows(benchmark), "items")
    sorts = sorted((r["kind"], r["length"]) for r in items.select("kind", "length").distinct().collect())  # at most 3 * WINDOW values
    if not sorts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, kind int, item_at int, total long, alignment int, slots array<struct<item: string, doc: string>>, same boolean")
    here = windows(docs, "doc_id", sorts)
    if items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)
    else:  # a row takes its own window's words to the shuffle, and no others
        here = here.withColumn("words", F.slice("words", F.col("at") + 1, F.lit(WINDOW))).withColumn("from", F.lit(1))
    first = F.col("from") if "from" in here.columns else F.col("at") + 1
    found = here.join(items, "key").withColumn("said", F.slice("words", first, F.col("length")))
    same = _by_kind(lambda k: F.transform("said", lambda w: in_template(w, k)) == F.transform("own", lambda w: in_template(w, k)))
    both = F.zip_with("own", "said", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    slots = F.transform(F.filter(both, lambda p: _by_kind(lambda k: is_slot(p["a"], k))), lambda p: F.struct(value(p["a"]).alias("item"), value(p["b"]).alias("doc")))
    # a column and no filter: as a condition of the join it would keep the join from being compiled with the windows
    return found.select("doc_id", "item_id", "kind", "item_at", "total", (F.col("at") - F.col("item_at")).alias("alignment"), slots.alias("slots"), same.alias("same"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows (of the item found), total and reparameterised, for every item found in a document."""
    found = matches(docs, benchmark)
    aligned = found.groupBy("doc_id", "item_id", "kind", "alignment", "total").agg(F.collect_set(F.when(F.col("same"), F.struct("item_at", "slots"))).alias("hits"))
    aligned = aligned.withColumn("items", F.transform(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["slots"]))), lambda p: p["item"]))
    # a value with several counterparts is there several times
    aligned = aligned.withColumn("torn", F.filter(F.array_distinct("items"), lambda v: F.size(F.filter("items", lambda x: x == v)) > 1))
    sound = lambda h: ~F.exists(h["slots"], lambda p: p["item"] != p["doc"]) | ~F.exists(h["slots"], lambda p: F.array_contains("torn", p["item"]))
    changed = F.exists("hits", lambda h: F.exists(h["slots"], lambda p: p["item"] != p["doc"]))  # in void windows too
    consistent = aligned.withColumn("changed", changed).withColumn("places", F.array_distinct(F.transform(F.filter("hits", sound), lambda h: h["item_at"]))).filter(F.size("places") > 0)
    by_kind = consistent.groupBy("doc_id", "item_id", "kind", "total").agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("windows"), F.max(F.size("places")).alias("in_a_row"), F.min(F.col("changed").cast("int")).alias("changed"))
    enough = F.when(F.col("kind") == VERBATIM, F.col("in_a_row") == F.col("total")).otherwise(F.col("windows") * 100 >= SHARE * F.col("total"))
    by_item = by_kind.filter(enough).groupBy("doc_id", "item_id").agg(F.min(F.struct("kind", F.col("windows").cast("long").alias("windows"), F.col("total").cast("long").alias("total"))).alias("best"), F.min("changed").alias("changed"))
    return by_item.select("doc_id", "item_id", "best.windows", "best.total", (F.col("changed") == 1).alias("reparameterised"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items and item_ids (ascending, joined by commas) of every document that holds an item."""
    return leaks(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda i: i.cast("string")), ",").alias("item_ids"))
