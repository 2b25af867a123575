"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = (
    "a an and any are as at be been by for from has have if in into is it its may must no not of on or shall so than that the their them then there these this to was were which who will with within without"
).split()

#: Suffixes in order and what stands for them; three characters must be left before one.
SUFFIXES = (("ations", "ate"), ("ation", "ate"), ("ements", "e"), ("ement", "e"), ("ings", ""), ("ing", ""), ("edly", ""), ("ed", ""), ("ies", "y"), ("ied", "y"), ("es", ""), ("s", ""), ("ly", ""), ("al", ""))
STEM = 3


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words and numbers of two characters or more, without stop words, lightly stemmed."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)), stem)


def token_set(text: Column) -> Column:
    """The distinct tokens() of a text; a word that is repeated is stemmed once."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)), stem))


def stem(word: Column) -> Column:
    n = F.length(word)
    out = F.when(word.rlike("^[0-9]+$"), word)
    for suffix, to in SUFFIXES:
        out = out.when(word.endswith(suffix) & (n >= STEM + len(suffix)), F.concat(F.substring(word, F.lit(1), n - len(suffix)), F.lit(to)))
    return out.otherwise(word)


def tokens_sql(t: str) -> str:
    """The same in DuckDB, for the registered queries' SQL; t stands for the text."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    cases = " ".join(f"WHEN w LIKE '%{s}' AND length(w) >= {STEM + len(s)} THEN left(w, length(w) - {len(s)}) || '{to}'" for s, to in SUFFIXES)
    stemmed = f"CASE WHEN regexp_full_match(w, '[0-9]+') THEN w {cases} ELSE w END"
    return f"list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({stop})), lambda w: {stemmed})"


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def coverage(inner: Column, outer: Column) -> Column:
    """The share of the distinct words of inner that outer has; 0 for none."""
    return ratio(F.size(F.array_intersect(inner, outer)), F.size(F.array_distinct(inner)))


#: Fixed values: (pattern, replacement) in order, from a query to the plain rule that it asks for, and the frame around it.
PLAIN = ((r"(?i)\bWS-", ""), (r"(?i)\bIF\b", ""), (r"(?i)\bMOVE\s+['\"][^'\"]+['\"]\s+TO\b", ""), (r"(?i)\bPERFORM\b", "execute"), (r"(?i)\bCIC\b", "credit information company"), (r"[-_]+", " "), (r"\s+", " "))
FRAME = "The implemented regulatory rule requires the system to {}."


def described(text: Column) -> Column:
    """What a query's answer would say, without a model."""
    for pattern, to in PLAIN:
        text = F.regexp_replace(text, pattern, to)
    before, after = FRAME.split("{}")
    return F.concat(F.lit(before), F.lower(F.trim(text, F.lit(" ."))), F.lit(after))


def described_sql(t: str) -> str:
    for pattern, to in PLAIN:
        t = "regexp_replace({}, '{}', '{}', 'g')".format(t, pattern.replace("'", "''"), to)
    before, after = FRAME.split("{}")
    return f"'{before}' || lower(trim({t}, ' .')) || '{after}'"
