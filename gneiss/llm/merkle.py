"""Merkle manifests of a dataset: a digest of each row, a tree for each key, a tree over the keys, and a proof for each row.

Superblock reduction: rows are numbered within their key; bucket i holds the rows whose number divided by fanout^k is i. One
applyInPandas group collapses k levels of one bucket to its root, and the roots, fanout^k times fewer, are collapsed in the
same way until each key has one. The roots of the keys, in their order, are the leaves of a last tree. Each round is a
stored table of superblocks (a bucket's digests as one row), so no round is made twice and none is larger than the last.
Proofs go the other way: a superblock knows its members' lower proof, and gets the upper one by a join on its own number,
one row a superblock; where both are joined, its members come out with whole proofs. No proof is ever stored or shuffled
with its row, which would be some 30 digests a row.

A bucket holds at most fanout^k rows, whatever share of the rows its key has. A key's last run may be shorter than the
fanout, even a single node, which is digested again alone; a key of one row has no level, so its leaf is its root.

Nulls: a null value is `-` in the leaf; null keys are one key, before all others, and null orders come first. Ties: rows
equal in key and order follow each other by leaf; rows that are equal throughout have one leaf, at several places. An empty
table has no root and gives no rows. Long texts are digested by Spark, whole. Other columns aren't read, and none
is taken for one of the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import scratch
from gneiss.llm.numbering import bounded, numbered, tied

FANOUT = 2
#: Levels that one group collapses: it holds FANOUT ** LEVELS rows at most.
LEVELS = 10

_BLOCK = "key string, block long, of long, height int, nodes binary, claims binary, ids array<string>, root string"
_NODE = "key string, at long, node string, claim string, id string, lefts array<string>, rights array<string>, subroot string, root string"
_ROW = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(column: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row by the columns given, in lowercase hex."""
    return F.sha2(F.concat(*(encoded(c) for c in columns)), 256)


def height(n: int, fanout: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def levels_of(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The nodes, and the runs' digests of each level above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], at: int, fanout: int) -> Iterator[tuple[str, str]]:
    """By level, the digests left and right of the node in its run."""
    for nodes in tree[:-1]:
        run = at // fanout * fanout
        yield "".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])
        at //= fanout


def _hex(packed: bytes | None) -> list[str]:
    text = (packed or b"").hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def climb(nodes: DataFrame, fanout: int, levels: int, paths: list[str]) -> list[DataFrame]:
    """The superblocks, by round. nodes: key, at, of, node, claim, id."""
    width, rounds = fanout**levels, []

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        own, of = list(pdf["node"]), int(pdf["of"].iloc[0])
        up = min(levels, height(of, fanout))
        claims = b"".join(map(bytes.fromhex, pdf["claim"])) if pdf["claim"].notna().all() else None
        ids = [None if pd.isna(i) else i for i in pdf["id"]]
        root = levels_of(own, fanout, up)[-1][0]
        return pd.DataFrame([[pdf["key"].iloc[0], pdf["at"].iloc[0] // width, -(-of // fanout**up), up, bytes.fromhex("".join(own)), claims, ids, root]], columns=["key", "block", "of", "height", "nodes", "claims", "ids", "root"])

    while True:
        blocks = nodes.groupBy("key", F.expr(f"at div {width}L")).applyInPandas(collapse, _BLOCK)
        rounds.append(scratch(blocks, f"round{len(rounds)}", paths))
        nodes = rounds[-1].filter("of > 1").selectExpr("key", "block at", "of", "root node", "CAST(NULL AS STRING) claim", "CAST(NULL AS STRING) id")
        if nodes.isEmpty():
            return rounds


def descend(rounds: list[DataFrame], tops: DataFrame, fanout: int, between, last, schema: str) -> DataFrame:
    """The members of the first round by last, those of later rounds by between. tops: key, subroot, lefts, rights, root, one row a key."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        own = ["b.key", "b.block", "b.height", "b.nodes", "b.claims", "b.ids", "t.subroot", "t.lefts", "t.rights", "t.root"]
        blocks = rounds[k].drop("root")
        out = blocks.filter("of = 1").alias("b").join(tops.alias("t"), F.expr("b.key <=> t.key")).select(own)
        if above is not None:
            out = out.unionByName(blocks.filter("of > 1").alias("b").join(above.alias("t"), F.expr("b.key <=> t.key AND b.block = t.at")).select(own))
        above = out.mapInPandas(last if k == 0 else between, schema if k == 0 else _NODE)
    return above


def _members(fanout: int, levels: int):
    """Each member of a superblock, with its whole proof."""
    width = fanout**levels

    def run(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                rows = []
                for i, (node, claim, own, lefts, rights) in enumerate(_unfolded(b, fanout)):
                    rows.append((b.key, b.block * width + i, node, claim, own, lefts, rights, b.subroot, b.root))
                yield pd.DataFrame(rows, columns=["key", "at", "node", "claim", "id", "lefts", "rights", "subroot", "root"])

    return run


def _folded(fanout: int):
    """Each row of a superblock: the digest of its whole proof, and the root that its claimed leaf folds to."""

    def run(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                rows = []
                for node, claim, own, lefts, rights in _unfolded(b, fanout):
                    proof = digest("".join(x + y for x, y in zip(lefts, rights, strict=True)))
                    rows.append((own, node, b.subroot, b.root, proof, fold(claim, lefts, rights)))
                yield pd.DataFrame(rows, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return run


def _unfolded(b, fanout: int) -> Iterator[tuple]:
    tree, upper_left, upper_right = levels_of(_hex(b.nodes), fanout, b.height), list(b.lefts), list(b.rights)
    claims = _hex(b.claims) or tree[0]
    for i, node in enumerate(tree[0]):
        pairs = list(siblings(tree, i, fanout))
        yield node, claims[i], b.ids[i], [x for x, _ in pairs] + upper_left, [y for _, y in pairs] + upper_right


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and the digests beside its path make."""
    for left, right in zip(lefts, rights, strict=True):
        leaf = digest(left + leaf + right)
    return leaf


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """key and root of each key's tree."""
    out = rounds[0].filter("of = 1").select("key", "root")
    for r in rounds[1:]:
        out = out.unionByName(r.filter("of = 1").select("key", "root"))
    return out


def _numbered_nodes(rows: DataFrame, key: str, order: list[str], paths: list[str]) -> DataFrame:
    """rows: key, node, claim, id and order's columns."""
    stored = scratch(tied(rows), "rows", paths)
    return numbered(stored, key, order, paths).select("key", F.col("__at").alias("at"), F.col("__of").alias("of"), "node", "claim", "id")


def proved(docs: DataFrame, key: str, identity: str, columns: list[str], claimed: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS, paths: list[str] | None = None) -> DataFrame:
    """id (the identity), leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A row's leaf is made of columns; within its key, rows ascend by identity. claimed says what a row is later said to hold
    in some of the columns: folded_root is the root that this claim leads to, and verified whether it is the true one.
    The tables made on the way are added to paths; the result is read from them.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("a node needs two children at least, and a bucket one level")
    paths = [] if paths is None else paths
    named = {c: F.col(f"`{c}`") for c in columns}
    rows = docs.select(
        F.col(f"`{key}`").cast("string").alias("key"),
        F.col(f"`{identity}`").alias("order"),
        F.col(f"`{identity}`").cast("string").alias("id"),
        leaf(*named.values()).alias("node"),
        leaf(*(named | (claimed or {})).values()).alias("claim"),
    )
    rounds = climb(_numbered_nodes(rows, "key", ["order", "node"], paths), fanout, levels, paths)
    keys = _tops(rounds).select(F.lit("").alias("key"), F.concat(F.lit("+"), "key").alias("id"), F.col("root").alias("node"), F.lit(None).cast("string").alias("claim"))
    over = climb(_numbered_nodes(keys, "key", ["id"], paths), fanout, levels, paths)
    none = F.array().cast("array<string>")
    top = _tops(over).select("key", F.lit(None).cast("string").alias("subroot"), none.alias("lefts"), none.alias("rights"), "root")
    keyed = descend(over, top, fanout, _members(fanout, levels), _members(fanout, levels), _NODE)
    keyed = scratch(keyed.select(F.substring("id", 2, 1 << 30).alias("key"), F.col("node").alias("subroot"), "lefts", "rights", "root"), "keys", paths)
    out = descend(rounds, bounded(keyed, "key"), fanout, _members(fanout, levels), _folded(fanout), _ROW)
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumn("id", F.col("id").cast(docs.schema[identity].dataType))


def tampered(docs: DataFrame) -> DataFrame:
    """The rows of documents in a tree for each language under one root, verified after n_chars grew by 1 where 7 divides the crc32 of doc_id."""
    grown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars"))
    out = proved(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": grown})
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
