"""A Merkle manifest of a dataset: a hash tree over each group's rows, a tree over the groups, and a proof for each row.

Superblock reduction: the nodes of a tree stand in buckets of fanout**levels consecutive ones. One task call collapses
`levels` levels of a bucket into its root; the roots are the nodes of the next round, a few hundred times fewer, until each tree is one
node. Proofs come back the same way, from the top: a bucket's nodes get their siblings within it, followed by
the proof of the bucket's root. No call ever sees more than one bucket, whatever the size of a group.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomgraph.llm.ranks import ranked
from loomgraph.storage import Scratch

#: Children of a node, and levels that one call collapses: buckets of 512.
FANOUT, LEVELS = 8, 3
_DIGEST = 64


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and the value; null as -."""

    def told(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(told, columns)), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth_of(n: int, fanout: int = FANOUT) -> int:
    """Levels between n nodes and one."""
    d = 0
    while n > 1:
        n, d = -(-n // fanout), d + 1
    return d


def parents(nodes: list[str], fanout: int = FANOUT) -> list[str]:
    return [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def collapsed(nodes: list[str], levels: int, fanout: int = FANOUT) -> tuple[str, list[str]]:
    """The root of a bucket after so many levels, and for each of its nodes the siblings passed on the way, in order."""
    proofs, at = [""] * len(nodes), list(range(len(nodes)))
    for _ in range(levels):
        beside = ["".join(nodes[i - i % fanout : i]) + "".join(nodes[i + 1 : i - i % fanout + fanout]) for i in range(len(nodes))]
        for k, i in enumerate(at):
            proofs[k] += beside[i]
        nodes, at = parents(nodes, fanout), [i // fanout for i in at]
    return nodes[0], proofs


def folded(node: str, at: int, n: int, proof: str, start: int = 0, fanout: int = FANOUT) -> tuple[str, int]:
    """The root that the at-th of n nodes leads to with the siblings that proof holds from start on, and where they end."""
    while n > 1:
        first = at - at % fanout
        before, run = (at - first) * _DIGEST, min(fanout, n - first)
        beside = proof[start : start + (run - 1) * _DIGEST]
        node, start = digest(beside[:before] + node + beside[before:]), start + len(beside)
        at, n = at // fanout, -(-n // fanout)
    return node, start


def _levels(n: int, levels: int, fanout: int) -> int:
    """Levels that a round collapses in a tree of n nodes: to the end where one bucket holds them all."""
    return depth_of(n, fanout) if n <= fanout**levels else levels


def _reduced(scratch: Scratch, nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """nodes (tree, at, digest, n) and what each round makes of them; in the last each tree is one node."""
    size, rounds = fanout**levels, [nodes]

    def root(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        top, _ = collapsed(rows.sort_values("at")["digest"].tolist(), _levels(n, levels, fanout), fanout)
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "digest": [top], "n": [-(-n // size)]})

    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        now = rounds[-1].select("tree", "at", "digest", "n")
        made = now.groupBy("tree", F.expr(f"at div {size}").alias("bucket")).applyInPandas(root, "tree string, at long, digest string, n long")
        rounds.append(scratch.stored(made, "nodes"))
    return rounds


def _proved(scratch: Scratch, rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The first round's nodes with their proofs, to their tree's root and on: above holds for each tree the proof of its root and more columns,
    which all of its nodes get."""
    size = fanout**levels
    more = [c for c in above.columns if c not in ("tree", "proof")]
    above = above.withColumn("at", F.lit(0).cast("long"))
    for k in range(len(rounds) - 2, -1, -1):
        nodes = rounds[k]
        schema = StructType([*nodes.schema.fields, *(above.schema[c] for c in more), StructField("proof", StringType())])

        def told(rows: pa.Table, upper: pa.Table) -> pa.Table:
            rows = rows.sort_by("at")
            _, proofs = collapsed(rows["digest"].to_pylist(), _levels(rows["n"][0].as_py(), levels, fanout), fanout)
            tail = upper["proof"][0].as_py()
            for c in more:
                rows = rows.append_column(c, pa.repeat(upper[c][0], len(rows)))
            return rows.append_column("proof", pa.array([p + tail for p in proofs]))

        bucket = F.expr(f"at div {size}").alias("bucket")
        above = nodes.groupBy("tree", bucket).cogroup(above.groupBy("tree", F.col("at").alias("bucket"))).applyInArrow(told, schema)
        if k:
            above = scratch.stored(above.select("tree", "at", "proof", *more), "proofs")
    if len(rounds) == 1:  # every tree is a lone node
        above = rounds[0].join(above.drop("at"), "tree")
    return above


def merkle_manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves with at and n (a leaf's place among those of its group, and how many they are), subroot, tree_at and n_trees (the same of the
    group among all), root and proof: the siblings on the way to root, level by level and from left to right, joined.

    Within a group leaves ascend by `order`, nulls first, then by leaf; rows equal in all of it stand in any order, which changes no
    hash. Groups ascend by bytes, null first. While several nodes remain, each run of fanout consecutive ones (the last may be
    shorter, also one) becomes the digest of their joined digests; a lone leaf or subroot stays as it is. The subroots' tree is built
    alike. An empty table gives an empty manifest. leaves must be the same on each reading (read from files, or stored); each of its
    columns comes back, so it should be narrow: digests, not texts. Names of result columns must not be among them."""
    taken = {"at", "n", "subroot", "tree_at", "n_trees", "root", "proof", "tree", "digest", "rank", "n_rows", "bucket"} & set(leaves.columns)
    if taken:
        raise ValueError(f"rename these columns: {sorted(taken)}")
    scratch = Scratch()
    # no null keys: null is the first of all names
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    placed = ranked(scratch, keyed, ["tree"], [*order, leaf], [*leaves.columns, "tree"])
    nodes = scratch.stored(placed.withColumnsRenamed({"rank": "at", "n_rows": "n"}).withColumn("digest", F.col(leaf)), "leaves")
    rounds = _reduced(scratch, nodes, fanout, levels)
    subroots = rounds[-1].select(F.lit("").alias("one"), F.col("tree").alias("name"), "digest")
    top = ranked(scratch, scratch.stored(subroots, "subroots"), ["one"], ["name"], ["one", "name", "digest"])
    top = scratch.stored(top.select(F.col("one").alias("tree"), "name", F.col("rank").alias("at"), "digest", F.col("n_rows").alias("n")), "top")
    top_rounds = _reduced(scratch, top, fanout, levels)
    root = top_rounds[-1].select("tree", F.lit("").alias("proof"), F.col("digest").alias("root"))
    proved = _proved(scratch, top_rounds, root, fanout, levels)
    above = scratch.stored(proved.select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), F.col("at").alias("tree_at"), F.col("n").alias("n_trees"), "root"), "above")
    found = _proved(scratch, rounds, above, fanout, levels)
    return found.select(*leaves.columns, "at", "n", "subroot", "tree_at", "n_trees", "root", "proof")


def folded_roots(manifest: DataFrame, leaf: str, fanout: int = FANOUT, out: str = "folded_root") -> DataFrame:
    """The manifest with the root that each row's proof leads to from what stands in `leaf`, which is the true root only if it is the true leaf."""

    def run(batches):
        for b in batches:
            roots = []
            for node, at, n, tree_at, n_trees, proof in zip(*(b.column(c).to_pylist() for c in (leaf, "at", "n", "tree_at", "n_trees", "proof")), strict=True):
                node, used = folded(node, at, n, proof, 0, fanout)
                roots.append(folded(node, tree_at, n_trees, proof, used, fanout)[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], [*b.schema.names, out])

    return manifest.mapInArrow(run, StructType([*manifest.schema.fields, StructField(out, StringType())]))
