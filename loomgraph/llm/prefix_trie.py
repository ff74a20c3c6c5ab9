"""A trie of conversations: which begin with the same turns, and what sharing these turns saves.

Partition refinement. All conversations begin in one class, the root. A round splits each active class by its next turn;
a class is named by a 128-bit hash that its members come to alone, from the name of their class and their own turn, so that splitting
needs no lookup. A class with one member is retired: what follows in that conversation is a chain without branches, whose nodes come
straight from its length. So there are as many rounds as turns that two conversations share, not as the longest has. The classes are then folded
back from the deepest to the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.ranks import counted_join, ranked
from loomgraph.storage import Scratch

#: Fixed: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids that are joined into one piece of text before a node's ids are digested.
PIECE = 256
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _chained(a: Column | int, b: Column | int, *then: Column) -> tuple[Column, Column]:
    """Two hashes carried on by more values."""
    lit = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x
    return F.xxhash64(lit(a), *then), F.xxhash64(lit(b), *then)


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, depth from 1, t1, t2: hash of role and text, words: of the text) and convs (conv_id, n: how many turns).

    Turns ascend by turn, null first; those of one number by role, then text. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation. A conversation of any length is spread over ranges of its turns."""
    scratch = Scratch()
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    # hashing one string after the other, so that role and text can't run into each other
    t1, t2 = _chained(11, 12, F.col("role"), F.col("text"))
    keep = ["conv_id", t1.alias("t1"), t2.alias("t2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]
    placed = ranked(scratch, rows, ["conv_id"], ["turn", "role", "text"], keep)
    turns = scratch.stored(placed.select("conv_id", (F.col("rank") + 1).alias("depth"), "t1", "t2", "words", "n_rows"), "turns")
    return turns.drop("n_rows"), turns.where("depth = 1").select("conv_id", F.col("n_rows").alias("n"))


def with_shared_heads(numbered: tuple[DataFrame, DataFrame], every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same of conversations whose first h turns are those of conversation c - c % every (all if it has fewer, none if it is absent), and that go on
    with their own after the h-th, if any; h is crc32 of c in decimal, modulo most. They may come to have no turn."""
    turns, convs = numbered
    lengths = convs.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    each = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    each = Scratch().stored(each.join(lengths, "head", "left").withColumn("taken", F.least("h", F.coalesce("head_n", F.lit(0)))), "heads")
    first = turns.where(F.col("depth") < most).withColumnRenamed("conv_id", "head")
    heads = each.select("conv_id", "head", "taken").join(first, "head").where(F.col("depth") <= F.col("taken")).select("conv_id", "depth", "t1", "t2", "words")
    own = turns.join(each.select("conv_id", "h", "taken"), "conv_id").where(F.col("depth") > F.col("h"))
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "t1", "t2", "words")
    return heads.unionByName(own), each.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _digests(scratch: Scratch, ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of the ids of each class (a, b), ascending, joined by commas.

    Ids become pieces of PIECE ids in parallel; the pieces of a class then pass by one after the other, since a digest has one order, and none is kept."""
    placed = ranked(scratch, ends, ["a", "b"], ["conv_id"], ["a", "b", "conv_id"]).withColumn("piece", F.expr(f"rank div {PIECE}"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = placed.groupBy("a", "b", "piece").agg(text.alias("ids"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) == now:
                    state.update(b",")
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["a", "b", "ends_sha256"])

    return pieces.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "piece").select("a", "b", "ids").mapInArrow(run, "a long, b long, ends_sha256 string")


def _refined(scratch: Scratch, turns: DataFrame, convs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The classes of each depth until none has two members, and the ends (a, b, conv_id) of conversations in classes of more.

    Classes: a, b (name), pa, pb (the parent's), conv_id (least member), n_convs, words (of the turn), len (of a lone member)."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by depth, so that a round reads only its own turns
    turns = scratch.stored(turns.repartitionByRange(parts, "depth", "conv_id").sortWithinPartitions("depth"), "by_depth")
    none = F.lit(None).cast("long")
    members = convs.select("conv_id", "n", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.alias("pa"), none.alias("pb"), F.lit(0).cast("long").alias("words"))
    members, rounds, ends = scratch.stored(members, "members"), [], None
    while True:
        classes = members.groupBy("a", "b", "pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("n").alias("len"))
        classes = scratch.stored(classes.withColumn("depth", F.lit(len(rounds)).cast("long")), "classes")
        if not classes.head(1):
            return rounds, ends
        rounds.append(classes)
        depth = len(rounds)
        active = members.join(classes.where("n_convs = 1").select("conv_id"), "conv_id", "left_anti")
        ended = active.where(F.col("n") < depth).select("a", "b", "conv_id")
        ends = ended if ends is None else ends.unionByName(ended)
        a, b = _chained(F.col("a"), F.col("b"), F.col("t1"), F.col("t2"))
        split = active.where(F.col("n") >= depth).drop("pa", "pb", "words").join(turns.where(F.col("depth") == depth).drop("depth"), "conv_id")
        members = scratch.stored(split.select("conv_id", "n", a.alias("na"), b.alias("nb"), F.col("a").alias("pa"), F.col("b").alias("pb"), "words").withColumnsRenamed({"na": "a", "nb": "b"}), "members")


def prefix_trie(numbered: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The nodes of the trie of conversations (turns and convs, as numbered_turns gives them), all long but the last:

    conv_id: the least member; depth; parent_conv_id: the parent's conv_id, null at the root; n_convs: members; n_children; n_leaves: childless
    nodes in its subtree, itself included; saved_tokens: over the subtree, a node's members less one times the words of its last turn;
    ends_sha256: lowercase hex digest of the decimal ids of the members that end here, ascending, joined by commas (none: of the empty text).

    A class may hold a third of all conversations, or all: classes are counted by partial aggregates, no task takes a class, and parents' ids come
    by counted_join(). Conversations without turns end at the root. Without conversations there is no node. Extra columns of the conversations are not read."""
    scratch = Scratch()
    turns, convs = numbered
    rounds, ends = _refined(scratch, turns, convs)
    empty = F.sha2(F.lit(""), 256)
    if not rounds:
        return convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in NODE[1:-1]], empty.alias(NODE[-1])).where("false")
    folded, below = [], None
    for classes in reversed(rounds):
        lone = F.col("n_convs") == 1
        own = (F.col("n_convs") - 1) * F.col("words")
        if below is None:
            kids = classes.select("a", "b", *[F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]).where("false")
        else:
            kids = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        told = classes.join(kids, ["a", "b"], "left").select(
            "a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "len",
            F.when(lone, (F.col("len") > F.col("depth")).cast("long")).otherwise(F.coalesce("kids", F.lit(0))).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
        below = scratch.stored(told, "folded")
        folded.insert(0, below)
    nodes = folded[0]
    for f in folded[1:]:
        nodes = nodes.unionByName(f)
    digests = scratch.stored(_digests(scratch, scratch.stored(ends, "ends")), "digests")
    ids = F.col("conv_id").cast("string").cast("binary")
    end = F.when((F.col("n_convs") == 1) & (F.col("len") == F.col("depth")), F.sha2(ids, 256)).otherwise(F.coalesce("ends_sha256", empty))
    nodes = nodes.join(digests, ["a", "b"], "left").withColumn("ends_sha256", end)
    nodes = scratch.stored(nodes, "told")
    parents = nodes.where("n_convs > 1").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    inner = counted_join(nodes.where("depth > 0"), parents, ["pa", "pb"], "n_children")
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    tails = nodes.where("n_convs = 1 and len > depth").select("conv_id", "len", F.explode(F.sequence(F.col("depth") + 1, F.col("len"))).alias("depth"))
    last = F.col("depth") == F.col("len")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = tails.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        none.alias("saved_tokens"), F.when(last, F.sha2(ids, 256)).otherwise(empty).alias("ends_sha256"))
    return inner.select(*NODE).unionByName(top.select(*NODE)).unionByName(tails)
