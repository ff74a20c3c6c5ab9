"""Line dedup: lines that many documents share leave all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.ranks import counted_join
from loomgraph.storage import Scratch

#: Fixed: what is stripped from the ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that are broadcast at most, of 16 bytes each; more are joined by shuffles.
BROADCAST_KEYS = 1 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; lower() does so alone where all are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(BLANK)))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def shared_lines(docs: DataFrame, text: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """h1, h2, n: hashes (128 bits) of the keys of at least least_chars code points that at least least_docs rows hold, and how many hold them.

    A row's own repeats are taken out before rows are counted, and counts are combined before the shuffle."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(_lines(text), line_key))).alias("key"))
    if least_chars > 0:
        keys = keys.where(F.char_length("key") >= least_chars)
    return keys.select(*_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)


def line_dedup(docs: DataFrame, key_col: str = "doc_id", text: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """key_col, n_lines, n_dropped (long), kept (the lines that stay, joined by newlines): a row for each row of docs.

    Lines end at a newline alone. A line's key is the line without blanks at its ends, A-Z lowered. A key of at least
    least_chars code points in at least least_docs documents loses all its lines, also those that differ in case or blanks.

    Null and empty texts are one empty line, whose key is too short to be dropped (unless least_chars is 0). Each row is a
    document: rows with null, equal or repeated ids are counted one by one and come back one by one, repeats of a line within
    a row count once. A document that loses every line comes back with an empty text. An empty table gives an empty one; other columns are
    not read. docs must be the same on each reading (read from files, or stored)."""
    scratch = Scratch()
    shared = scratch.stored(shared_lines(docs, text, least_docs, least_chars), "lines")
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key_col).alias("_id"), _lines(text).alias("_lines"))
    lines = docs.select("_row", "_id", F.posexplode("_lines").alias("_pos", "_line")).select("*", *_hashes(line_key(F.col("_line"))))
    if shared.count() <= BROADCAST_KEYS:
        gone = F.broadcast(shared.select("h1", "h2", F.lit(True).alias("_gone")))
        marked = lines.join(gone, ["h1", "h2"], "left").select("_row", "_id", "_pos", "_line", "_gone")
    else:
        lines = scratch.stored(lines, "all_lines")  # a row keeps its number
        gone = counted_join(lines.select("_row", "_pos", "h1", "h2"), shared, ["h1", "h2"], "n").select("_row", "_pos", F.lit(True).alias("_gone"))
        marked = lines.drop("h1", "h2").join(gone, ["_row", "_pos"], "left")
    stays = F.when(F.col("_gone").isNull(), F.struct("_pos", "_line"))  # collect_list leaves nulls out
    found = marked.groupBy("_row").agg(F.first("_id").alias(key_col), F.count("*").alias("n_lines"), F.count("_gone").alias("n_dropped"), F.collect_list(stays).alias("_kept"))
    return found.select(key_col, "n_lines", "n_dropped", F.array_join(F.transform(F.array_sort("_kept"), lambda x: x["_line"]), "\n").alias("kept"))
