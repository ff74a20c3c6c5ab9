"""Substring dedup: remove words that repeat a run of words seen earlier in the corpus.

Pass 1 counts in a count-min sketch of saturating cells (met, met again), one for each partition, merged shard
by shard. What it counts for a window is its anchor: of the ANCHOR-word runs within it the first with the
least hash. Equal windows have equal anchors in different places, so an anchor's count, and its cells', is
never below a window's; neighbouring windows share anchors, which makes several times fewer of them. A window
whose anchor's cells were not all met twice occurs once.

Neighbouring windows with one anchor form a span. Pass 2 writes the spans that the sketch leaves, with a 96-bit
key of all their words, and groups them exactly: the windows of a span that occurs earlier do so too, and are repeats.
The earliest occurrence of a window never lies in such a span. So pass 3 writes single windows, and groups
them exactly, only from spans that are the first with their words (a Bloom filter of their places tells them, and
lets others through at worst). Starts of repeats are packed per document as runs, and pass 4 takes the words they
cover out of the texts.

The sketch has a fixed size. Where a corpus outgrows it, it lets single windows through, which costs shuffle
and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.sketch import Member, member_filter, merged, partition_planes, planes_schema
from loomgraph.llm.words import Words, column_words, range_hash, signed
from loomgraph.llm.worker import tidy
from loomgraph.storage import drop, stored

#: The sketch has four cells or more for each anchor in each row, as far as 2**LOG2_CELLS goes: at most 2 * 16 MB are broadcast.
LOG2_CELLS = 27
ROWS = 2
ANCHOR = 8
#: Bytes of a usual word with its space, to guess the number of windows from.
WORD_BYTES = 6


def anchors(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, place of its anchor, and the hash of the run at each word."""
    short = min(ANCHOR, window)
    first = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(words.doc_first[1:], words.counts()))
    at, gram = words.grams(h, short)
    run = np.full(len(h), ~np.uint64(0))
    run[at] = gram
    # least of each window's runs by upper bits, the first of equals: doubling, then two overlapping spans
    least = (run & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, want = 1, window - short + 1
    while span * 2 <= want:
        least[: len(h) - span] = np.minimum(least[: len(h) - span], least[span:])
        span *= 2
    place = np.minimum(least[first], least[np.minimum(first + want - span, len(h) - 1)]) if len(first) else np.zeros(0, np.uint64)
    return first, (place & np.uint64(0xFFFFFFFF)).astype(np.int64), run


def _anchor_keys(text: pa.Array, window: int):
    for _, _, words in column_words(text):
        _, place, run = anchors(words, words.hashes(), window)
        yield run[np.unique(place)]


def spans(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each run of neighbouring windows with one anchor: its first word, its number of windows, its anchor's hash."""
    first, place, run = anchors(words, h, window)
    cut = np.flatnonzero(np.diff(place, prepend=-1))  # anchors never step back, and lie in the window's own text
    return first[cut], np.diff(np.append(cut, len(place))), run[place[cut]]


def _keyed(words: Words, h: np.ndarray, first: np.ndarray, n: np.ndarray | int) -> list[pa.Array]:
    """Two hashes of n words each."""
    second = range_hash(words.hashes(which=1), first, first + n, 1) >> np.uint64(32)
    return [pa.array(signed(range_hash(h, first, first + n))), pa.array(second.astype(np.uint32).view(np.int32))]


def _repeated(window: int, sketch: Member):
    """The spans whose anchor may occur twice: two hashes, row, start and number of windows."""

    def run(batches):
        for b in batches:
            for row, _, words in column_words(b.column("text")):
                h = words.hashes()
                first, n, anchor = spans(words, h, window)
                some = np.flatnonzero(sketch.holds_unsigned(anchor))
                if not len(some):
                    continue
                first, n = first[some], n[some]
                doc = np.searchsorted(words.doc_first, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [*_keyed(words, h, first, n + window - 1), b.column("row").take(pa.array(row + doc)), pa.array((first - words.doc_first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "g", "row", "start", "n"]
                )

    return run


def place_name(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """As in SQL: shiftleft(row, 24) ^ start."""
    return (row.astype(np.uint64) << np.uint64(24)) ^ start.astype(np.uint64)


def _windows(window: int, sketch: Member, firsts: Member):
    """The windows of the spans that no earlier span equals: two hashes, row and start."""

    def run(batches):
        for b in batches:
            ids = b.column("row").to_numpy()
            for row, _, words in column_words(b.column("text")):
                h = words.hashes()
                first, n, anchor = spans(words, h, window)
                some = sketch.holds_unsigned(anchor)
                first, n = first[some], n[some]
                doc = np.searchsorted(words.doc_first, first, "right") - 1
                some = np.flatnonzero(firsts.holds_unsigned(place_name(ids[row + doc], first - words.doc_first[doc])))
                if not len(some):
                    continue
                n = n[some]
                each = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.repeat(doc[some], n)
                yield pa.RecordBatch.from_arrays([*_keyed(words, h, each, window), pa.array(ids[row + doc]), pa.array((each - words.doc_first[doc]).astype(np.int32))], ["h", "g", "row", "start"])

    return run


def packed_runs(starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Runs of starts, ascending by their first, as (first, count) pairs of runs that don't touch."""
    end = np.maximum.accumulate(starts + counts)
    begin = np.flatnonzero(np.concatenate([[True], starts[1:] > end[:-1]]))
    last = np.append(begin[1:], len(starts)) - 1
    return np.stack([starts[begin], end[last] - starts[begin]], 1).astype("<i4").tobytes()


def _pack(batches):
    """Rows sorted by row and start; a row's starts may be spread over batches."""
    at, runs = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed_runs(*np.concatenate(runs, 1))], pa.binary())], ["row", "runs"])

    for b in batches:
        row, start, n = (b.column(c).to_numpy() for c in ("row", "start", "n"))
        cut = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]]) if len(row) else [0]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            if row[x] != at:
                if at is not None:
                    yield out()
                at, runs = int(row[x]), []
            runs.append(np.stack([start[x:y], n[x:y]]).astype(np.int64))
    if at is not None:
        yield out()


def covered(n_words: int, runs: bytes | None, window: int) -> np.ndarray:
    """Which words lie in a window that begins at one of the packed starts."""
    step = np.zeros(n_words + 1, np.int64)
    if runs:
        first, count = np.frombuffer(runs, "<i4").reshape(-1, 2).astype(np.int64).T
        np.add.at(step, first, 1)
        np.add.at(step, np.minimum(first + count - 1 + window, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def _held(batch: pa.RecordBatch, touched: Member) -> np.ndarray:
    """Rows whose id the filter holds; null ids never."""
    ids = batch.column("row")
    return touched.holds(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)


def _touched(touched: Member):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_held(b, touched)))

    return run


def _remove(window: int, untouched: Member | None = None):
    """Take the covered words out; given a filter, of the rows that it doesn't hold, which have no runs."""

    def run(batches):
        for b in batches:
            if untouched is not None:
                b = b.filter(pa.array(~_held(b, untouched)))
            runs = [None] * b.num_rows if untouched is not None else b.column("runs").to_pylist()
            for row, to, words in column_words(b.column("text")):
                out = []
                for i in range(to - row):
                    x, y = words.doc_first[i], words.doc_first[i + 1]
                    gone = covered(y - x, runs[row + i], window)
                    kept = np.flatnonzero(~gone) + x
                    text = b" ".join([words.buf[s:e].tobytes() for s, e in zip(words.start[kept], words.end[kept], strict=True)])
                    out.append((int(y - x), int(gone.sum()), text.decode("utf-8", "replace")))
                n, removed, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("row").slice(row, to - row), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string())], ["row", "n_words", "n_removed", "kept"])

    return run


def _later(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with a key (h, g): the place of each key's first, and the rows that aren't it."""
    place = F.struct("row", "start")
    first = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = stored(first.select("h", "g", "first", (F.col("first") != F.col("last")).alias("several")), "firsts")
    return first, found.join(first.where("several").select("h", "g", "first"), ["h", "g"]).where(place != F.col("first")).select("row", "start", "n")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed and kept, the words that stay, joined by one space.

    A word goes if a window of `window` words that covers it has the same words as one that starts earlier:
    in a smaller id, or earlier in the same text. Words are runs of other than ASCII white space, unchanged.
    Texts shorter than a window, empty and null ones lose nothing; a null text has no words. Ids should be
    distinct: rows of one id would count as one text for the order. Rows with a null id neither lose words
    nor take any from others. Extra columns of docs are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    named = rows.where("row is not null")
    n_bytes = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_anchor = (min(window, max(window - ANCHOR, 0) + 1) + 1) / 2
    log2_cells = int(np.clip(int(4 * n_bytes / WORD_BYTES / per_anchor).bit_length(), 16, LOG2_CELLS))
    parts = named.select("text").mapInArrow(tidy(lambda batches: partition_planes(batches, lambda b: _anchor_keys(b.column("text"), window), ROWS, log2_cells)), planes_schema())
    sketch = Member(spark.sparkContext.broadcast(merged(parts, "twice", ROWS, log2_cells)), log2_cells)
    found = stored(named.mapInArrow(tidy(_repeated(window, sketch)), "h long, g int, row long, start int, n int"), "spans")
    first, whole = _later(found)
    # filters have four cells or more for each key, as far as 2**LOG2_CELLS goes
    bits = lambda n: int(np.clip(int(4 * n).bit_length(), 16, LOG2_CELLS))
    firsts = member_filter(first.select(F.expr("shiftleft(first.row, 24) ^ first.start").alias("place")), bits(first.count()), ROWS)
    single = stored(named.mapInArrow(tidy(_windows(window, sketch, firsts)), "h long, g int, row long, start int").withColumn("n", F.lit(1)), "windows")
    later = whole.unionByName(_later(single)[1])
    runs = stored(later.repartition("row").sortWithinPartitions("row", "start").mapInArrow(tidy(_pack), "row long, runs binary"), "runs")
    for used in (found, single, first):
        drop(used)
    # most texts repeat nothing and need no shuffle to meet their runs
    touched = member_filter(runs.select("row"), bits(runs.count()), ROWS)
    schema = "row long, n_words long, n_removed long, kept string"
    with_runs = rows.mapInArrow(tidy(_touched(touched)), "row long, text string").join(runs, "row", "left").select("row", "text", "runs")
    out = rows.mapInArrow(tidy(_remove(window, touched)), schema).unionByName(with_runs.mapInArrow(tidy(_remove(window)), schema))
    return out.withColumnRenamed("row", id_col)
