"""Token ids on disk under a canonical length-limited Huffman code.

The format is two Parquet tables in one folder. `codes` holds the code length of each id that occurs; with
canonical codes that is the whole code. `blocks` holds runs of consecutive documents: which ones, how many
ids each, the packed bits, and the bit offset of every 128th id. A block is decoded without any other, and
within it decoding can begin at any checkpoint. Blocks are numbered by shard (a range of document ids) and
by the ids that stand before them in it, so a document's place in the whole stream follows from the shards' totals.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.huffman import canonical, code_lengths, decode, encode
from loomgraph.llm.words import Words, slices, words_of
from loomgraph.llm.worker import kept, tidy
from loomgraph.storage import drop, stored

BLOCK_IDS = 1 << 16
#: Distinct words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Fixed: letters of words that are one piece each, and marks that end words.
_PLAIN = re.compile("[a-zA-Zà-öø-ÿ]+")
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,!?%&$*#:;")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
BLOCKS = "shard int, first long, doc_ids array<long>, doc_counts array<int>, n_ids long, checkpoints array<int>, payload binary"


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words;
    nor does it join a letter or digit with punctuation. Known words are looked up by two hashes.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[ends] = True
        self.forget()

    def forget(self) -> None:
        self.h, self.g = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def encoded(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Words of plain letters have one last piece each, so many are encoded as one text."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _PLAIN.fullmatch(w)] if self.ends_word.any() else []
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in part]), add_special_tokens=False).ids, np.uint16)
            cut = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                for i, x in zip(part, np.split(ids, cut[:-1]), strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint16)
        return out

    def learn(self, words: Words, at: np.ndarray, h: np.ndarray, g: np.ndarray) -> None:
        raw = words.buf.tobytes()
        pieces = self.encoded([raw[s:e].decode("utf-8", "replace") for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
        length = np.array([len(x) for x in pieces], np.int64)
        begin = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, *pieces])
        place = np.searchsorted(self.h, h)
        self.h, self.g = np.insert(self.h, place, h), np.insert(self.g, place, g)
        self.begin, self.length = np.insert(self.begin, place, begin), np.insert(self.length, place, length)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of known hashes, -1 for others."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. Lower-casing is the tokenizer's first step too, but it would
        spell out special tokens in capitals; texts with their brackets keep their case and their words whole."""
        special = bool(((buf[:-1] == 60) & (buf[1:] == 124)).any())
        words = words_of(buf, off) if special else without_marks(words_of(buf, off))
        h, g = words.hashes(not special), (words.hashes(not special, 1) >> np.uint64(32)).astype(np.uint32)
        unique, first, each = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.find(unique) < 0)
        if len(self.h) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(unique))
        if len(new):
            self.learn(words, first[new], unique[new], g[first[new]])
        place = self.find(unique)[each]
        length = self.length[place]
        wrong = np.flatnonzero(self.g[place] != g)  # another word of the same hash
        end = np.cumsum(length)
        ids = self.ids[np.repeat(self.begin[place] - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)]
        if len(wrong):
            raw, parts = buf.tobytes(), np.split(ids, end[:-1])
            for i in wrong:
                parts[i] = self.encoded([raw[words.start[i] : words.end[i]].decode("utf-8", "replace")])[0]
                length[i] = len(parts[i])
            ids, end = np.concatenate(parts), np.cumsum(length)
        total = np.concatenate([[0], end])
        return ids, np.diff(total[words.doc_first])


def without_marks(words: Words) -> Words:
    """Cut punctuation at a word's end off as a word of its own, where a letter or digit stands before it."""
    buf = words.buf
    if not len(words.start):
        return words
    at = np.arange(len(buf))
    solid = np.maximum.accumulate(np.where(_MARK[buf], -1, at))
    stem = solid[words.end - 1] + 1
    last, before = buf[stem - 1], buf[np.maximum(stem - 2, 0)]
    letter = _ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    cut = np.flatnonzero((stem > words.start) & (stem < words.end) & letter)
    end = words.end.copy()
    end[cut] = stem[cut]
    extra = np.zeros(len(end) + 1, np.int64)
    extra[cut + 1] = 1
    return Words(buf, np.insert(words.start, cut + 1, stem[cut]), np.insert(end, cut + 1, words.end[cut]), words.doc_first + np.cumsum(extra)[words.doc_first])


def _tokenize(vocabulary, end_id: int):
    def run(batches):
        encoder, shard, first = kept("encoder", lambda: WordEncoder(vocabulary.value)), TaskContext.get().partitionId(), 0
        for b in batches:
            text = b.column("text").cast(pa.large_string()).fill_null("")
            for row, to, raw, off in slices(text, 2 << 20):
                ids, n = encoder.texts(raw, off)
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id).astype("<u2")
                n = n + 1
                off = np.concatenate([[0], np.cumsum(n)])
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((off * 2).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), pa.array(first + off[:-1]), b.column("id").slice(row, to - row), packed.cast(pa.binary())], ["shard", "first", "id", "ids"])
                first += int(off[-1])

    return run


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and its offsets in ids."""
    col = col.cast(pa.large_binary())
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]].view("<u2"), (off - off[0]) // 2


def _count(batches):
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        if b.num_rows:
            total += np.bincount(_flat(b.column("ids"))[0], minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])


def _encode(lengths):
    def blocks(code, shard, first, doc_ids, counts, ids):
        payload, at = encode(code, ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([len(ids)], pa.int64()), pa.array([at.view(np.int32)], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
            ["shard", "first", "doc_ids", "doc_counts", "n_ids", "checkpoints", "payload"],
        )

    def run(batches):
        code = canonical(lengths.value)
        for b in batches:
            if not b.num_rows:
                continue
            ids, off = _flat(b.column("ids"))
            shard, first, doc = b.column("shard").to_numpy(), b.column("first").to_numpy(), b.column("id")
            # a block ends before the row that passes BLOCK_IDS, and where rows aren't neighbours in a shard
            gap = np.concatenate([[True], (shard[1:] != shard[:-1]) | (first[1:] != first[:-1] + np.diff(off)[:-1])])
            row = 0
            while row < b.num_rows:
                to = max(row + 1, int(np.searchsorted(off, off[row] + BLOCK_IDS, "right")) - 1)
                cut = np.flatnonzero(gap[row + 1 : to])
                to = row + 1 + int(cut[0]) if len(cut) else to
                yield blocks(code, int(shard[row]), int(first[row]), doc.slice(row, to - row).to_pylist(), np.diff(off[row : to + 1]).astype(np.int32), ids[off[row] : off[to]])
                row = to

    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each row's text, append end_id, and write the format above into folder, in ascending id order.

    vocabulary is the JSON of a `tokenizers` file with at most 2**16 ids. A null text is empty. Rows of one id follow one
    another in an order fixed by their texts, and may lie in several shards; null ids come first. An empty table writes no block. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shards = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id()).repartitionByRange(shards, "id", "h", "n").sortWithinPartitions("id", "h", "n").select("id", "text")
    tokens = stored(ordered.mapInArrow(tidy(_tokenize(spark.sparkContext.broadcast(vocabulary), end_id)), "shard int, first long, id long, ids binary"), "tokens")
    counts = np.zeros(1 << 16, np.int64)
    for r in tokens.mapInArrow(tidy(_count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most 2**16 rows
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, length int").coalesce(1).write.parquet(f"{folder}/codes")
    blocks = tokens.mapInArrow(tidy(_encode(spark.sparkContext.broadcast(lengths))), BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    drop(tokens)


def _decode(lengths):
    def run(batches):
        code = canonical(lengths.value)
        for b in batches:
            for row in range(0, b.num_rows, 16):
                part = b.slice(row, 16)
                payload = part.column("payload").to_pylist()
                checkpoints = [np.array(x, np.int32).view(np.uint32) for x in part.column("checkpoints").to_pylist()]
                total = part.column("n_ids").to_pylist()
                for i, ids in enumerate(decode(code, payload, checkpoints, total)):
                    counts = np.array(part.column("doc_counts")[i].as_py(), np.int64)
                    off = np.concatenate([[0], np.cumsum(counts)])
                    first = part.column("first")[i].as_py()
                    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((off * 4).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_ids")[i].values, part.column("shard").take(pa.array(np.full(len(counts), i))), pa.array(first + off[:-1]), pa.array(counts), packed.cast(pa.binary())],
                        ["doc_id", "shard", "first", "n_tokens", "ids"],
                    )

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, first (ids before it in the shard), n_tokens, ids (little-endian unsigned 32-bit)."""
    lengths = np.zeros(1 << 16, np.uint8)
    for r in spark.read.schema("id int, length int").parquet(f"{folder}/codes").collect():  # at most 2**16 rows
        lengths[r.id] = r.length
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return blocks.mapInArrow(tidy(_decode(spark.sparkContext.broadcast(lengths))), "doc_id long, shard int, first long, n_tokens long, ids binary")


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """shard, base: the ids of all shards before it. One row for each shard, from the blocks' totals."""
    total = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    rows = read_tokens(spark, folder).select("doc_id", "shard", "first", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    joined = rows.join(shard_starts(spark, folder), "shard")
    return joined.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
