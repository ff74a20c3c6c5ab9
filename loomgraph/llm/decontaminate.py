"""Benchmark decontamination by SimHash of item-sized windows.

An item and a window of a document with as many words are compared by their five-word shingles, weighted by
rarity in the benchmark: similarity is the weight they share over the weight of either. A SimHash of 64 bits
sums each shingle's signs by weight. Items are indexed by five blocks of their fingerprints' bits: of two
fingerprints within 19 bits, some block differs in at most three, so looking up each block with up to three
bits flipped finds every item within the radius. What is found is decided by exact similarity.

A window that reaches the threshold holds most of the item's weight, hence one of the item's rarest
shingles, those that make up a little more than the weight it may lack. Windows without any are not looked at:
that loses no pair, and keeps fingerprints to the neighbourhoods of such shingles. An item of fewer than five words is one shingle:
a window of as many words is it or not, and is looked up as such.

The benchmark is cut into blocks of items of bounded size, each broadcast on its own.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import U, mix, signed, slices, words_of
from loomgraph.llm.worker import kept, tidy
from loomgraph.storage import stored

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 19
FLIPS = 3
#: A similarity of just 0.8 counts whatever the order of its sums.
ROUNDING = 1e-9
#: First bit and width of the blocks; RADIUS < len(BLOCKS) * (FLIPS + 1).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Words of the items that are broadcast at once.
ITEM_WORDS = 2_000_000
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col.cast(pa.large_string()).fill_null(""))


def _shingled(text: pa.Array):
    """For runs of rows: first row, words of each row (offsets), hash of the shingle at each word (words that
    begin none have 0), and the words' own hashes."""
    for row, to, buf, off in slices(_lower(text)):
        words = words_of(buf, off, _SEPARATOR)
        h = words.hashes(lower=True)
        first, gram = words.grams(h, SHINGLE)
        at = np.zeros(len(h), np.uint64)
        at[first] = gram
        yield row, to, words.doc_first, at, h


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words as one shingle, for n below SHINGLE."""
    out = np.full(max(len(h) - n + 1, 0), n + 977, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * U(31) + h[k : k + len(out)])
    return out


def _items(batches):
    """Distinct shingles of each item; an item of few words is one shingle."""
    for b in batches:
        for row, to, doc_first, at, h in _shingled(b.column("text")):
            n, sets = np.diff(doc_first), []
            for x, y in zip(doc_first[:-1], doc_first[1:], strict=True):
                grams = np.unique(at[x : max(x, y - SHINGLE + 1)]) if y - x >= SHINGLE else _runs(h[x:y], y - x) if y > x else np.zeros(0, np.uint64)
                sets.append(signed(grams))
            yield pa.RecordBatch.from_arrays([b.column("item").slice(row, to - row), pa.array(n, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["item", "n_words", "shingles"])


def signs(shingles: np.ndarray) -> np.ndarray:
    """64 signs of each shingle."""
    bits = (mix(shingles + U(0x5851F42D4C957F2D))[:, None] >> np.arange(64, dtype=np.uint64)) & U(1)
    return bits.astype(np.float64) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


class ItemIndex:
    """Fingerprints, weights and rare shingles of one block of items."""

    def __init__(self, items: list, heaviest: float):
        """items: (item, n_words, [(shingle, weight), ...]); heaviest: the weight of a shingle of no item."""
        self.heaviest, self.ids = heaviest, [i[0] for i in items]
        self.n_words = np.array([i[1] for i in items], np.int64)
        self.sets = [dict(i[2]) for i in items]
        self.total = np.array([sum(s.values()) for s in self.sets])
        weight: dict[int, float] = {}
        seeds: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            weight.update(s)
            so_far, order = 0.0, sorted(s.items(), key=lambda x: (-x[1], x[0]))
            for shingle, w in order:
                if so_far > (1 - SIMILAR) * self.total[i] * (1 + 1e-9):
                    break
                seeds.setdefault(shingle, []).append(i)
                so_far += w
        #: Items of few words by their number of words and their one shingle.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, n in enumerate(self.n_words.tolist()):
            if n < SHINGLE:
                self.short.setdefault(n, {}).setdefault(next(iter(self.sets[i])), []).append(i)
        self.shingles = np.array(sorted(weight), np.uint64)
        self.weights = np.array([weight[int(s)] for s in self.shingles])
        self.seed = np.array(sorted(seeds), np.uint64)
        self.of_seed = [seeds[int(s)] for s in self.seed]
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.seed >> U(44)).astype(np.int64)] = True
        self.prints = np.array([packed((signs(np.array(list(s), np.uint64)) * np.array(list(s.values()))[:, None]).sum(0, keepdims=True))[0] for s in self.sets], np.uint64)
        self.tables = []
        for at, width in BLOCKS:
            value = (self.prints >> U(at)) & U((1 << width) - 1)
            table: dict[int, list[int]] = {}
            for i, v in enumerate(value.tolist()):
                table.setdefault(v, []).append(i)
            met = np.zeros(1 << width, bool)
            met[list(table)] = True
            flips = np.array([sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(width), n)], np.int64)
            self.tables.append((at, width, met, table, flips))

    def seeds_at(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose shingle is a seed, and its number."""
        at = np.flatnonzero(self.gate[(shingles >> U(44)).astype(np.int64)])
        if not len(at) or not len(self.seed):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = np.minimum(np.searchsorted(self.seed, shingles[at]), len(self.seed) - 1)
        ok = self.seed[n] == shingles[at]
        return at[ok], n[ok]

    def weight_of(self, shingles: np.ndarray) -> np.ndarray:
        n = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[n] == shingles, self.weights[n], self.heaviest)

    def near(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(fingerprint's number, item, distance) of all within RADIUS."""
        found = set()
        for at, width, met, table, flips in self.tables:
            tried = ((prints >> U(at)) & U((1 << width) - 1)).astype(np.int64)[:, None] ^ flips
            for x, y in zip(*np.nonzero(met[tried]), strict=True):
                found.update((int(x), i) for i in table[int(tried[x, y])])
        out = []
        for x, i in sorted(found):
            d = int(np.bitwise_count(prints[x] ^ self.prints[i]))
            if d <= RADIUS:
                out.append((x, i, d))
        return out

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        have = np.unique(shingles)
        s = self.sets[item]
        shared = sum(s.get(x, 0.0) for x in have.tolist())
        return shared / (float(self.weight_of(have).sum()) + self.total[item] - shared)

    def leaks(self, shingles: np.ndarray, n_words: int) -> list[tuple[int, int, float, int]]:
        """(item, first word, similarity, distance): the best window of each item of SHINGLE words or more that a text of as many holds.

        shingles: those at each word of the text."""
        at, seed = self.seeds_at(shingles)
        spans: dict[int, list[int]] = {}
        for p, s in zip(at.tolist(), seed.tolist(), strict=True):
            for i in self.of_seed[s]:
                spans.setdefault(i, []).append(p)
        by_size: dict[int, set[int]] = {}
        for i, places in spans.items():
            size = int(min(self.n_words[i], n_words))
            m = max(size - SHINGLE + 1, 1)
            starts = by_size.setdefault(size, set())
            for p in places:
                starts.update(range(max(0, p - m + 1), min(p, n_words - size) + 1))
        best: dict[int, tuple] = {}
        for size, starts in by_size.items():
            m = max(size - SHINGLE + 1, 1)
            first = np.array(sorted(starts), np.int64)
            # running sums over each stretch of neighbouring windows; repeats within a window count once
            for part in np.split(first, np.flatnonzero(np.diff(first) > m) + 1):
                lo, hi = int(part[0]), int(part[-1]) + m
                local = shingles[lo:hi]
                weighted = signs(local) * self.weight_of(local)[:, None]
                if len(np.unique(local)) == len(local):
                    c = np.concatenate([np.zeros((1, 64)), np.cumsum(weighted, 0)])
                    sums = c[part - lo + m] - c[part - lo]
                else:
                    sums = np.stack([weighted[x - lo + np.unique(shingles[x : x + m], return_index=True)[1]].sum(0) for x in part])
                for x, i, d in self.near(packed(sums)):
                    if min(self.n_words[i], n_words) != size:
                        continue
                    s = self.similarity(shingles[part[x] : part[x] + m], i)
                    if s >= SIMILAR - ROUNDING and (i not in best or (-s, part[x]) < (-best[i][1], best[i][0])):
                        best[i] = (int(part[x]), s, d)
        return [(i, *best[i]) for i in sorted(best)]


def _short_leaks(h: np.ndarray, doc_first: np.ndarray, index: ItemIndex):
    """(document, item, first word): where a text first holds each item of fewer than SHINGLE words, whatever its own length."""
    doc_of = np.repeat(np.arange(len(doc_first) - 1), np.diff(doc_first))
    for n, items in index.short.items():
        runs = _runs(h, n)
        at = np.flatnonzero(np.isin(runs, np.array(list(items), np.uint64)))
        at = at[doc_of[at] == doc_of[at + n - 1]]
        docs, shingles = doc_of[at], runs[at]
        _, first = np.unique(np.stack([docs.astype(np.uint64), shingles]), axis=1, return_index=True)
        for k in first.tolist():
            for i in items[int(shingles[k])]:
                yield int(docs[k]), i, int(at[k] - doc_first[docs[k]])


def text_leaks(text: pa.Array, index: ItemIndex):
    """(row, item, first word, similarity, distance)."""
    for row, _, doc_first, at, h in _shingled(text):
        for d, i, start in _short_leaks(h, doc_first, index):
            yield row + d, i, start, 1.0, 0
        hit, _ = index.seeds_at(at)
        for d in np.unique(np.searchsorted(doc_first, hit, "right") - 1).tolist():
            x, y = doc_first[d], doc_first[d + 1]
            if y - x >= SHINGLE:
                for found in index.leaks(at[x : y - SHINGLE + 1], int(y - x)):
                    yield row + d, *found


def item_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list:
    """A broadcast index for each block of items. Items without words are left out."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    items = stored(rows.mapInArrow(tidy(_items), "item long, n_words long, shingles array<long>").where("n_words > 0"), "items")
    n, total = items.agg(F.count("*"), F.sum("n_words")).first()
    each = items.select("item", "n_words", F.explode("shingles").alias("shingle"))
    weight = each.groupBy("shingle").agg((1 + F.log(F.lit(float(n or 1)) / F.count("*"))).alias("weight"))
    blocks = -(-(total or 0) // ITEM_WORDS)
    whole = each.join(weight, "shingle").groupBy("item", "n_words").agg(F.collect_list(F.struct("shingle", "weight")).alias("shingles"))
    whole = stored(whole.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))), "items")
    out = []
    for i in range(blocks):
        part = [(r.item, r.n_words, [(s.shingle & 0xFFFFFFFFFFFFFFFF, s.weight) for s in r.shingles]) for r in whole.where(F.col("block") == i).orderBy("item", "n_words").collect()]  # at most about ITEM_WORDS words
        if part:
            out.append(spark.sparkContext.broadcast((part, 1 + float(np.log(n)))))
    return out


def _index(shared, number: str) -> ItemIndex:
    """The index of a block of items, built once for each worker and stage."""
    return kept(("items", number), lambda: ItemIndex(*shared.value))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, start (word), n_words, similarity, distance: one row for each document and item it holds.

    Words are runs of letters and digits, lower-cased. An item matches a window of as many words whose weighted
    shingle similarity is at least 0.8 (a shorter document as a whole); of several windows the best is told, the
    first of equals. An item of fewer than five words is one shingle, so it matches wherever a text holds exactly its words one after the other; a text
    of so few words holds no longer item. Null and empty texts and items match nothing; rows of equal ids are told each. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"{id_col} {rows.schema['id'].dataType.simpleString()}, item_id long, start long, n_words long, similarity double, distance int"

    def run_with(shared, number):
        def run(batches):
            for b in batches:
                index = _index(shared, number)
                out = list(text_leaks(b.column("text"), index))
                if out:
                    row, item, start, similarity, distance = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(row, pa.int64())), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(start, pa.int64()), pa.array([int(index.n_words[i]) for i in item], pa.int64()), pa.array(similarity, pa.float64()), pa.array(distance, pa.int32())],
                        [id_col, "item_id", "start", "n_words", "similarity", "distance"],
                    )

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for shared in item_indexes(benchmark):
        number = uuid.uuid4().hex
        out = out.unionByName(rows.mapInArrow(tidy(run_with(shared, number)), schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; no shuffle."""

    def run_with(shared, number):
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for row, *_ in text_leaks(b.column(text_col), _index(shared, number)):
                    keep[row] = False
                yield b.filter(pa.array(keep))

        return run

    for shared in item_indexes(benchmark):
        number = uuid.uuid4().hex
        docs = docs.mapInArrow(tidy(run_with(shared, number)), docs.schema)
    return docs
