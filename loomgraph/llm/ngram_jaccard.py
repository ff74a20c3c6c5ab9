"""N-gram Jaccard join by PartEnum signatures.

A document is its set of distinct word shingles. Sizes fall into bands whose upper end is the lower end over
the threshold, so two similar sets lie in one band or in neighbouring ones and meet in the *instance* of the
larger set's band. For an instance the threshold bounds the number k of elements that only one of two
similar sets has. The feature domain is hashed into n1 parts, each of those into n2; a similar pair differs
in at most k2 elements in some part, and so agrees on a subset of n2 - k2 of its pieces. One signature for
each part and subset therefore never misses a pair. n1 is floor(k / (k2 + 1)) + 1 plus a spare for parts
that may hold nothing; signatures of nothing are written only by sets that have more such parts than spares.

Documents with equal sets are one node, and one of them writes signatures. Signatures that the same sets hold are one
bucket: near copies agree on most of theirs, and each would bring the same pairs. Candidate pairs are pruned by a lower bound on the difference
(parities of hashed element counts) and then decided by exact intersection. Pairs inside one known component
need no test; that keeps groups of many near copies from being compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.sketch import Member, member_filter
from loomgraph.llm.words import U, column_words, mix, signed
from loomgraph.llm.worker import tidy
from loomgraph.operators.components import connected_components
from loomgraph.storage import Scratch, stored

PARITY_BITS = (128, 1 << 16)
#: A signature shared by more sets than this is compared in blocks of so many.
BLOCK = 2048
#: So many least signatures of a set tell whether it met another before.
LOW = 64
#: Signatures whose names a task packs at once, and elements of all sets for each shard of names.
FLUSH, SHARD_ELEMENTS = 1 << 18, 1 << 18
_ELEMENT = U((1 << 52) - 1)


@lru_cache(None)
def instances(percent: int) -> dict[str, np.ndarray]:
    """By band: least size, and n1, n2, k2 and spare of the instance of its name."""
    low, out = 1, {"low": [], "n1": [], "k2": [], "spare": []}
    before = 1
    while low < 1 << 40:
        high = low * 100 // percent
        k = 2 * high * (100 - percent) // (100 + percent)
        k2 = 1 if 1 <= k <= 15 else 0
        n1 = k // (k2 + 1) + 1
        held = before / n1
        weak = n1 * (np.exp(-held) if not k2 else 3 * np.exp(-held * 2 / 3))
        spare = 0 if k == 0 else int(np.ceil(weak + 4 * np.sqrt(weak)))
        for name, v in (("low", low), ("n1", n1 + spare), ("k2", k2), ("spare", spare)):
            out[name].append(v)
        before, low = low, high + 1
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _sets(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end row, elements (52-bit hashes, ascending by row), offsets."""
    for row, to, words in column_words(text):
        h = words.hashes(lower=True)
        count = words.counts()
        first, gram = words.grams(h, k)
        few = np.flatnonzero((count > 0) & (count < k))
        doc = np.repeat(np.arange(words.n_docs), np.maximum(count - k + 1, 0))
        if len(few):
            whole = np.array([words_hash(h[a:b]) for a, b in zip(words.doc_first[few], words.doc_first[few + 1], strict=True)], np.uint64)
            doc, gram = np.concatenate([doc, few]), np.concatenate([gram, whole])
        for part in range(0, words.n_docs, 4096):  # 12 bits hold the row within a part
            keep = (doc >= part) & (doc < part + 4096)
            key = np.unique(((doc[keep] - part).astype(np.uint64) << U(52)) | (gram[keep] & _ELEMENT))
            n = min(4096, words.n_docs - part)
            off = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << U(52))
            if n == 4096:
                off[-1] = len(key)
            yield row + part, row + part + n, key & _ELEMENT, off


def words_hash(h: np.ndarray) -> np.uint64:
    out = U(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = mix(np.array([out * U(31) + x], np.uint64))[0]
    return out


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _keys(elements: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        return mix(_sums(mix(elements * U(3) + U(1)), off) + np.diff(off).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def parities(elements: np.ndarray) -> bytes:
    """Whether each hash cell holds an odd number of the elements."""
    bits = 1 << int(np.clip(len(elements) - 1, PARITY_BITS[0] - 1, PARITY_BITS[1] - 1)).bit_length()
    cell = (mix(elements + U(7)) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(parity: bytes, n_bytes: int) -> np.ndarray:
    """The parities in fewer cells: halves laid over each other."""
    x = np.frombuffer(parity, np.uint64)
    while len(x) * 8 > n_bytes:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def most_different(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference that the threshold allows to sets of these sizes."""
    total = na + nb
    return total - 2 * -(-percent * total // (100 + percent))


def signatures(elements: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature, for each signature of each set."""
    table = instances(percent)
    sizes = np.diff(off)
    band = np.searchsorted(table["low"], sizes, "right") - 1
    rows, sigs = [], []
    doc = np.repeat(np.arange(len(sizes)), sizes)
    value, place = mix(elements * U(5) + U(11)), mix(elements + U(0x51ED270B))
    with np.errstate(over="ignore"):
        for ahead in (0, 1):
            inst = np.where(sizes > 0, band + ahead, 0)
            for k2, n2 in ((0, 1), (1, 3)):
                use = np.flatnonzero((sizes > 0) & (table["k2"][inst] == k2))
                if not len(use):
                    continue
                base = np.zeros(len(sizes), np.int64)
                n1 = table["n1"][inst[use]]
                ends = np.cumsum(n1)
                base[use] = ends - n1
                mask = np.zeros(len(sizes), bool)
                mask[use] = True
                own = mask[doc]
                d, v, p = doc[own], value[own], place[own]
                n1_of = table["n1"][inst[d]].astype(np.uint64)
                cell = (base[d] + (p % n1_of).astype(np.int64)) * n2
                if n2 > 1:
                    cell += ((p >> U(32)) % U(n2)).astype(np.int64)
                total = int(ends[-1]) * n2
                order = np.argsort(cell)
                at = np.searchsorted(cell[order], np.arange(total + 1))
                content, count = _sums(v[order], at).reshape(-1, n2), np.diff(at).reshape(-1, n2)
                part_doc = np.repeat(use, n1)
                part = np.arange(int(ends[-1])) - base[part_doc]
                if k2:  # subsets leave out one piece each
                    content, count = content.sum(1, keepdims=True) - content, count.sum(1, keepdims=True) - count
                empty = count == 0
                weak = np.bincount(part_doc, empty.any(1), minlength=len(sizes))
                written = ~empty | (weak > table["spare"][inst])[part_doc][:, None]
                name = mix(inst[part_doc].astype(np.uint64) * U(0x9E3779B97F4A7C15) + part.astype(np.uint64))[:, None] + np.arange(n2, dtype=np.uint64)
                sig = mix(content * U(0xD6E8FEB86659FD93) + mix(name))
                rows.append(np.broadcast_to(part_doc[:, None], sig.shape)[written])
                sigs.append(sig[written])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(sigs)


def _profile(k: int):
    def run(batches):
        for b in batches:
            for row, to, elements, off in _sets(b.column("text"), k):
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(row, to - row), pa.array(np.diff(off).astype(np.int64)), pa.array(signed(_keys(elements, off))), pa.array([parities(elements[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())],
                    ["id", "n", "key", "parity"],
                )

    return run


def names_of(sig: np.ndarray, shards: int) -> np.ndarray:
    """A signature's shard (a range of its upper half) above its lowest 40 bits."""
    return (((sig >> U(32)) * U(shards) >> U(32)) << U(40)) | (sig & U((1 << 40) - 1))


def _first_of_class(b: pa.RecordBatch, first: Member) -> pa.RecordBatch:
    """Without the rows that are surely not the first of their class."""
    return b.filter(pa.array(first.holds(b.column("id").to_numpy())))


def _packed_names(k: int, percent: int, shards: int, first: Member):
    """shard, names (5 bytes each) of the signatures of FLUSH at a time, those that two sets of them share written twice.

    However many sets share a signature, no more than two of its names come from one flush."""

    def packed(sig: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(sig)
        sig, key = sig[order], key[order]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        several = np.minimum.reduceat(key, begin) != np.maximum.reduceat(key, begin)
        name = names_of(np.repeat(sig[begin], several + 1), shards)
        shard = (name >> U(40)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        low = np.ascontiguousarray(name.view(np.uint8).reshape(-1, 8)[:, :5])
        return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array([low[x:y].tobytes() for x, y in zip(cut, np.append(cut[1:], len(low)), strict=True)], pa.binary())], ["shard", "names"])

    def run(batches):
        sigs, keys, n = [], [], 0
        for b in batches:
            for _, _, elements, off in _sets(_first_of_class(b, first).column("text"), k):
                row, sig = signatures(elements, off, percent)
                sigs.append(sig)
                keys.append(_keys(elements, off)[row])
                n += len(sig)
                if n >= FLUSH:
                    yield packed(np.concatenate(sigs), np.concatenate(keys))
                    sigs, keys, n = [], [], 0
        if n:
            yield packed(np.concatenate(sigs), np.concatenate(keys))

    return run


def _repeated_names(batches):
    """The names that occur more than once, from rows sorted by shard. One shard is held at a time."""
    at, held = None, []

    def out():
        low = np.zeros((sum(map(len, held)) // 5, 8), np.uint8)
        low[:, :5] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 5)
        name = np.sort(low.view(np.uint64).ravel())
        again = np.unique(name[1:][name[1:] == name[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(signed(again | U(at << 40)))], ["name"])

    for b in batches:
        names = b.column("names")
        for i, shard in enumerate(b.column("shard").to_pylist()):
            if shard != at:
                if held:
                    yield out()
                at, held = shard, []
            held.append(names[i].as_py())
    if held:
        yield out()


def _write_signatures(k: int, percent: int, shards: int, first: Member, wanted: Member):
    """sig, key of the signatures whose name the filter holds."""

    def run(batches):
        for b in batches:
            for _, _, elements, off in _sets(_first_of_class(b, first).column("text"), k):
                row, sig = signatures(elements, off, percent)
                keep = wanted.holds_unsigned(names_of(sig, shards))
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig[keep])), pa.array(signed(_keys(elements, off))[row[keep]])], ["sig", "key"])

    return run


def bucket_signatures(written: DataFrame) -> DataFrame:
    """Of signatures (sig, key) that several sets hold, the least of those that the same sets hold: sig, pivot (the least set).

    What sets hold a signature is told by their number, the least and the last of them and sums of 64 bits of hash."""
    h = F.xxhash64("key")
    held = written.groupBy("sig").agg(
        F.min("key").alias("pivot"), F.max("key").alias("last"), F.count("*").alias("n"),
        F.sum(h.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"),
    ).where("pivot < last")
    return held.select("sig", "pivot", F.xxhash64("last", "n", "low", "high").alias("sets")).groupBy("pivot", "sets").agg(F.min("sig").alias("sig")).select("sig", "pivot")


def _write_sets(k: int, wanted: Member):
    def run(batches):
        for b in batches:
            ids = b.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(wanted.holds(ids)))
            for row, to, elements, off in _sets(b.column("text"), k):
                lists = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(signed(elements))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(row, to - row), pa.array(signed(_keys(elements, off))), lists], ["id", "key", "elements"])

    return run


def _distances(na, nb, pa_, pb_, percent):
    """Lower bounds on the symmetric difference of pairs, and whether they leave the pair possible."""
    out = np.zeros(len(na), np.int64)
    short = np.array([min(len(x), len(y)) for x, y in zip(pa_, pb_, strict=True)])
    for n in np.unique(short):
        at = np.flatnonzero(short == n)
        x, y = (np.stack([folded(p[i], n) for i in at]) for p in (pa_, pb_))
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    out = np.maximum(out, np.abs(na - nb))
    return out, out <= most_different(na, nb, percent)


def _possible(percent: int):
    """Pairs with both sizes and parities: keep those the bound allows, with the bound."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            dist, ok = _distances(na, nb, b.column("pa").to_pylist(), b.column("pb").to_pylist(), percent)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok)), pa.array(dist[ok])], ["a", "b", "dist"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The columns of one bucket after another, as arrays, from rows sorted by bucket. low: LOW signatures a row, padded with the largest."""
    held: list[dict] = []

    def joined() -> dict:
        return {c: (sum((h[c] for h in held), []) if c == "parity" else np.concatenate([h[c] for h in held])) for c in held[0]} if len(held) > 1 else held[0]

    for b in batches:
        if not b.num_rows:
            continue
        col = {c: b.column(c).to_numpy() for c in ("bucket", "side", "sig", "key", "component", "n")}
        lists = b.column("low")
        size = lists.value_lengths().to_numpy()
        col["low"] = np.full((b.num_rows, LOW), np.iinfo(np.int64).max)
        col["low"][np.arange(LOW) < size[:, None]] = lists.flatten().to_numpy()
        parity = b.column("parity")
        cut = np.flatnonzero(col["bucket"][1:] != col["bucket"][:-1]) + 1
        for x, y in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            if held and held[0]["bucket"][0] != col["bucket"][x]:
                yield joined()
                held = []
            held.append({c: v[x:y] for c, v in col.items()} | {"parity": parity.slice(x, y - x).to_pylist()})
    if held:
        yield joined()


def _within(percent: int, nearest: bool):
    """Pairs of different components in each bucket, as the bound allows: the nearest of each component, or all.
    `more` tells that the bucket has others."""

    def pairs(rows: dict) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
        """Places of both ends of each pair, and `more`."""
        n_bytes = min(map(len, rows["parity"]))
        sketch = np.stack([folded(p, n_bytes) for p in rows["parity"]])
        size, comp, side, low = (rows[c] for c in ("n", "component", "side", "low"))
        # two sets that share an earlier signature meet there; the first that they share is in neither's way
        earlier = low < rows["sig"][:, None]
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        a, b, more = [], [], False
        best: dict = {}
        for i in left.tolist():
            other = right[(comp[right] != comp[i]) & ((right > i) | (side[right] == 2))]
            if not len(other):
                continue
            d = np.maximum(np.bitwise_count(sketch[other] ^ sketch[i]).sum(1, dtype=np.int64), np.abs(size[other] - size[i]))
            ok = np.flatnonzero(d <= most_different(size[other], size[i], percent))
            if not len(ok):
                continue
            if nearest:
                j = ok[int(np.argmin(d[ok]))]
                more = more or len(ok) > 1 or comp[i] in best
                if comp[i] not in best or d[j] < best[comp[i]][0]:
                    best[comp[i]] = (d[j], i, other[j])
                continue
            to = other[ok]
            own = low[i][earlier[i]]
            met = (np.isin(low[to], own) & earlier[to]).any(1) if len(own) else np.zeros(len(to), bool)
            b.append(to[~met])
            a.append(np.full(len(b[-1]), i))
        if best:
            a.append(np.array([i for _, i, _ in best.values()]))
            b.append(np.array([j for _, _, j in best.values()]))
        return a, b, more

    def run(batches):
        for rows in _buckets(batches):
            a, b, more = pairs(rows)
            if not a:
                continue
            x, y = (rows["key"][np.concatenate(v)] for v in (a, b))
            if len(x):
                sig = np.full(len(x), rows["sig"][0])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sig), pa.array(np.full(len(x), more))], ["a", "b", "sig", "more"])

    return run


def _blocks(rows: DataFrame, sketch: DataFrame, with_low: bool) -> DataFrame:
    """Give each row (sig, key, component) its bucket and its parities. A signature with more than BLOCK sets is
    cut into blocks, and each two blocks meet in a bucket of their own (side 1 against side 2), so that no bucket
    passes 2 * BLOCK rows. low is empty where it isn't asked for."""
    sizes = rows.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    rows = rows.join(sizes, "sig").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
        "sig", "key", "component",
    )
    if with_low:
        low = rows.select("sig", "key").distinct().groupBy("key").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LOW).alias("low"))
        sketch = sketch.join(low, "key")
    else:
        sketch = sketch.withColumn("low", F.array().cast("array<long>"))
    return rows.join(sketch, "key").repartition("bucket").sortWithinPartitions("bucket", "key")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("key").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("eb"))
    shared = F.size(F.array_intersect("ea", "eb"))
    # the pair that meets both sets is wide, so the order of the joins keeps only one set in a row at a time
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("shared", shared)
    return joined.where(100 * F.col("shared") >= percent * (F.size("ea") + F.size("eb") - F.col("shared"))).select("a", "b")


def _log2_cells(keys: DataFrame) -> int:
    """For a filter of these keys: eight cells or more for each, up to 2**27 in all."""
    return int(np.clip(int(8 * keys.count()).bit_length(), 16, 27))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    return nodes.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: id, n_shingles (size of its set) and component_id, the smallest id that
    its chain of links reaches. Two rows link when 100 * intersection >= percent * union.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is
    one shingle, an empty or null text has an empty set and links with nothing. Rows with equal ids and equal
    texts are links of one another like any others. Rows with a null id take no part: component_id is null.
    Extra columns of docs are not read.
    """
    spark, scratch = docs.sparkSession, Scratch()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = scratch.stored(rows.mapInArrow(tidy(_profile(shingle_words)), "id long, n long, key long, parity binary"), "profile")
    real = profile.where("n > 0 and id is not null")
    classes = real.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("parity").alias("parity"))

    named = rows.where("id is not null")
    elements = real.agg(F.sum("n")).first()[0] or 0
    shards = int(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), elements // SHARD_ELEMENTS + 1))
    firsts = scratch.stored(real.groupBy("key").agg(F.min("id").alias("id")).select("id"), "firsts")
    first = member_filter(firsts, _log2_cells(firsts))
    packed = named.mapInArrow(tidy(_packed_names(shingle_words, percent, shards, first)), "shard int, names binary")
    repeated = scratch.stored(packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(_repeated_names), "name long"), "repeated")
    # written out are only those that some other set may share
    again = named.mapInArrow(tidy(_write_signatures(shingle_words, percent, shards, first, member_filter(repeated, _log2_cells(repeated)))), "sig long, key long")
    written = scratch.stored(again, "signatures")
    shared = scratch.stored(bucket_signatures(written), "shared")
    buckets = scratch.stored(written.join(shared, "sig").select("sig", "key", "pivot").distinct(), "buckets")
    scratch.drop(written, repeated, firsts, shared)

    involved = scratch.stored(buckets.select("key").distinct().join(classes, "key"), "involved")
    sketch = involved.select("key", "n", "parity")

    def verified(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        ids = scratch.stored(keys.join(involved, "key").select("id", "key"), "ids")
        read = rows.mapInArrow(tidy(_write_sets(shingle_words, member_filter(ids.select("id")))), "id long, key long, elements array<long>")
        sets = scratch.stored(read.join(ids, ["id", "key"], "left_semi").dropDuplicates(["key"]), "sets")
        out = scratch.stored(_verified(pairs, sets, percent), "verified")
        scratch.drop(ids, sets)
        return out

    # each set against the first sets of its buckets: sizes first, then the bound
    stars = buckets.where("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    for c in "ab":
        stars = stars.join(involved.select(F.col("key").alias(c), F.col("n").alias("n" + c)), c)
    stars = stars.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    for c in "ab":
        stars = stars.join(involved.select(F.col("key").alias(c), F.col("parity").alias("p" + c)), c)
    possible = scratch.stored(stars.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(tidy(_possible(percent)), "a long, b long, dist long"), "possible")
    tried = scratch.stored(possible.groupBy("b").agg(F.min_by("a", F.struct("dist", "a")).alias("a")).select("a", "b"), "pairs")
    links = verified(tried)
    # then what is still in different components: other first sets, and all others two by two
    others = scratch.stored(buckets.where("key != pivot").select("sig", "key"), "others")
    for only_nearest in (True, False):
        node = scratch.stored(_labels(sketch.select("key"), links), "labels")
        rest = scratch.stored(others.join(node, "key"), "rest")
        several = rest.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sig")
        found = scratch.stored(_blocks(rest.join(several, "sig"), sketch, not only_nearest).mapInArrow(tidy(_within(percent, only_nearest)), "a long, b long, sig long, more boolean"), "found")
        pairs = found.select("a", "b")
        if only_nearest:
            apart = possible.select("a", "b")
            for c in "ab":
                apart = apart.join(node.select(F.col("key").alias(c), F.col("component").alias("c" + c)), c)
            pairs = pairs.union(apart.where("ca != cb").select("a", "b"))
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = scratch.stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = scratch.stored(links.union(verified(pairs)), "links")
        tried = tried.union(pairs)
        # only buckets with pairs that weren't looked at can have any left
        others = scratch.stored(others.join(found.where("more").select("sig").distinct(), "sig", "left_semi"), "others")
        if others.isEmpty():
            break
    component = _labels(involved.select("key", "id"), links)
    least = component.groupBy("component").agg(F.min("id").alias("component_id"))
    component = component.join(least, "component").select("key", "component_id")
    alone = classes.select("key", F.col("id").alias("own"))
    result = profile.join(alone, "key", "left").join(component, "key", "left")
    known = F.when(F.col("id").isNotNull(), F.coalesce("component_id", F.when(F.col("n") > 0, F.col("own")), "id"))
    out = result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), known.alias("component_id"))
    out = stored(out, "components")
    scratch.drop()
    return out
