"""The n-gram Jaccard join and substring dedup against brute force over whole tables."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from loomgraph import storage
from loomgraph.llm import queries
from loomgraph.llm.ngram_jaccard import bucket_signatures, ngram_jaccard_join
from loomgraph.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute_join(rows, k, percent):
    """Of (id, text): (id, set size, smallest id reachable)."""
    sets = [shingle_set(t, k) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        if rows[i][0] is None:
            continue
        for x in s:
            for j in where[x]:
                if j < i and rows[j][0] is not None:
                    shared[j] += 1
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    for i in range(len(rows)):  # rows of one id reach each other's links by that id
        pass
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_join_over_the_whole_table(spark, sf, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    assert found(queries.op1_ngram_jaccard(spark, sf)) == brute_join(rows, 4, 85)


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (4, 85), (2, 60)])
def test_join_of_near_copies_of_every_size(spark, k, percent):
    rng = random.Random(percent)
    rows = []
    for size in (1, 2, 3, 5, 8, 12, 20, 40, 90, 300, 1000):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(size + k - 1)]
        for _ in range(14):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, size // (3 * k)))):
                at = rng.randrange(len(text))
                text[at : at + rng.choice((0, 1))] = [f"n{rng.randrange(10**6)}"] * rng.choice((0, 1))
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(ngram_jaccard_join(docs, shingle_words=k, percent=percent)) == brute_join(rows, k, percent)


def test_join_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert found(ngram_jaccard_join(edge_docs)) == brute_join(rows, 5, 80)
    assert found(ngram_jaccard_join(no_docs)) == []


def test_signatures_of_copies_and_buckets_of_equal_sets(spark, monkeypatch):
    """Equal sets write signatures once; however many signatures the same sets share, they meet in one bucket."""
    rng = random.Random(3)
    base = [[f"{rng.randrange(10**6)}" for _ in range(300)] for _ in range(30)]
    rows = [(3 * i, " ".join(b)) for i, b in enumerate(base)]
    rows += [(3 * i + 1, " ".join(b)) for i, b in enumerate(base)]  # exact copies
    rows += [(3 * i + 2, " ".join([*b[:-1], "other"])) for i, b in enumerate(base[:10])]  # near copies of a third
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    real, counts = storage.stored, defaultdict(list)

    def counted(df, name):
        out = real(df, name)
        counts[name].append(out.count())
        return out

    monkeypatch.setattr(storage, "stored", counted)
    assert found(ngram_jaccard_join(docs)) == brute_join(rows, 5, 80)
    assert counts["buckets"] == [20]
    few = docs.where("doc_id % 3 < 2")
    counts.clear()
    assert found(ngram_jaccard_join(few)) == brute_join([r for r in rows if r[0] % 3 < 2], 5, 80)
    assert counts["signatures"][0] < 30 and counts["buckets"] == [0]


def test_buckets_held_by_the_same_sets(spark):
    """One signature, the least, for each collection of sets; those held by one set, or by one twice, go."""
    held = {1: (5, 7), 2: (5, 7), 3: (5, 7, 9), 4: (5, 8, 9), 5: (5,), 6: (5, 5), 8: (9, 7, 5), 9: (-3, 9)}
    written = spark.createDataFrame([(s, k) for s, keys in held.items() for k in keys], "sig long, key long")
    assert sorted(map(tuple, bucket_signatures(written).collect())) == [(1, 5), (3, 5), (4, 5), (9, -3)]


def brute_dedup(rows, window):
    first, starts = {}, defaultdict(list)
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in first:
                starts[d].append(i)
            else:
                first[key] = (d, i)
    out = []
    for d, w in words.items():
        gone = {j for i in starts[d] for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_dedup_over_the_whole_table(spark, sf, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, sf).collect())
    assert got == brute_dedup(rows, 20)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("window", [1, 3, 9, 20])
def test_dedup_of_other_windows(spark, window):
    rng = random.Random(window)
    passages = [" ".join(str(rng.randrange(30)) for _ in range(rng.randrange(60))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.6 else f"u{rng.random()}" for _ in range(rng.randrange(8)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup(docs, window=window).collect())
    assert got == brute_dedup(rows, window)


def test_dedup_edges(edge_docs, no_docs):
    one_each = edge_docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    rows = [(r.doc_id, r.text) for r in one_each.collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup(one_each).collect())
    assert got == brute_dedup(rows, 20)
    everything = substring_dedup(edge_docs).collect()
    assert len(everything) == edge_docs.count()
    assert all(r.n_removed == 0 for r in everything if r.doc_id is None)
    assert substring_dedup(no_docs).collect() == []
