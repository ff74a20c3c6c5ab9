"""Benchmark decontamination and nearest neighbours against brute force."""

import re
from collections import Counter
from math import log

import numpy as np
import pytest

from loomgraph.llm import queries
from loomgraph.llm.decontaminate import benchmark_leaks, without_leaks
from loomgraph.llm.nearest import nearest_neighbours

WORD = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+")


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def brute_leaks(docs, items):
    """{(doc, item): (start, similarity)} over every window of every text."""
    items = [(i, WORD.findall((t or "").lower())) for i, t in items if i is not None]
    items = [(i, w) for i, w in items if w]
    often = Counter(s for _, w in items for s in set(shingles(w)))
    weight = {s: 1 + log(len(items) / c) for s, c in often.items()}
    other = 1 + log(len(items)) if items else 1
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        if not w:
            continue
        every = set(shingles(w)) if len(w) >= 5 else {tuple(w)}
        for i, item in items:
            wanted = set(shingles(item))
            # a bound, for texts whose windows have shingles of five words alone
            if len(item) >= 5 and sum(weight[s] for s in wanted & every) < 0.8 * sum(weight[s] for s in wanted):
                continue
            n = min(len(item), len(w))
            for start in range(len(w) - n + 1):
                have = set(shingles(w[start : start + n]))
                both = sum(weight[s] for s in have & wanted)
                s = both / sum(weight.get(x, other) for x in have | wanted)
                if s >= 0.8 - 1e-12 and ((d, i) not in out or s > out[d, i][1] + 1e-12):
                    out[d, i] = (start, s)
    return out


def same(found, want):
    assert set(found) == set(want)
    for k, (start, s) in want.items():
        assert abs(found[k][1] - s) < 1e-9 and found[k][0] == start


def test_leaks_over_the_whole_table(spark, sf, tables):
    rows = queries.op8_benchmark_leaks(spark, sf).collect()
    want = brute_leaks([(r.doc_id, r.text) for r in tables("documents").collect()], [(r.item_id, r.text) for r in tables("benchmark").collect()])
    assert want
    same({(r.doc_id, r.item_id): (r.start, r.similarity) for r in rows}, want)


def test_leaks_of_edited_items(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.integers(300))}"
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 90))))) for i in range(40)]
    docs = []
    for i in range(200):
        w = items[int(rng.integers(40))][1].split()
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = word()
        docs.append((i, " ".join([word() for _ in range(int(rng.integers(0, 60)))] + w + [word() for _ in range(int(rng.integers(0, 60)))])))
    docs += [(200, items[0][1]), (201, items[1][1].upper() + "!")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = benchmark_leaks(d, b).collect()
    want = brute_leaks(docs, items)
    assert len(want) > 60
    same({(r.doc_id, r.item_id): (r.start, r.similarity) for r in rows}, want)
    left = {r.doc_id for r in without_leaks(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_leak_edges(spark, edge_docs, no_docs):
    text = edge_docs.where("doc_id = 1").first().text
    items = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "one"), (5, "two words"), (None, text), (6, text)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in benchmark_leaks(edge_docs, items).collect()}
    assert found == {(d, i) for d in (1, 2, None) for i in (1, 6)} | {(8, 4), (9, 5)}
    kept = without_leaks(edge_docs, items)
    assert kept.columns == edge_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "5", "None", "6", "7", "10"])
    assert benchmark_leaks(no_docs, items).collect() == [] and benchmark_leaks(edge_docs, items.limit(0)).collect() == []
    assert without_leaks(edge_docs, items.limit(0)).count() == edge_docs.count()


def test_short_items_are_found_inside_longer_texts(spark):
    items = [(1, "go"), (2, "stop now"), (3, "a b c"), (4, "w x y z"), (5, "a b c"), (6, "one two three four five six")]
    docs = [(1, "please go home"), (2, "do stop now, or never"), (3, "A, b; c!"), (4, "v w x y z v w x y z"), (5, "w x y"), (6, "x " * 30 + "a b c"), (7, "stop"), (8, "b c a b"), (9, "one two three four five six go"), (10, ""), (11, "now stop")]
    rows = benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(1, 1), (2, 2), (3, 3), (3, 5), (4, 4), (6, 3), (6, 5), (9, 6), (9, 1)} == set(want)
    same({(r.doc_id, r.item_id): (r.start, r.similarity) for r in rows}, want)


def brute_nearest(rows, every, nearest):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(1) / (norm * norm[q])
        order = [j for j in np.lexsort((ids, -score)) if j != q][:nearest]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(found, want):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_over_the_whole_table(spark, sf, tables):
    rows = [(r.vec_id, r.embedding) for r in tables("embeddings").collect()]
    want, found = brute_nearest(rows, 50, 5), by_query(queries.op10_nearest_neighbours(spark, sf).collect())
    assert recall(found, want) >= 0.9
    known = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in found.items():
        assert [(-s, i) for i, s in near] == sorted((-s, i) for i, s in near) and q not in [i for i, _ in near]
        for i, s in near:
            a, b = known[q], known[i]
            assert abs(s - (a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())) < 1e-12


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_neighbours_in_clusters_and_copies(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(30, size=3000)] * rng.uniform(0.1, 9, (3000, 1)) + spread * rng.normal(size=(3000, 16))
    x[1000:2000] = x[7]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = by_query(nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = brute_nearest(rows, 50, 5)
    # equal scores up to the order of additions are as good
    hit = [abs(s - t) < 1e-9 for q, w in want.items() for (_, t), (_, s) in zip(w, found.get(q, []), strict=False)]
    assert sum(hit) >= 0.9 * sum(map(len, want.values()))


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (50, [0.0, 2.0], "b"), (1, None, "c"), (2, [0.0, 0.0], "d"), (3, [nan, 1.0], "e"), (4, [inf, 1.0], "f"), (5, [None, 1.0], "g"), (None, [1.0, 1.0], "h"), (6, [1.0, 1.0], "i"), (7, [1.0, 1.0], "j"), (100, None, "k")]
    found = by_query(nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string")).collect())
    assert {q: [i for i, _ in n] for q, n in found.items()} == {0: [6, 7, 50], 50: [6, 7, 0]}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, id string")
    assert nearest_neighbours(none).collect() == []
