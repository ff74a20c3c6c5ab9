"""Each stage of the pipeline on its own input against a plain definition."""

from collections import Counter

import corpus_pipeline
from loomgraph.llm.toxicity import toxicity
from test_leaks_vectors import brute_leaks
from test_pairs import brute_join
from test_tokens_mixing import brute_targets
from loomgraph.storage import stored


def test_stages(spark, sf, tables):
    docs = tables("documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        outs.append(stored(stage(spark, docs if not outs else outs[-1], sf), "stage"))
        if name != names[-1]:
            assert outs[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in o.select("doc_id").collect()) for o in outs]
    clean = toxicity(docs.select("doc_id", "text"), tables("labels")).where("predicted = 0")
    assert ids[0] == sorted(r.doc_id for r in clean.select("doc_id").collect())
    rows = [(r.doc_id, r.text) for r in outs[0].collect()]
    assert ids[1] == sorted(d for d, _, c in brute_join(rows, 5, 80) if d == c)
    rows = [(r.doc_id, r.text) for r in outs[1].collect()]
    leaks = {d for d, _ in brute_leaks(rows, [(r.item_id, r.text) for r in tables("benchmark").collect()])}
    assert leaks and ids[2] == sorted(set(ids[1]) - leaks)
    sizes, taken = {}, {}
    for have, of in ((sizes, outs[2]), (taken, outs[3])):
        for r in of.collect():
            have[r.source] = have.get(r.source, 0) + len((r.text or "").split())
    target = brute_targets(sizes)
    assert all(abs(taken.get(s, 0) - t) <= max(0.05 * t, 100) for s, t in target.items())
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]


def test_stages_on_an_empty_table(spark, sf, tables):
    docs = tables("documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        assert docs.count() == 0


def test_rows_without_an_id_of_their_own(spark, sf):
    """Null ids, exact repeats, and an id with two texts: stages go by rows."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(20))
    rows = [(None, text(i), "a") for i in range(40)] + [(None, text(0), "a")]
    rows += [(1, text(50), "a"), (2, text(51), "a"), (2, text(51), "a"), (2, text(50), "b"), (3, text(51), "b"), (4, text(52), "b"), (4, text(53), "b"), (5, "", "a"), (5, "", "a")]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, source string"), "stage")
    kept = stored(corpus_pipeline.one_of_each_group(spark, docs, sf), "stage")
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = [(i, t) for i, t, _ in rows if i is None] + [(1, text(50)), (2, text(51)), (4, text(52)), (4, text(53)), (5, ""), (5, "")]
    assert plain(kept) == sorted(want, key=str)
    docs = stored(docs.union(docs), "stage")
    have, taken = Counter(plain(docs)), Counter(plain(corpus_pipeline.mix_sources(spark, docs, sf)))
    assert set(taken) <= set(have) and all(n <= 3 * have[r] for r, n in taken.items())
    sizes, words = Counter(), Counter()
    source = {(i, t): s for i, t, s in rows}
    for count, of in ((sizes, have), (words, taken)):
        for r, n in of.items():
            count[source[r]] += n * len(r[1].split())
    assert all(abs(words[s] - t) <= 20 for s, t in brute_targets(sizes).items())
