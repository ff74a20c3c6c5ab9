"""Forward passes against plain loops, and inputs that are long, broken, mixed or huge."""

import math
import time

import numpy as np
import pytest

from loomgraph.llm import html_text, labelled, mixing, quality, toxicity
from loomgraph.llm.html_text import blocks_of
from loomgraph.llm.nearest import nearest_neighbours
from loomgraph.llm.pii import EMAIL, base_spans, judge, personal_data, proposals

TEXTS = ["", "a", "You are a fool! He said: no idiots here; kill them all, now.", "plain words " * 90, "é漢\x00 x\n" * 130, "abcdefg" * 200]


def test_quality_by_plain_loops(tables):
    net = quality.ByteConvolution().train(TEXTS * 4, np.array([0, 1, 0, 1, 0, 1] * 4, np.float64), epochs=1)
    raw = [t.encode() for t in TEXTS]
    got = net.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    for r, score in zip(raw, got, strict=True):
        data = r + bytes(2 * quality.HALF)
        outs = max(1, -(-len(r) // quality.STRIDE))
        halves = []
        for h in range(0, outs, quality.OUTPUTS):
            places = range(h, min(h + quality.OUTPUTS, outs))
            halves.append(np.max([sum(net.table[k][data[p * quality.STRIDE + k]] for k in range(quality.WIDTH)) for p in places], axis=0) + net.bias)
        chunks = [np.maximum(np.maximum(a, b), 0) for a, b in zip(halves, halves[1:], strict=False)] or [np.maximum(halves[0], 0)]
        z = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), [math.log1p(len(r)) / 8]]) @ net.dense + net.constant[0]
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-4


def test_block_labeller_by_plain_loops():
    pages, labels = html_text.generated_set(5, 12)
    net = html_text.BlockLabeller().train(pages, labels, epochs=1)
    got = net.scores(html_text.Inputs(pages))
    sig = lambda x: 1 / (1 + math.exp(-x))
    at = 0
    for page in pages:
        v = net.vectors(html_text.Inputs([page]))
        for i, (path, *_) in enumerate(page):  # the summed vectors, one by one
            assert np.allclose(v[i][: html_text.PATH_DIM], sum(net.p["path"][html_text.hashed_name(n)] for n in path))
        states = {}
        for d, order in (("f", range(len(page))), ("b", range(len(page) - 1, -1, -1))):
            h, c = [0.0] * html_text.HIDDEN, [0.0] * html_text.HIDDEN
            for t in order:
                z = np.concatenate([v[t], h]) @ net.p["w" + d] + net.p["b" + d]
                gates = [z[k * html_text.HIDDEN : (k + 1) * html_text.HIDDEN] for k in range(4)]
                c = [sig(f) * x + sig(i) * math.tanh(g) for i, f, g, x in zip(gates[0], gates[1], gates[3], c, strict=True)]
                h = [sig(o) * math.tanh(x) for o, x in zip(gates[2], c, strict=True)]
                states[d, t] = h
        for t in range(len(page)):
            assert abs(got[at + t] - sig(np.concatenate([states["f", t], states["b", t]]) @ net.p["out"] + net.p["c"][0])) < 1e-9
        at += len(page)


def test_grammar_by_its_parts():
    """The composed automaton tells what its five transducers tell one by one."""
    parts = [toxicity.Transducer({(0, toxicity.INSULT): (0, "insult")}), toxicity.threats(4), toxicity.until_end(toxicity.TARGET, "target"), toxicity.within(toxicity.NEGATION, "negation", 3), toxicity.until_end(toxicity.REPORT, "report")]
    rng = np.random.default_rng(2)
    for _ in range(200):
        symbols = rng.integers(0, 6, int(rng.integers(1, 12))).tolist()
        weights = [2.0 if s == toxicity.INSULT else 0.0 for s in symbols]
        want, states = dict.fromkeys(toxicity.KINDS, 0.0), [0] * 5
        for s, w in zip(symbols, weights, strict=True):
            told = set()
            for i, p in enumerate(parts):
                states[i], said = p.step(states[i], s)
                told.add(said)
            if "insult" in told:
                want["negated" if "negation" in told else "reported" if "report" in told else "targeted" if "target" in told else "plain"] += w
            elif "threat" in told:
                want["threat"] += 3.0
        assert toxicity.clause_weights(symbols, weights) == [want[k] for k in toxicity.KINDS]


def test_toxicity_features_by_plain_loops():
    texts = ["you fool, you fool. nice day", "he said you fool", "not a fool", "calm words here", "I will kill you", "a fool; a fool\nb fool"]
    bad = ["you utter fool"] * 20
    lexicon = toxicity.Lexicon(bad + ["calm words here nice day said not a b"] * 60, np.array([1.0] * 20 + [0.0] * 60))
    for text, row in zip(texts, toxicity.features_of(texts, lexicon), strict=True):
        clauses, total, worst, hit = [c.split() for c in text.replace(".", ";").replace("\n", ";").replace(",", " ").split(";")], np.zeros(5), 0.0, 0
        weight = {w: float(lexicon.insults(x, x.hashes())[0]) for w in set(sum(clauses, [])) for _, _, x in toxicity.word_slices(html_text.pa.array([w]))}
        for words in clauses:
            kind = [toxicity.INSULT if weight[w] > 0 else next((k for k, v in toxicity.CUES.items() if w.lower() in v.split()), toxicity.OTHER) for w in words]
            if toxicity.INSULT in kind or toxicity.THREAT in kind:
                told = toxicity.clause_weights(kind, [weight[w] for w in words])
                total, worst, hit = total + told, max(worst, sum(told)), hit + (sum(told) > 0)
        n = len(text.replace(";", " ").split())
        want = [*np.log1p(total), worst, math.log1p(hit), total.sum() / math.sqrt(n + 1), min(total.sum() / (n + 1) * 20, 5), total.sum() > 0, math.log1p(n)]
        assert np.allclose(row, want), text


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>t</title><body><h1>x</h1><p>hello world</p></body></html>", ["x", "hello world"]),
    ("<head><title>t</title>Hello <b>you</b><p>x", ["Hello you", "x"]),
    ("<head><meta charset=x><script>y</script><link rel=z><p>x", ["x"]),
    ("<title>a <b> c</title><p>x", ["x"]),
    ("<p>a</p><svg class='i'/><p>b</p>", ["a", "b"]),
    ("<p>a<svg><p>b<template><p>c", ["a", "b", "c"]),
    ("<p>a<svg><text>no</text></svg><p>b", ["a", "b"]),
    ("<select><option>a<option>b</select><p>z", ["z"]),
    ("<select><option>a<p>z", ["z"]),
    ("<div><div><div><div><div><form><select><option>a</select></form></div></div></div></div></div>z", ["z"]),
    ("a < b <a href='x>y'>l</a> c", ["a < b l c"]),
    ('<p class="x>y<p>z', ["y", "z"]),
    ("<p>x<!-- c --><p>y<!-- d", ["x", "y"]),
    ("", []),
])
def test_blocks_of_unusual_pages(page, want):
    assert [b[1] for b in blocks_of(page)] == want


def test_long_broken_pages_take_one_pass():
    for unit in ('<a "', '<a ="', "<", "<svg>", "<div>", "<p", "<a x='", "<!", "<!--", "</b>", "<div></p>", "<template>", "&lt"):
        begin = time.process_time()
        blocks_of(unit * 20_000)
        assert time.process_time() - begin < 5, unit


def test_deep_pages_keep_the_outermost_names():
    page = '<div class="comments">' + "<div>" * 200 + "x" + "</div>" * 200 + "</div><p>y"
    (path, text, _), (other, _, _) = blocks_of(page)
    assert text == "x" and ".comments" in path and ".comments" not in other


@pytest.mark.parametrize("unit", ["a", "7", "at ", "at-", "a@", "1.", "+1 ", "@", "a.at.b ", "a at b.c ", "10.0.0.1 ", "4111 1111 1111 1111 "])
def test_long_runs_take_one_pass(unit):
    text = (unit * (1 << 20))[: 1 << 20]
    begin = time.process_time()
    base_spans(text), proposals(text)
    assert time.process_time() - begin < 8


def test_base_spans_of_huge_numbers():
    assert base_spans("1" * 5000 + ".1.1.1 0000001.2.3.255 1.2.3.256") == [(1, 5007, 5022)]


def test_addresses_far_from_their_dots():
    text = f"write to jane at {'x' * 90} dot com please"
    at = text.index("jane")
    assert (0, at, text.index(" please")) in proposals(text)
    assert EMAIL.search(text) is None and judge().added(text, []) is not None


def test_equal_answers_with_and_without_a_digit_elsewhere(spark):
    text = f"contact jane.doe at {'x' * 30} dot com"
    rows = personal_data(spark.createDataFrame([(1, text), (2, text + " 7")], "doc_id long, text string")).collect()
    assert rows[0].spans == rows[1].spans != ""


def cosine(a, b):
    a, b = (np.array(v, np.float64) / max(map(abs, v)) for v in (a, b))
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def test_neighbours_of_huge_tiny_and_mixed_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([-200, 0, 200])).tolist()) for i in range(100)]
    rows += [(i, rng.normal(size=5).tolist()) for i in range(100, 110)] + [(150, [1.0, 2.0]), (151, [0.0, 0.0, 0.0, 0.0]), (200, [float("nan")] * 4), (250, None)]
    out = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), nearest=5).collect()
    real = {i: v for i, v in rows if v and any(v) and not any(map(math.isnan, v))}
    for q in (0, 50, 100, 150):
        found = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        want = sorted(((-cosine(real[q], v), i) for i, v in real.items() if i != q and len(v) == len(real[q])))[:5]
        assert [r[0] for r in found] == list(range(1, len(want) + 1))
        assert np.allclose([r[2] for r in found], [-w[0] for w in want], atol=1e-12), q
    assert {r.query_id for r in out} == {0, 50, 100}


def test_mixing_deals_out_equal_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", "x")] * 9000 + [(None, "d e f", "x")] * 10 + [(7, "g h i", "y")] * 10, "doc_id long, text string, source string")
    one, two = (mixing.pivotal_mix(d).groupBy("doc_id", "source", "taken").count().collect() for d in (docs, docs.repartition(5)))
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)
    assert sum(r["count"] for r in one) == 9020
    taken = {s: sum(r.taken * r["count"] for r in one if r.source == s) for s in "xy"}
    assert taken["y"] == 90 and abs(taken["x"] - (27060 - 90)) <= 3


def test_long_labelled_texts_are_left_out_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(labelled, "MOST_BYTES", 1000)
    docs = spark.createDataFrame([(i, "w" * (400 if i % 2 else 90)) for i in range(40)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "concat(text, doc_id) text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts, y, ids = labelled.training_sample(docs, labels, "quality")
    assert 0 < sum(map(len, texts)) <= 1000 and len(texts) == len(y) == len(set(ids.tolist()))
