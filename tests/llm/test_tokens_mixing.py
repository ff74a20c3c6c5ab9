"""Token files by an exact round trip; the mix against its targets."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import queries
from loomgraph.llm.huffman import MAX_LENGTH, canonical, code_lengths, decode, encode
from loomgraph.llm.mixing import pivot, pivotal_mix
from loomgraph.llm.token_output import read_tokens, token_digest, write_tokens
from loomgraph.storage import new_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def brute_digest(rows):
    tokenizer, at, out = Tokenizer.from_file(str(VOCABULARY)), 0, []
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tokens_over_the_whole_table(spark, sf, tables):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_output(spark, sf).collect())
    assert got == brute_digest([(r.doc_id, r.text) for r in tables("documents").collect()])


ODD = ["", None, "don't <|endoftext|> STOP <|Endoftext|>", "a...b!!! (c)--d e.g. U.S.A. 3.14 10,000 $5 50% C++ x_y", "ÀÉ×÷ straße ǅ İi  x y​ z", "tabs\tand\nlines\r\n\x0bend", "漢字かな交じり文 \U0001f600\U0001f468‍\U0001f469", "é é ñ", "''' \"quoted\" `code` --- *** ###", "word." * 50, "MiXeD CaSe WORDS! And;semi:colons,commas", "é. à, ß! ü?", "x" * 3000]


def test_tokens_of_odd_texts(spark):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_path(spark, "tokens")
    write_tokens(docs, folder, open(VOCABULARY, encoding="utf-8").read())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_digest(spark, folder).collect())
    assert got == brute_digest(rows)


def test_token_edges(spark, edge_docs, no_docs):
    vocabulary = open(VOCABULARY, encoding="utf-8").read()
    folder = new_path(spark, "tokens")
    write_tokens(edge_docs, folder, vocabulary)
    rows = read_tokens(spark, folder).collect()
    tokenizer = Tokenizer.from_file(str(VOCABULARY))
    want = sorted(([r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]] for r in edge_docs.collect()), key=str)
    assert sorted(([r.doc_id, np.frombuffer(r.ids, "<u4").tolist()] for r in rows), key=str) == want
    digest = sorted((r.start, r.n_tokens) for r in token_digest(spark, folder).collect())
    assert digest[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(digest, digest[1:], strict=False))
    folder = new_path(spark, "tokens")
    write_tokens(no_docs, folder, vocabulary)
    assert token_digest(spark, folder).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 100, 30_000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, 20_000) - 1, n - 1).astype(np.uint16)
    counts = np.bincount(ids, minlength=1 << 16)
    lengths = code_lengths(counts)
    used = lengths[counts > 0].astype(float)
    assert used.max() <= MAX_LENGTH and (2.0**-used).sum() <= 1
    code = canonical(lengths)
    blocks = np.array_split(ids, 3)
    packed = [encode(code, b) for b in blocks]
    back = decode(code, [p for p, _ in packed], [c for _, c in packed], [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    alone = decode(code, [packed[1][0]], [packed[1][1]], [len(blocks[1])])
    assert (alone[0] == blocks[1]).all()


def test_bounded_lengths_are_optimal_where_the_bound_does_not_bind():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap, total = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((code_lengths(counts).astype(int) * counts).sum()) == total
    steep = code_lengths(2 ** np.arange(40, dtype=np.int64))
    assert steep.max() == MAX_LENGTH and (2.0 ** -steep.astype(float)).sum() <= 1


def brute_targets(sizes):
    """Reshare by weight until no source is above 3 times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def held(rows, text_of):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert sorted(r.size for r in rows) == sorted(len(word.findall(t or "")) for t in text_of)
    target = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) <= 1e-9 * max(1, target[r.source])
    return sizes, taken, target


def test_mix_over_the_whole_table(spark, sf, tables):
    rows = queries.op3_pivotal_mixing(spark, sf).collect()
    sizes, taken, target = held(rows, [r.text for r in tables("documents").collect()])
    most = {}
    for r in rows:
        most[r.source] = max(most.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s] and abs(taken[s] - target[s]) <= max(0.02 * target[s], 60)
    again = queries.op3_pivotal_mixing(spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_edges(spark, edge_docs, no_docs):
    rows = pivotal_mix(edge_docs).collect()
    held(rows, [r.text for r in edge_docs.collect()])
    assert pivotal_mix(no_docs).collect() == []
    only_empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in pivotal_mix(only_empty).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_mix_of_many_sources(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{int(rng.zipf(1.5)) % 23:02d}") for i in range(6000)]
    out = pivotal_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    _, taken, target = held(out, [t for _, t, _ in rows])
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)


def test_pivot_keeps_expectations():
    size = np.array([10.0, 3, 7, 100, 5, 2])
    mass = size * np.array([0.3, 0.5, 0.2, 0.4, 0.9, 0.1])
    rng = np.random.default_rng(2)
    mean = np.mean([pivot(size, mass, rng.random(12)) for _ in range(20_000)], 0)
    assert np.abs(mean - mass).max() < 0.02 * size.max()
    one = pivot(size, mass, rng.random(12))
    part = pivot(size, mass, rng.random(12), last=False)
    assert abs(part.sum() - mass.sum()) < 1e-6
    assert abs(one.sum() - mass.sum()) < 1e-6 and ((one > 0) & (one < size)).sum() <= 1
