"""Line dedup, Merkle manifests and prefix tries against plain loops, on the rows that are hard for them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import line_dedup as lines
from loomgraph.llm import merkle, ranks
from loomgraph.llm.prefix_trie import NODE, numbered_turns, prefix_trie, with_shared_heads
from loomgraph.storage import Scratch, stored


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ranks and joins


def test_ranks_of_equal_null_and_hot_rows(spark):
    rows = [(None if i % 5 == 0 else i % 3, i % 7) for i in range(400)] + [(1, 3)] * 500 + [(2, None)] * 3
    df = stored(spark.createDataFrame(rows, "k long, v long").repartition(5), "in")
    got = ranks.ranked(Scratch(), df, ["k"], ["v"], ["k", "v"]).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.k].append((r.rank, r.v, r.n_rows))
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert set(groups) == set(want)
    for k, found in groups.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(len(want[k]))) and {n for _, _, n in found} == {len(want[k])}
        assert [v for _, v, _ in found] == sorted(want[k], key=lambda v: (v is not None, v))


def test_a_hot_group_is_ranked_by_several_tasks(spark):
    df = stored(spark.range(4000).select(F.lit(1).alias("k"), F.lit(0).alias("v")).repartition(4), "in")
    scratch = Scratch()
    assert sorted(r.rank for r in ranks.ranked(scratch, df, ["k"], ["v"], ["k"]).collect()) == list(range(4000))
    assert scratch.tables[1].count() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # a run for each range


@pytest.mark.parametrize("heavy", [1, 4, 1024])
def test_join_by_counts(spark, monkeypatch, heavy):
    monkeypatch.setattr(ranks, "HEAVY", heavy)
    rows = [(k, i) for i, k in enumerate([1] * 60 + [2] * 30 + list(range(3, 30)))]
    n = Counter(k for k, _ in rows)
    left = spark.createDataFrame(rows, "k long, i long")
    right = spark.createDataFrame([(k, f"v{k}", c) for k, c in n.items() if k != 5], "k long, v string, n long")
    got = sorted(tuple(r) for r in ranks.counted_join(left, right, ["k"], "n").collect())
    assert got == sorted((k, i, f"v{k}") for k, i in rows if k != 5)


# lines


def plain_lines(texts, least_docs, least_chars):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(lines.BLANK))

    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for s in split for k in {key(x) for x in s} if len(k) >= least_chars)
    out = []
    for s in split:
        kept = [x for x in s if n[key(x)] < least_docs]
        out.append((len(s), len(s) - len(kept), "\n".join(kept)))
    return out


LINE_TEXTS = [
    None, "", "\n", "\n\n", "Shared line\nown 1", "  shared LINE \t\nown 2\n", "shared line\r\nshared line\nown 3", "ÄRGER straße\nown 4", "ärger straße", "ÄRGER STRASSE\n\x0bshared line\x0c",
    "long " * 50_000 + "\nshared line", "a\n" * 5000 + "end", " shared line", "shared line ", "İstanbul", "one", "one", "one ", "x\ny\nz", "z\ny\nx",
]


@pytest.mark.parametrize("least_docs, least_chars, broadcast", [(2, 1, 1 << 20), (4, 1, 0), (2, 0, 0), (1, 3, 1 << 20), (100, 1, 0)])
def test_lines_equal_loops(spark, monkeypatch, broadcast, least_docs, least_chars):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", broadcast)
    rows = [(None if i % 4 == 0 else i // 2, t, "x", i) for i, t in enumerate(LINE_TEXTS)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, kept string, h1 int").repartition(3), "docs")
    got = sorted((tuple(r) for r in lines.line_dedup(docs, least_docs=least_docs, least_chars=least_chars).collect()), key=str)
    want = [(r[0], *w) for r, w in zip(rows, plain_lines(LINE_TEXTS, least_docs, least_chars), strict=True)]
    assert got == sorted(want, key=str)


def test_lines_of_edge_rows_and_of_no_rows(edge_docs, no_docs):
    got = sorted((tuple(r) for r in lines.line_dedup(stored(edge_docs, "docs"), least_docs=2).collect()), key=str)
    rows = edge_docs.collect()
    assert got == sorted(((r.doc_id, *w) for r, w in zip(rows, plain_lines([r.text for r in rows], 2, 1), strict=True)), key=str)
    assert lines.line_dedup(no_docs).collect() == []


def test_a_line_repeated_in_one_document_counts_once(spark):
    docs = stored(spark.createDataFrame([(1, "a\n" * 20), (2, "b")], "doc_id long, text string"), "docs")
    assert {r.doc_id: r.n_dropped for r in lines.line_dedup(docs, least_docs=2).collect()} == {1: 0, 2: 0}


# manifests


def plain_tree(leaves, fanout):
    """Root and the proofs of all leaves, by whole levels."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    proofs = []
    for i in range(len(leaves)):
        out = []
        for level in levels[:-1]:
            first = i - i % fanout
            out += [h for j, h in enumerate(level[first : first + fanout]) if first + j != i]
            i //= fanout
        proofs.append("".join(out))
    return levels[-1][0], proofs


def plain_manifest(rows, fanout):
    """rows: (group, order, leaf). (group, order, leaf, subroot, root, proof) of each."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = plain_tree([r[2] for r in groups[g]], fanout)
    root, over = plain_tree([trees[g][0] for g in names], fanout) if names else (None, [])
    return [(*r, trees[g][0], root, p + over[k]) for k, g in enumerate(names) for r, p in zip(groups[g], trees[g][1], strict=True)]


@pytest.mark.parametrize("fanout, levels", [(2, 2), (8, 1), (3, 3)])
def test_manifest_equals_whole_trees(spark, fanout, levels):
    rows = [(None, 1, sha("lone")), ("lone", None, sha("l"))]
    for g, n in (("", 2), ("a", 9), ("B", 8), ("é", 65), ("hot", 300), ("漢", 3), ("three", 27)):
        rows += [(g, i if i % 6 else None, sha(f"{g}{i}")) for i in range(n)]
    rows += [("hot", 7, sha("same"))] * 12  # repeated rows
    leaves = stored(spark.createDataFrame([(*r, "x") for r in rows], "lang string, doc_id long, leaf string, extra string").repartition(4), "leaves")
    found = merkle.merkle_manifest(leaves, "lang", ["doc_id"], fanout=fanout, levels=levels)
    got = Counter((r.lang, r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found.collect())
    assert got == Counter(plain_manifest(rows, fanout))
    back = merkle.folded_roots(found, "leaf", fanout)
    assert back.where("folded_root <> root").count() == 0
    assert merkle.folded_roots(found.withColumn("other", F.sha2("leaf", 256)), "other", fanout).where("folded_root = root").count() == 0


def test_manifest_of_one_row_and_of_none(spark):
    leaves = spark.createDataFrame([(1 << 60, None, sha("x"))], "doc_id long, lang string, leaf string")
    row = merkle.merkle_manifest(stored(leaves, "l"), "lang", ["doc_id"]).collect()[0]
    assert (row.doc_id, row.subroot, row.root, row.proof) == (1 << 60, sha("x"), sha("x"), "")
    none = merkle.merkle_manifest(stored(leaves.limit(0), "l"), "lang", ["doc_id"])
    assert none.collect() == [] and "proof" in none.columns and merkle.folded_roots(none, "leaf").collect() == []
    with pytest.raises(ValueError):
        merkle.merkle_manifest(leaves.withColumn("root", F.lit(1)), "lang", ["doc_id"])


def test_large_ids_and_nulls_of_one_bucket_come_back_unchanged(spark):
    rows = [("a", None, sha("0")), ("a", (1 << 60) + 1, sha("1")), ("a", (1 << 60) + 3, sha("2"))]
    found = merkle.merkle_manifest(stored(spark.createDataFrame(rows, "lang string, doc_id long, leaf string"), "l"), "lang", ["doc_id"])
    assert {r.doc_id for r in found.collect()} == {r[1] for r in rows}


def test_leaf_of_values(spark):
    df = spark.createDataFrame([(1, None, "é\n", "")], "a long, b string, c string, d string").select(merkle.leaf_of([F.col(c) for c in "abcd"]).alias("h"))
    assert df.first().h == sha("1:1" + "-" + "3:é\n" + "0:")


@pytest.mark.parametrize("n, fanout, levels", [(1, 8, 0), (8, 8, 1), (9, 8, 2), (64, 8, 2), (20, 2, 5), (7, 3, 2)])
def test_a_bucket_collapses_as_a_tree(n, fanout, levels):
    nodes = [sha(str(i)) for i in range(n)]
    root, proofs = merkle.collapsed(nodes, levels, fanout)
    assert (root, proofs) == plain_tree(nodes, fanout) and merkle.depth_of(n, fanout) == levels
    assert all(merkle.folded(x, i, n, p, 0, fanout) == (root, len(p)) for i, (x, p) in enumerate(zip(nodes, proofs, strict=True)))


# tries


def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, inside in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under) for n in under)
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n)
        ends = ",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), len(kids), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def plain_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def plain_heads(convs, every=20, most=4):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = convs.get(c - c % every, [])[:h] + own[h:]
    return out


def conversations(spark, rows):
    return stored(spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, n int").repartition(4), "conversations")


def told(df):
    assert tuple(df.columns) == NODE and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


def hard_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.choice(["common", "any", "short", "tied"])
        for t in range(rng.randint(1, 6)):
            text = {"common": f"turn {t}", "any": rng.choice(["a", "a b", "", None, "c\td  e"]), "short": "x", "tied": rng.choice("ab")}[kind]
            rows.append((c, rng.choice([None, 1, t]) if kind == "tied" else t, rng.choice(["user", "user", None]) if kind == "any" else "user", text))
    return rows + [(None, 1, "user", "lost"), (None, None, None, None)] + rows[:5]


@pytest.mark.parametrize("heavy", [1024, 2])
def test_trie_equals_loops(spark, monkeypatch, heavy):
    monkeypatch.setattr(ranks, "HEAVY", heavy)
    rows = hard_rows(3, 60)
    convs = plain_order(rows)
    df = conversations(spark, rows)
    assert told(prefix_trie(numbered_turns(df))) == plain_trie(convs)
    if heavy > 2:
        assert told(prefix_trie(with_shared_heads(numbered_turns(df)))) == plain_trie(plain_heads(convs))


def test_trie_with_absent_heads_turnless_members_and_a_long_chain(spark):
    rows = [(c, 0, "user", "hi there") for c in (21, 22, 23, 24, 25, 39, 41)] + [(40, t, "user", f"w{t} w") for t in range(700)] + [(47, 0, "user", "w0 w"), (46, 3, "user", "z")]
    got = told(prefix_trie(with_shared_heads(numbered_turns(conversations(spark, rows)))))
    want = plain_heads(plain_order(rows))
    assert any(not t for t in want.values()) and got == plain_trie(want)


def test_equal_conversations_are_digested_in_pieces(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(5, 1305) for t in range(2)]
    got = told(prefix_trie(numbered_turns(conversations(spark, rows))))
    assert [g[3:5] for g in got] == [(1300, 1), (1300, 1), (1300, 0)]
    assert next(g[-1] for g in got if g[1] == 2) == sha(",".join(str(c) for c in range(5, 1305)))


def test_trie_of_one_conversation_and_of_none(spark):
    assert told(prefix_trie(numbered_turns(conversations(spark, [(-7, 1, "u", "a b")])))) == plain_trie({-7: [("u", "a b")]})
    empty = conversations(spark, [(1, 1, "u", "x")]).limit(0)
    assert told(prefix_trie(with_shared_heads(numbered_turns(stored(empty, "none"))))) == []
