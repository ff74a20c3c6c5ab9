"""Toxicity by a weighted finite-state pattern grammar.

Each word of a clause is a symbol: insult, threat, target, negation, report or other. Five small transducers
read the symbols: insults are told with their weight; a threat is told when a target follows soon; a
target, a negation and a reporting word change how later insults of the clause are told. Their composition
is one automaton whose states are reachable tuples of theirs. Run over a clause, it yields weights by kind:
plain, at a target, negated, reported, threat. The kinds' weights in a document's score are learned, with its
length, by logistic regression.

Insults and their weights come from labelled documents: words, and word beginnings (so that inflected
forms count), that occur in far more toxic documents than chance allows. Clauses without insult or threat are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.labelled import Logistic, held_out, training_sample
from loomgraph.llm.words import Words, range_hash, slices, words_of
from loomgraph.llm.words import _byte_values as byte_values
from loomgraph.llm.worker import tidy

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Fixed word lists of the grammar.
CUES = {
    THREAT: "kill killing murder hurt destroy burn beat stab shoot strangle töten umbringen schlagen verbrennen tuer frapper brûler détruire matar golpear quemar destruir",
    TARGET: "you your yours yourself he him his she her they them their people tu toi vous votre ton ta du dich dir dein ihr euch euer tú usted ustedes vosotros su sus",
    NEGATION: "not never no neither nor isn't aren't don't ne pas jamais non nicht nie kein keine nunca jamás tampoco",
    REPORT: "said says saying claimed called quoted wrote according dit disait écrit selon sagte schrieb laut dijo dice escribió según",
}
KINDS = ("plain", "targeted", "negated", "reported", "threat")
PREFIX_BYTES = (5, 6, 7, 8)
FEATURES = len(KINDS) + 6
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;:\n")] = True


@dataclass
class Transducer:
    """From a start state 0: (state, symbol) -> (state, told). What isn't listed keeps the state and tells nothing."""

    arcs: dict[tuple[int, int], tuple[int, str]]

    def step(self, state: int, symbol: int) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, ""))


def within(opens: int, tells: str, words: int) -> Transducer:
    """Tells `tells` for the next words after a symbol."""
    arcs = {(s, x): (max(s - 1, 0), tells if s else "") for s in range(words + 1) for x in range(6)}
    return Transducer(arcs | {(s, opens): (words, "") for s in range(words + 1)})


def until_end(opens: int, tells: str) -> Transducer:
    return Transducer({(0, opens): (1, "")} | {(1, x): (1, tells) for x in range(6)})


def threats(words: int) -> Transducer:
    arcs = {(s, x): (max(s - 1, 0), "threat" if s and x == TARGET else "") for s in range(words + 1) for x in range(6)}
    return Transducer(arcs | {(s, THREAT): (words, "") for s in range(words + 1)})


def compose(parts: list[Transducer]) -> tuple[list[list[int]], list[list[frozenset]]]:
    """Next state and what is told, by state and symbol, over the reachable tuples of states."""
    number, todo = {(0,) * len(parts): 0}, [(0,) * len(parts)]
    nexts, told = [], []
    for state in todo:
        nexts.append([])
        told.append([])
        for symbol in range(6):
            steps = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
            to = tuple(s for s, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            nexts[-1].append(number[to])
            told[-1].append(frozenset(t for _, t in steps if t))
    return nexts, told


GRAMMAR = compose([Transducer({(0, INSULT): (0, "insult")}), threats(4), until_end(TARGET, "target"), within(NEGATION, "negation", 3), until_end(REPORT, "report")])


def kind_of(told: frozenset) -> int:
    """The kind of a told insult or threat, -1 for none."""
    if "insult" in told:
        return 2 if "negation" in told else 3 if "report" in told else 1 if "target" in told else 0
    return 4 if "threat" in told else -1


_NEXT, _KIND = GRAMMAR[0], [[kind_of(t) for t in row] for row in GRAMMAR[1]]


def clause_weights(symbols: list[int], weights: list[float]) -> list[float]:
    out, state = [0.0] * len(KINDS), 0
    for s, w in zip(symbols, weights, strict=True):
        kind = _KIND[state][s]
        if kind >= 0:
            out[kind] += w if kind != 4 else 3.0
        state = _NEXT[state][s]
    return out


def word_slices(text: pa.Array):
    for at in range(0, len(text), 1024):  # lower-cased a part at a time
        for row, to, buf, off in slices(pc.utf8_lower(text.slice(at, 1024).cast(pa.large_string()).fill_null(""))):
            yield at + row, at + to, words_of(buf, off, _SEPARATOR)


def _named(words: list[str]) -> np.ndarray:
    return np.concatenate([w.hashes() for _, _, w in word_slices(pa.array(words))]) if words else np.zeros(0, np.uint64)


def beginnings(words: Words, n: int) -> np.ndarray:
    """Hash of the first n bytes of each word, 0 where the word is no longer than that."""
    ok = words.end - words.start > n
    out = np.zeros(len(ok), np.uint64)
    out[ok] = range_hash(byte_values(False, 0)[words.buf], words.start[ok], words.start[ok] + n)
    return out


class Lexicon:
    """Weights of words and beginnings, learned from documents with labels."""

    def __init__(self, texts: list[str], y: np.ndarray):
        seen = [self._documents(texts, n) for n in (0, *PREFIX_BYTES)]
        n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
        tables = []
        for doc, h in seen:
            names, at = np.unique(h, return_inverse=True)
            c1 = np.bincount(at, y[doc], len(names))
            c0 = np.bincount(at, 1 - y[doc], len(names))
            weight = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
            # chance of so many toxic documents, against their share of all
            share = n1 / (n1 + n0)
            p = np.clip(c1 / np.maximum(c1 + c0, 1), 1e-6, 1 - 1e-6)
            g = 2 * (c1 * np.log(p / share) + c0 * np.log((1 - p) / (1 - share)))
            tables.append((names, weight, (c1 >= 3) & (g >= 12) & (weight >= 1.5), c1 + c0))
        self.words = self._kept(tables[0])
        self.prefixes = [self._kept(t) for t in tables[1:]]
        names, weight, strong, count = tables[0]
        self.innocent = names[~strong & (count >= 4) & (weight < 1)]
        cue = [(h, kind) for kind, words in CUES.items() for h in _named(words.split())]
        order = np.argsort(np.array([h for h, _ in cue], np.uint64))
        self.cue, self.cue_kind = np.array([cue[i][0] for i in order], np.uint64), np.array([cue[i][1] for i in order], np.int64)

    @staticmethod
    def _documents(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, word or beginning of n bytes)."""
        docs, names = [], []
        for row, _, w in word_slices(pa.array(texts, pa.string())):
            h, d = (w.hashes() if not n else beginnings(w, n)), w.doc_of()
            pair = np.unique(np.stack([d.astype(np.uint64), h], 1)[h != 0], axis=0) if len(h) else np.zeros((0, 2), np.uint64)
            docs.append(pair[:, 0].astype(np.int64) + row)
            names.append(pair[:, 1])
        return (np.concatenate(docs), np.concatenate(names)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    @staticmethod
    def _kept(table) -> tuple[np.ndarray, np.ndarray]:
        names, weight, strong, _ = table
        return names[strong], weight[strong]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        names, weight = table
        if not len(names):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        return np.where(names[at] == h, weight[at], 0.0)

    def insults(self, words: Words, h: np.ndarray) -> np.ndarray:
        """The weight of each word; a beginning counts for words that weren't often seen to be harmless."""
        weight = self._look(self.words, h)
        for n, table in zip(PREFIX_BYTES, self.prefixes, strict=True):
            if len(table[0]):
                more = self._look(table, beginnings(words, n))
                hit = np.flatnonzero((more > weight) & (weight == 0))
                if len(hit):
                    known = np.isin(h[hit], self.innocent)
                    weight[hit[~known]] = 0.7 * more[hit[~known]]
        return weight

    def symbols(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        h = words.hashes()
        weight = self.insults(words, h)
        at = np.minimum(np.searchsorted(self.cue, h), len(self.cue) - 1)
        kind = np.where(self.cue[at] == h, self.cue_kind[at], OTHER)
        return np.where(weight > 0, INSULT, kind), weight


def features(words: Words, lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((words.n_docs, FEATURES))
    n = words.counts().astype(np.float64)
    out[:, -1] = np.log1p(n)
    if not len(words.start):
        return out
    symbol, weight = lexicon.symbols(words)
    ends = np.concatenate([[0], np.cumsum(_ENDS[words.buf])])
    clause = ends[words.start]
    doc = words.doc_of()
    cut = np.flatnonzero(np.concatenate([[True], (clause[1:] != clause[:-1]) | (doc[1:] != doc[:-1])]))
    bounds = np.append(cut, len(clause))
    of = np.repeat(np.arange(len(cut)), np.diff(bounds))
    k = len(KINDS)
    for c in np.unique(of[(symbol == INSULT) | (symbol == THREAT)]).tolist():
        a, b = int(bounds[c]), int(bounds[c + 1])
        told = clause_weights(symbol[a:b].tolist(), weight[a:b].tolist())
        d = doc[a]
        out[d, :k] += told
        out[d, k] = max(out[d, k], sum(told))
        out[d, k + 1] += sum(told) > 0
    total = out[:, :k].sum(1)
    out[:, k + 2] = total / np.sqrt(n + 1)
    out[:, k + 3] = np.minimum(total / (n + 1) * 20, 5)
    out[:, :k] = np.log1p(out[:, :k])
    out[:, k + 1] = np.log1p(out[:, k + 1])
    out[:, k + 4] = total > 0
    return out


class Grammar:
    """A fitted lexicon and the weights of the kinds."""

    def __init__(self, texts: list[str], y: np.ndarray, ids: np.ndarray):
        # weights of the kinds are learned where the lexicon didn't see the labels
        fold = (ids // 4) % 3
        x = np.zeros((len(texts), FEATURES))
        for f in range(3):
            rest = [i for i in range(len(texts)) if fold[i] != f]
            own = np.flatnonzero(fold == f)
            part = Lexicon([texts[i] for i in rest], y[rest])
            x[own] = features_of([texts[i] for i in own], part)
        self.lexicon = Lexicon(texts, y)
        self.model = Logistic(x, y)

    def scores(self, text: pa.Array) -> np.ndarray:
        out = np.zeros(len(text))
        for row, to, words in word_slices(text):
            out[row:to] = self.model(features(words, self.lexicon))
        return out


def features_of(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    parts = [features(w, lexicon) for _, _, w in word_slices(pa.array(texts, pa.string()))]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    return Grammar(*training_sample(docs, labels, "toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """All columns of docs but those it adds, with held_out, score (0 to 1) and predicted (score >= threshold).

    Learns from at most MOST_LABELLED labelled rows that aren't held out; without any, every score is the same.
    Null and empty texts are scored as texts of no words. Repeated rows and null ids are rows like any others.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.drop("held_out", "score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.scores(b.column("text")))], [*b.schema.names, "score"])

    scored = rows.mapInArrow(tidy(run), schema)
    return scored.select("*", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.scores(b.column("text")) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
