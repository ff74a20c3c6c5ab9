"""Personal data by candidate spans and gradient-boosted trees.

Strict patterns with their checks (octets, Luhn, digit counts) give the base spans, which always stay. Loose
generators propose more: addresses written with "at" and "dot", numbers with other separators or without
the plus sign, spans that overlap one another. Boosted trees judge each proposal by its form (digits,
separators, groups, checks) and by the words before and behind it; thresholds are calibrated, kind by kind, on
examples the trees were not fitted to. Accepted spans that overlap no base span and no better span are added.

No table labels personal data, so the trees learn from generated examples of both classes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.boosting import BoostedTrees, calibrated_threshold
from loomgraph.llm.words import slices
from loomgraph.llm.worker import tidy

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# where a run of digits begins no address, no later digit of it does; so runs are read once and whole
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
#: Fixed: what may stand for @, for a dot, and the parts of a domain.
_AT = re.compile(r"@|\(at\)|\[at\]|(?<![A-Za-z0-9_])at(?![A-Za-z0-9_])", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_DOT = re.compile(r" ?(?:\.|\(dot\)|\[dot\]|(?<![A-Za-z0-9_-])dot(?![A-Za-z0-9_-])) ?[A-Za-z0-9-]++", re.IGNORECASE)
#: Fixed loose patterns of the proposals, each of bounded length.
LOOSE = (
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ./_-]{1,3}[0-9]{3,6}){2,5}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,8}\)?(?:[ ./-]{1,2}\(?[0-9]{2,8}\)?){1,5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00|0)[0-9]{8,13}(?![0-9])")),
    ("phone", re.compile(r"\+ ?[0-9](?:[ ()./-]*[0-9]){6,14}(?![0-9])")),
)
#: Fixed context words.
CONTEXT = {
    "email": "email mail e-mail correo courriel contact write address adresse",
    "ip": "ip host server address login client adresse",
    "card": "card visa mastercard credit carte tarjeta karte payment kreditkarte",
    "phone": "phone call tel telephone mobile fax cell teléfono téléphone telefon anruf whatsapp",
    "other": "version order invoice isbn page pages total sum section chapter figure table date year id no number ref token price room",
}
WANTED_PRECISION = 0.98
#: Fixed: first digits and lengths of card numbers.
_ISSUED = re.compile("4[0-9]{12}|3[47][0-9]{13}|3[068][0-9]{12}|[3-6][0-9]{15,18}")
#: Fixed: frequent endings of domains.
_ENDINGS = frozenset("com net org de fr es info io eu uk edu gov".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _runs(text: str, letters: re.Pattern = _LOCAL) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of some letters."""
    spans = [m.span() for m in letters.finditer(text)]
    return [x for x, _ in spans], [y for _, y in spans]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, but looking from each @ at the run of letters before it."""
    at = text.find("@")
    if at < 0:
        return
    begins, ends = _runs(text)
    done = 0
    while at >= 0:
        k = bisect_left(ends, at)
        m = EMAIL.match(text, max(begins[k], done)) if k < len(ends) and ends[k] == at and done < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans that may be addresses, spelt out or not: letters, what stands for @, and parts of a domain between what stands for dots."""
    anchors = list(_AT.finditer(text))
    if not anchors:
        return
    begins, ends = _runs(text)
    label_begins, label_ends = _runs(text, _LABEL)
    done = 0
    for m in anchors:
        if m.start() < done:
            continue
        before, behind = m.start() - (text[m.start() - 1 : m.start()] == " "), m.end() + (text[m.end() : m.end() + 1] == " ")
        k, n = bisect_left(begins, before) - 1, bisect_right(label_begins, behind) - 1
        if k < 0 or ends[k] < before or max(begins[k], done) >= before or n < 0 or label_ends[n] <= behind:
            continue
        end, more = label_ends[n], _DOT.match(text, label_ends[n])
        while more:
            end, more = more.end(), _DOT.match(text, more.end())
        if end > label_ends[n]:
            yield max(begins[k], done), end
            done = end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order: leftmost matches of each kind that don't overlap; those that fail their check are dropped."""
    out = [(0, *s) for s in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 80 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    s = text[start:end]
    d = _digits(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, start - 40) : start].lower())[-4:]
    behind = re.findall(r"[^\W\d_][\w-]*", text[end : end + 40].lower())[:3]
    near = [float(any(w in _CONTEXT[k] for w in words)) for words in (before, behind) for k in ("email", "ip", "card", "phone", "other")]
    parts = [int(g) for g in re.findall("[0-9]{1,6}", s)]
    return [
        kind, len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0), float(len(set(groups)) == 1),
        s.count(" "), s.count("-"), s.count("."), s.count("("), s.count("/"), float(s[:1] == "+"), float(d[:1] == "0"),
        float(bool(d) and luhn(d)), float(bool(parts) and max(parts) <= 255), float("@" in s), float(bool(re.search(r"(?i)[\[(]at[\])]", s))),
        float(bool(re.search(r"(?i)[\[(]dot[\])]", s))), float(bool(re.search(r"(?i)\bat\b.*\bdot\b", s))), float(len(re.findall("[A-Za-z]{2,}", s))),
        float(bool(d[:4]) and 1900 <= int(d[:4] or 0) <= 2099), float(text[start - 1 : start].isalnum()), float(text[end : end + 1].isalnum()), float(d[:1] in ("3", "4", "5", "6") and bool(d)), float(d[:2] == "00"), float(bool(_ISSUED.fullmatch(d)) and luhn(d)), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(s.rstrip().rsplit(" ", 1)[-1].rsplit(".", 1)[-1].lower() in _ENDINGS), s.count("\n"), *near,
    ]


_CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}


def proposals(text: str) -> list[tuple[int, int, int]]:
    return [(0, *s) for s in _addresses(text)] + [(KINDS.index(kind), *m.span()) for kind, p in LOOSE for m in p.finditer(text)]


class Spans:
    """Spans of which no two overlap, in order."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def meets(self, begin: int, end: int) -> bool:
        k = bisect_left(self.begins, end) - 1
        return k >= 0 and self.ends[k] > begin

    def add(self, begin: int, end: int) -> None:
        k = bisect_left(self.begins, begin)
        self.begins.insert(k, begin)
        self.ends.insert(k, end)


def merged_spans(spans: list[tuple[int, int, int]]) -> Spans:
    """What (kind, begin, end) spans cover together."""
    out = Spans()
    for _, begin, end in sorted(spans, key=lambda s: s[1:]):
        if out.ends and begin < out.ends[-1]:
            out.ends[-1] = max(out.ends[-1], end)
        else:
            out.begins.append(begin)
            out.ends.append(end)
    return out


def generated_examples(seed: int = 17, n: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of proposals in made-up sentences: half hold a personal datum in some spelling, half
    a look-alike (versions, sums, dates, order numbers, decimals, hours, plain sentences with "at" and "dot")."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda k: "".join(str(int(c)) for c in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghiklmnoprstuvw") for _ in range(int(rng.integers(2, 9))))

    def card() -> str:
        """Of 13 to 19 digits, in groups of four, or as those of 14 and 15 digits are printed."""
        n = pick([16, 16, 16, 16, 15, 15, 13, 14, 19])
        head = {15: pick(["34", "37"]), 14: pick(["30", "36", "38"]), 13: "4"}.get(n) or pick("3456")
        head += number(n - 1 - len(head))
        full = next(head + c for c in "0123456789" if luhn(head + c))
        sep, cuts = pick([" ", "-", ".", "/", "  ", "_", ""]), [0, 4, 10, n] if n in (14, 15) else [*range(0, n, 4), n]
        return sep.join(full[i:j] for i, j in zip(cuts, cuts[1:], strict=False))

    def phone() -> str:
        sep = pick([" ", "-", ".", "/"])
        body = sep.join(number(k) for k in pick([(3, 3, 4), (3, 4), (4, 6), (2, 2, 2, 2), (3, 3, 3), (7,), (6,), (8,), (4, 4)]))
        return pick([f"({number(3)}) {body}", f"0{number(2)}{sep}{body}", f"0{number(int(rng.integers(2, 5)))}{sep}{body}", f"00{number(int(rng.integers(9, 13)))}", f"00{number(2)}{sep}{number(2)}{sep}{body}", f"+ {number(2)} {body}",
                     f"({number(3)}) 555-{number(4)}", f"0{number(9)}", f"{number(3)}{sep}{number(3)}{sep}{number(4)}", f"0{number(1)}{sep}{number(2)}{sep}{number(2)}{sep}{number(2)}{sep}{number(2)}"])

    def email() -> str:
        at, dot = pick([(" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("@", " . "), (" @ ", ".")])
        return f"{word()}{pick(['', '.' + word(), number(2)])}{at}{word()}{dot}{pick(['com', 'net', 'org', 'de', 'fr', 'es'])}"

    def ip() -> str:
        return pick([".", "[.]", " . ", "(.)"]).join(str(int(x)) for x in rng.integers(1, 256, 4))

    def other() -> str:
        return pick([
            f"{number(1)}.{number(1)}.{number(2)}.{number(3)}9", f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/19{number(2)}", f"{number(3)} {number(3)} {number(3)}", f"{number(16)}", f"{number(13)}",
            f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(2)}.{number(2)}.20{number(2)}", f"{number(3)}-{number(3)}", f"{number(4)} {number(4)} {number(4)} {number(4)}", f"{number(2)}:{number(2)} {number(3)} {number(2)}",
            f"meet {word()} at {word()} dot {word()}", f"look at {word()} dot {pick(['com', 'net'])} {word()}", f"{word()} at the dot {word()} {word()}", f"{number(5)} {number(5)}", f"{number(6)}-{number(6)}", f"{number(15)}", f"{number(14)}", f"{word()} at {word()} . {word().title()}", f"{number(2)} {number(2)} {number(2)}", f"300.{number(3)}.{number(3)}.999", f"{number(4)}-{number(4)}",
        ])

    x, y = [], []
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    for _ in range(n):
        kind = pick([*KINDS, None, None, None, None])
        said = makers[kind]() if kind else other()
        told = lambda share: pick(CONTEXT[kind or "other"].split()) if rng.random() < share else word()  # noqa: B023, E731
        lead = f"{word()} {told(0.4)} "
        text = f"{lead}{said} {told(0.15)}{pick([', ', ' '])}{word()}."
        lo, hi = len(lead), len(lead) + len(said)
        for k, a, b in proposals(text):
            x.append(features(text, k, a, b))
            y.append(float(kind == KINDS[k] and a <= lo + 1 and b >= hi and b - a <= hi - lo + 2))
    return np.array(x), np.array(y)


class Judge:
    """Fitted trees and a threshold for each kind."""

    def __init__(self):
        x, y = generated_examples()
        self.trees = BoostedTrees().fit(x, y)
        vx, vy = generated_examples(seed=18, n=2000)
        p = self.trees.probability(vx)
        self.thresholds = [calibrated_threshold(p[vx[:, 0] == k], vy[vx[:, 0] == k], WANTED_PRECISION) for k in range(len(KINDS))]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        covered = merged_spans(base)
        found = [c for c in set(proposals(text)) if not covered.meets(c[1], c[2])]
        if not found:
            return []
        found.sort()
        p = self.trees.probability(np.array([features(text, *c) for c in found]))
        out, taken = [], Spans()
        for q, c in sorted(zip(p.tolist(), found, strict=True), key=lambda r: (-r[0], r[1][1] - r[1][2], r[1])):
            if q >= self.thresholds[c[0]] and not taken.meets(c[1], c[2]):
                out.append(c)
                taken.add(c[1], c[2])
        return out


@lru_cache(1)
def judge() -> Judge:
    """Fitted once, by the driver; tasks get it broadcast."""
    return Judge()


_HINT = np.zeros(256, bool)
_HINT[list(b"@0123456789")] = True


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base and spans (all), each
    a list of kind:start:end by kind, then start, joined by commas, in code points with the end exclusive.

    A null text is empty and has no spans. Repeated rows and null ids are rows like any others. Extra columns are not read.
    """
    rows = docs.select(docs[id_col], docs[text_col].alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in KINDS), "base", "spans"]
    shared = docs.sparkSession.sparkContext.broadcast(judge())

    def run(batches):
        for b in batches:
            counts, base, spans = np.zeros((b.num_rows, len(KINDS)), np.int64), [""] * b.num_rows, [""] * b.num_rows
            text = b.column("text")
            for row, to, buf, off in slices(text):
                # only texts with a digit or an @, or where "at" may stand for one, can hold a span
                hint = np.concatenate([[0], np.cumsum(_HINT[buf])])
                some = (hint[off[1:]] - hint[off[:-1]]) > 0
                for i in range(to - row):
                    whole = text[row + i].as_py() or ""
                    if not some[i] and not _AT.search(whole):
                        continue
                    found = base_spans(whole) if some[i] else []
                    for k, _, _ in found:
                        counts[row + i, k] += 1
                    base[row + i] = listed(found)
                    spans[row + i] = listed(found + shared.value.added(whole, found))
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(base, pa.string()), pa.array(spans, pa.string())], names)

    return rows.mapInArrow(tidy(run), f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
