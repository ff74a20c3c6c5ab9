"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: the texts between block-level tags. Each block is read as the
sum of learned vectors of its tag path (names, classes and ids, hashed), the mean of learned vectors of its hashed words, and a
few counts. A bidirectional LSTM, in numpy, runs over the whole sequence, so that each block is judged in
the light of the document around it; blocks that score at least one half are the main text.

No table labels blocks, so the labeller learns from generated pages, in which each block's part is known.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.words import column_words
from loomgraph.llm.worker import tidy

#: Fixed tag lists.
BLOCK_TAGS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 article section main nav header footer aside form table thead tbody tfoot tr td th blockquote pre figure figcaption dl dt dd body html head title fieldset address details summary hr select option button label legend center menu dialog caption".split())
VOID_TAGS = frozenset("br img hr input meta link area base col embed source track wbr".split())
CLOSED_BY = {"p": BLOCK_TAGS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": BLOCK_TAGS}
#: Fixed: what may stand in a page's head, elements whose content isn't read as markup, and those of them that
#: mean something only with an end tag.
HEAD_TAGS = frozenset("head title base link meta script style noscript template".split())
RAW_TAGS = frozenset("title script style noscript template svg iframe textarea".split())
NEEDS_END = frozenset("title noscript template svg".split())
_RAW_END = {t: re.compile(rf"</{t}(?![a-z0-9])[^>]*>", re.IGNORECASE) for t in RAW_TAGS}
# nothing is ever given back, so a tag is read in one pass; a quote that never closes is a letter of its tag
_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.IGNORECASE)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: Elements whose text isn't the page's; open elements that a path names at each end, and that an end tag looks through.
HIDING = frozenset("head title select".split())
PATH_ENDS, DEEPEST = 32, 512
BUCKETS, PATH_DIM, WORD_DIM, COUNTS, HIDDEN = 1024, 12, 8, 6, 16
INPUT = PATH_DIM + WORD_DIM + COUNTS
GROUP = 64
#: Generated pages and passes over them.
TRAIN_PAGES, EPOCHS = 1000, 12


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, '/' of an end tag, name, attributes) of each tag, in one pass over the page; a last one without
    a name for the text behind. Comments and raw elements are left out with their content; they end the text before them with an empty name, too.

    A comment, script, style or frame that never ends takes the rest, as in browsers; another raw element without an end does not."""
    done, at, unended = 0, page.find("<"), set()
    while at >= 0:
        end, name = -1, ""
        if page.startswith("<!--", at):
            close = page.find("-->", at + 2)
            end = close + 3 if close >= 0 else len(page)
        elif page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            end = close + 1 if close >= 0 else -1
        else:
            m = _TAG.match(page, at)
            if m:
                name, end = m[2].lower(), m.end()
                if name in RAW_TAGS and not m[1]:
                    if not m[3].endswith("/") or name != "svg":
                        last = None if name in unended else _RAW_END[name].search(page, end)
                        if last:
                            end = last.end()
                        elif name in NEEDS_END:
                            unended.add(name)
                        else:
                            end = len(page)
                        name = name if name == "title" and not last else ""
                    else:
                        name = ""
            elif page.find(">", at) < 0:
                break
        if end < 0:
            at = page.find("<", at + 1)
            continue
        yield page[done:at], m[1] if name else "", name, m[3] if name else ""
        done, at = end, page.find("<", end)
    yield page[done:], "", "", ""


def _closes(top: str, name: str) -> bool:
    """Whether the start of element `name` ends the open element `top`, whose own end tag may be missing."""
    if top == "head":
        return name not in HEAD_TAGS
    if top == "title":
        return True
    if top == "select":
        return name in BLOCK_TAGS and name not in ("option", "hr")
    return name in CLOSED_BY.get(top, ())


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of the text in links) of each leaf block with text, in page order.

    The path names all open elements, or the outermost and innermost PATH_ENDS of a deeper nest."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, in_link, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                near = stack if len(stack) <= 2 * PATH_ENDS else stack[:PATH_ENDS] + stack[-PATH_ENDS:]
                out.append((tuple(n for _, names in near for n in names), text, min(1.0, linked / max(len(text), 1))))
            pieces.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal hidden
        hidden -= sum(name in HIDING for name, _ in stack[i:])
        del stack[i:]

    def add(text: str) -> None:
        nonlocal linked
        if hidden and stack[-1][0] == "head" and text.strip():  # text has no place in a head, so its end was left out
            close(len(stack) - 1)
        if not hidden:
            pieces.append(text)
            linked += len(text) if in_link else 0

    for text, end, name, attributes in tokens(page):
        if text:
            add(text)
        if not name:
            pieces.append(" " if pieces else "")
            continue
        block = name in BLOCK_TAGS
        if block:
            flush()
        elif name == "br":
            pieces.append(" ")
        if end:
            if name == "a":
                in_link = 0
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name == "a":
            in_link = 1
        while stack and _closes(stack[-1][0], name):
            close(len(stack) - 1)
        if name in VOID_TAGS:
            continue
        names = (name,)
        if "=" in attributes:
            for a in _NAMES.findall(attributes):
                names += tuple("." + w.lower() for w in re.split(r"[\s_-]+", a[0] or a[1] or a[2]) if w)
        if block or name in ("a", "span"):
            stack.append((name, names if block else names[1:]))
            hidden += name in HIDING
    flush()
    return out


def _hashed(s: str) -> int:
    h = 2166136261
    for c in s.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % BUCKETS


hashed_name = lru_cache(1 << 16)(_hashed)


class Inputs:
    """Blocks of many pages as arrays: path and word buckets with the block of each, counts, first block of each page."""

    def __init__(self, pages: list[list]):
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
        blocks = [b for p in pages for b in p]
        n = len(blocks)
        self.path = np.array([hashed_name(x) for b in blocks for x in b[0]], np.int64)
        self.path_of = np.repeat(np.arange(n), [len(b[0]) for b in blocks]).astype(np.int64)
        word, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, _, w in column_words(pa.array([b[1] for b in blocks], pa.string())):
            word.append((w.hashes(lower=True) % np.uint64(BUCKETS)).astype(np.int64))
            of.append(w.doc_of() + row)
        self.word, self.word_of = np.concatenate(word), np.concatenate(of)
        self.n_words = np.bincount(self.word_of, minlength=n).astype(np.float64)
        size = np.array([len(b[1]) for b in blocks], np.float64)
        ends = np.array([b[1][-1:] in ".!?…:;" for b in blocks], np.float64)
        page = np.repeat(np.arange(len(pages)), np.diff(self.first))
        place = (np.arange(n) - self.first[page]) / np.maximum(np.diff(self.first)[page] - 1, 1) if n else size
        self.counts = np.stack([np.log1p(size) / 6, np.array([b[2] for b in blocks], np.float64), ends, np.minimum(self.n_words, 40) / 40, place, np.array([b[1].count(",") for b in blocks], np.float64) / (self.n_words + 1)], 1) if n else np.zeros((0, COUNTS))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.p = {"path": rng.normal(0, 0.3, (BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.3, (BUCKETS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "c": np.zeros(1)}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 1 / np.sqrt(INPUT + HIDDEN), (INPUT + HIDDEN, 4 * HIDDEN))
            self.p["b" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def vectors(self, x: Inputs) -> np.ndarray:
        n = len(x.counts)
        path, word = np.zeros((n, PATH_DIM)), np.zeros((n, WORD_DIM))
        for out, table, bucket, of in ((path, self.p["path"], x.path, x.path_of), (word, self.p["word"], x.word, x.word_of)):
            if len(of):  # rows of a block stand together
                begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[of[begin]] = np.add.reduceat(table[bucket], begin)
        return np.concatenate([path, word / np.maximum(x.n_words, 1)[:, None], x.counts], 1)

    def _run(self, v: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """v: steps x pages x INPUT, padded; mask: steps x pages."""
        w, bias = self.p["w" + d], self.p["b" + d]
        steps, pages, _ = v.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, saved = np.zeros((steps, pages, HIDDEN)), []
        fed = v @ w[:INPUT] + bias
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = fed[t] + h @ w[INPUT:]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            tc = np.tanh(new_c)
            new_h = np.where(m, o * tc, h)
            if keep:
                saved.append((t, h, c, i, f, o, g, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out, saved

    @staticmethod
    def _padded(v: np.ndarray, first: np.ndarray, pages: np.ndarray):
        n = np.diff(first)[pages]
        steps = int(n.max()) if len(n) else 0
        at = first[pages][None, :] + np.arange(steps)[:, None]
        mask = np.arange(steps)[:, None] < n[None, :]
        return np.where(mask, at, 0), mask

    def scores(self, x: Inputs) -> np.ndarray:
        """One probability for each block. Pages of like length run together."""
        v, out = self.vectors(x), np.zeros(len(x.counts))
        order = np.argsort(np.diff(x.first), kind="stable")
        order = order[np.diff(x.first)[order] > 0]
        for a in range(0, len(order), GROUP):
            at, mask = self._padded(v, x.first, order[a : a + GROUP])
            both = np.concatenate([self._run(v[at], mask, d, False)[0] for d in "fb"], 2)
            out[at[mask]] = _sigmoid(both @ self.p["out"] + self.p["c"])[mask]
        return out

    def gradients(self, x: Inputs, y: np.ndarray, pages: np.ndarray) -> dict[str, np.ndarray]:
        at, mask = self._padded(None, x.first, pages)
        v = self.vectors(x)
        grown = {k: np.zeros_like(p) for k, p in self.p.items()}
        runs = {d: self._run(v[at], mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        err = np.where(mask, _sigmoid(both @ self.p["out"] + self.p["c"]) - y[at], 0) / mask.sum()
        grown["out"] = np.einsum("tph,tp->h", both, err)
        grown["c"] = np.array([err.sum()])
        dv = np.zeros(at.shape + (INPUT,))
        for k, d in enumerate("fb"):
            w = self.p["w" + d]
            d_out = err[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
            for t, h, c, i, f, o, g, tc, m in reversed(runs[d][1]):
                dh = dh + d_out[t]
                live = np.where(m, dh, 0)
                dct = np.where(m, dc, 0) + live * o * (1 - tc**2)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g**2)], 1)
                grown["w" + d][:INPUT] += v[at[t]].T @ dz
                grown["w" + d][INPUT:] += h.T @ dz
                grown["b" + d] += dz.sum(0)
                dv[t] += dz @ w[:INPUT].T
                dh = np.where(m, 0, dh) + dz @ w[INPUT:].T
                dc = np.where(m, dct * f, dc)
        flat = np.zeros_like(v)
        flat[at[mask]] = dv[mask]
        np.add.at(grown["path"], x.path, flat[x.path_of, :PATH_DIM])
        np.add.at(grown["word"], x.word, flat[x.word_of, PATH_DIM : PATH_DIM + WORD_DIM] / x.n_words[x.word_of][:, None])
        return grown

    def train(self, pages: list[list], labels: list[list[int]], epochs: int = EPOCHS, seed: int = 4) -> BlockLabeller:
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        batches = [np.sort(b) for b in np.array_split(np.arange(len(pages)), max(1, len(pages) // 24))]
        made = [(Inputs([pages[i] for i in b]), np.array([y for i in b for y in labels[i]], np.float64), np.arange(len(b))) for b in batches]
        for _ in range(epochs):
            for k in rng.permutation(len(made)):
                step += 1
                for name, g in self.gradients(*made[k]).items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.01 * (g * g - v[name])
                    self.p[name] -= 0.02 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return self


#: Fixed words of the generated pages' furniture.
FURNITURE = "home about contact login register search menu cookie cookies privacy policy terms subscribe newsletter share follow comments reply related popular copyright rights reserved advertisement sponsored accept settings more next previous back top tags categories archive sign password email submit suche kontakt impressum datenschutz accueil recherche mentions légales inicio buscar aviso legal".split()


def generated_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and, for each of its blocks with text, whether it is main text."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = "the an er in on re ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce ö é ó ñ ß è ü".split()
    furniture = 0.5 if chance(0.6) else 0.05
    labels: list[int] = []

    def words(lo: int, hi: int, known: float) -> str:
        n = int(rng.integers(lo, hi + 1))
        return " ".join(pick(FURNITURE) if chance(known) else "".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(n))

    def prose() -> str:
        out = []
        short = chance(0.2)
        for _ in range(1 if short else int(rng.integers(1, 6))):
            s = words(1, 2 if short else 25, 0.0)
            out.append(s[:1].upper() + s[1:] + pick([".", ".", ".", "?", ""]))
        text = " ".join(out)
        if chance(0.15):
            text = " ".join(w + pick(["***", "%%%", " |", "!!", "&amp;"]) for w in text.split())
        if chance(0.2):
            w = text.split(" ")
            i = int(rng.integers(len(w)))
            w[i] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "{}<br>"]).format(w[i])
            text = " ".join(w)
        return text

    def block(tag: str, text: str, main: int, attributes: str = "") -> str:
        labels.append(main)
        return f"<{tag}{attributes}>{text}</{tag}>"

    def menu(tag: str) -> str:
        """Links side by side in one block."""
        between, case = pick(["", "", " | ", " &middot; ", "<br>", " "]), pick([str.title, str.title, str.lower])
        return block(tag, between.join(f'<a href="/{words(1, 1, 0)}">{case(words(1, pick([1, 2]), furniture))}</a>' for _ in range(pick([2, 2, 2, 3, 4, 5, 6, 7]))), 0, pick(["", "", " width=150", ' class="menu"', " valign=top"]))

    def links(main: int = 0) -> str:
        if not main and chance(0.15):
            return menu(pick(["div", "p"]))
        if not main and chance(0.15):  # a menu within a menu
            head = f'<a href="/{words(1, 1, 0)}">{words(1, 2, furniture)}</a>'
            labels.append(0)
            return f"<ul><li>{head}<ul>" + "".join(block("li", f'<a href="/x">{words(1, 3, furniture)}</a>', 0) for _ in range(int(rng.integers(1, 5)))) + "</ul></li></ul>"
        tag = pick(["li", "li", "div", "p"])
        inner = "".join(block(tag, f'<a href="/{words(1, 1, 0)}">{words(1, 3, furniture)}</a>', main) for _ in range(int(rng.integers(2, 9))))
        return f"<ul>{inner}</ul>" if tag == "li" else inner

    def body() -> str:
        out = [block(pick(["h1", "h1", "h2"]), words(1, 12, 0), 1)] if chance(0.85) else []
        for _ in range(int(rng.integers(1, 16))):
            kind = rng.random()
            if kind < 0.72:
                text = prose()
                if chance(0.15):  # unclosed, as pages have it
                    labels.append(1)
                    out.append(f"<p><b>{text}<br>" if chance(0.5) else f"<p>{text}")
                    if chance(0.5):
                        out.append("<p>" + text)
                        labels.append(1)
                    continue
                out.append(block(pick(["p", "p", "p", "div"]), text, 1))
            elif kind < 0.8:
                out.append(block(pick(["h2", "h3"]), words(1, 8, 0), 1))
            elif kind < 0.87:
                out.append("<ul>" + "".join(block("li", prose() if chance(0.5) else words(1, 6, 0), 1) for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif kind < 0.92:
                out.append("<blockquote>" + block("p", prose(), 1) + "</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(block("td", words(1, 3, 0), 1) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(f'<div class="{pick(["ad", "ads", "advert", "banner", "promo"])}">' + block("p", prose(), 0) + "</div>" if chance(0.5) else block("div", prose(), 0, f' class="{pick(["ad", "advert", "sponsored"])}"'))
        return "".join(out)

    def side(kind: str) -> str:
        name = pick({"nav": ["menu", "nav", "navbar", "navigation"], "header": ["header", "masthead", "top"], "footer": ["footer", "bottom", "site-footer"], "aside": ["sidebar", "related", "widget", "side"], "ad": ["ad", "ads", "advert", "sponsor", "banner"], "notice": ["cookie", "notice", "consent", "banner", "alert"], "form": ["login", "newsletter", "search", "subscribe", "form"], "comments": ["comments", "comment-list", "replies", "discussion"]}[kind])
        tag = pick({"nav": ["nav", "nav", "div"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "div"], "form": ["form", "form", "div"], "comments": ["section", "div"]}.get(kind, ["div", "div", "section"]))
        named = f' {pick(["class", "class", "id"])}="{name}"' if tag in ("div", "section") or chance(0.3) else ""
        if kind in ("nav",):
            inner = links()
        elif kind == "header":
            inner = block(pick(["div", "p", "h1", "h2"]), words(1, 4, 0.2), 0) + (links() if chance(0.5) else "")
        elif kind == "footer":
            text = pick(["&copy; ", "© ", ""]) + words(1, 4, furniture) + pick([" &middot; ", " | ", ". "]) + (prose() if chance(0.5) else words(1, 6, furniture))
            if chance(0.5):
                labels.append(0)
                return f"<{tag}{named}>{text}</{tag}>"
            inner = block("p", text, 0) + (links() if chance(0.4) else "")
        elif kind == "aside":
            inner = block(pick(["h2", "h3"]), words(1, 3, furniture), 0) + (links() if chance(0.6) else block("p", prose(), 0))
        elif kind == "notice" and chance(0.35):  # a box without a telling name
            plain = pick(["", ' class="box"', ' class="panel"', ' class="layer"', ' id="overlay"'])
            text = words(5, 18, 0.6)
            if chance(0.5):
                labels.append(0)
                return f"<div{plain}>{text}" + (block("button", words(1, 1, 0.9), 0) if chance(0.5) else "") + "</div>"
            return f"<div{plain}>" + block("p", text, 0) + (block("button", words(1, 2, 0.9), 0) if chance(0.7) else "") + "</div>"
        elif kind in ("ad", "notice"):
            text = prose() if chance(0.7) else words(3, 15, furniture)
            if chance(0.6):
                labels.append(0)
                return f"<{tag}{named}>{text}</{tag}>"
            inner = block("p", text, 0) + (block("button", words(1, 2, furniture), 0) if kind == "notice" else "")
        elif kind == "form":
            inner = block("label", words(1, 2, furniture), 0) + "<input name=q>" + block("button", words(1, 2, furniture), 0)
        else:
            inner = block("h3", words(1, 2, furniture), 0) + "".join(f'<div class="{pick(["comment", "reply"])}">' + block("p", words(1, 2, 0), 0) + block("p", prose(), 0) + "</div>" for _ in range(int(rng.integers(1, 4))))
        return f"<{tag}{named}>{inner}</{tag}>"

    def table() -> str:
        """A page laid out by a table: rows above and below, cells beside the text."""
        cell = lambda inner, attributes="": f"<td{attributes}>{inner}</td>"
        rows = []
        if chance(0.6):
            rows.append(pick([lambda: block("td", words(1, 4, 0.2), 0, " colspan=2"), lambda: cell(block("h1", words(1, 4, 0.2), 0)), lambda: menu("td")])())
        left = (menu("td") if chance(0.6) else cell(links(), " width=150")) if chance(0.8) else ""
        text = cell(body(), pick(["", "", " valign=top", ' class="content"', " width=600"])) if chance(0.8) else block("td", "<br><br>".join(prose() for _ in range(3)), 1)
        right = (menu("td") if chance(0.4) else cell(block("p", prose(), 0), ' class="ad"')) if chance(0.3) else ""
        rows.append(left + text + right)
        if chance(0.6):
            rows.append(pick([lambda: block("td", pick(["&copy; ", "Copyright "]) + words(1, 4, furniture), 0, " colspan=2"), lambda: menu("td")])())
        return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"

    if chance(0.25):
        out = "".join(side(k) for k in ("notice",) if chance(0.2)) + table() + "".join(side(k) for k in ("footer",) if chance(0.2))
        return f"<html><head><title>{words(1, 6, 0)}</title></head><body>{out}</body></html>", labels
    before = [k for k in ("header", "nav", "notice", "ad", "aside", "form") if chance(0.45)]
    after = [k for k in ("aside", "form", "comments", "ad", "nav", "footer") if chance(0.45)]
    out = "".join(side(k) for k in before)
    wrap = pick(["article", "article", "article", "main", "div", "section"])
    named = f' {pick(["class", "id"])}="{pick(["content", "post", "article", "main", "entry", "story", "text"])}"' if chance(0.3 if wrap == "article" else 0.75) else ""
    inner = body() + (side("comments") if chance(0.1) else "")
    if chance(0.3):  # neutral boxes, as deep as pages have them
        for _ in range(int(rng.integers(1, 12))):
            inner = f'<div class="{pick(["wrapper", "container", "row", "col", "inner", "layout", "grid", "box"])}">{inner}</div>'
    out += (f"<main><{wrap}{named}>{inner}</{wrap}></main>" if chance(0.2) else f"<{wrap}{named}>{inner}</{wrap}>") + "".join(side(k) for k in after)
    return f"<html><head><title>{words(1, 6, 0)}</title></head><body>{out}</body></html>", labels


def generated_set(seed: int, n: int) -> tuple[list[list], list[list[int]]]:
    rng, pages, labels = np.random.default_rng(seed), [], []
    while len(pages) < n:
        page, y = generated_page(rng)
        blocks = blocks_of(page)
        if len(blocks) == len(y):
            pages.append(blocks)
            labels.append(y)
    return pages, labels


@lru_cache(1)
def labeller() -> BlockLabeller:
    return BlockLabeller().train(*generated_set(21, TRAIN_PAGES))


def main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """The rows of pages without html_col, with their main text: the chosen blocks in page order, joined by newlines.

    Character references are decoded and white space within a block is one space. A null or empty page, and
    one without main blocks, has an empty text. Repeated rows and null keys are rows like any others; a column
    named as the result is replaced.
    """
    model = pages.sparkSession.sparkContext.broadcast(labeller())
    rows = pages.drop(out) if out != html_col else pages
    kept = [f for f in rows.schema.fields if f.name != html_col]

    def run(batches):
        for b in batches:
            texts = []
            for at in range(0, b.num_rows, 512):
                parsed = [blocks_of(h or "") for h in b.column(html_col).slice(at, 512).to_pylist()]
                x = Inputs(parsed)
                score = model.value.scores(x)
                for blocks, s in zip(parsed, np.split(score, x.first[1:-1]), strict=True):
                    texts.append("\n".join(t[1] for t, v in zip(blocks, s.tolist(), strict=True) if v >= 0.5))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` string"])
    return rows.mapInArrow(tidy(run), schema)
