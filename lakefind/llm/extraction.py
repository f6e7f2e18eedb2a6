"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks: the text between two block-level borders, with
the tags and the class, id and role words of its ancestors.  Each block has
binary features (ancestors, nearest tag, length, links, punctuation, place on the page); two
labels, main text or not, form a chain whose weights are fitted by maximum
likelihood (forward-backward sums, Adam) on labelled pages and decoded by
Viterbi.

Labelled pages are laid out by ``labelled_page``: many kinds of site frames whose blocks are
labelled by construction (menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are not main text), filled with words of at most ``MAX_PAGES`` given pages.
This bounded fit runs on the driver; extraction reads every whole page where it lies, without a shuffle.

Defined results: null, empty and textless pages give an empty text.  Scripts, styles, templates, comments, the head,
frames, vector drawings and text fields are not text; mathematics and what stands inside objects, media, noscript and
choice lists is inline text like any other.  A head without end tag ends at its first text or at the first tag that
cannot stand in a head.  A line break counts as white space; all Unicode white space inside a block becomes
one space.  An element that never closes ends with the page, a tag that never ends is text.  Very long and broken pages take time and
memory in proportion to their length.  Repeated rows get equal results; further
columns are kept in ``row``.  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.llm.common import packed, short_batches, table
from lakefind.plans.registry import query

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template head title iframe svg textarea".split())
RAW = frozenset("script style title textarea iframe".split())
#: What may stand in a head; any other opening tag ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: What an opening tag closes: the open element, and the elements beyond which it does not look.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
OPENING = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?/])")
NAME_END = re.compile(r"[\s/>]|\Z")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
QUOTED = re.compile(r""""[^"]*+"|'[^']*+'""")
#: Decimal references: leading zeros, and numbers of eight digits or more, beyond all code points.
ZEROS, TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
WORD = re.compile(r"[a-z]+")
MAX_PAGES, TRAINING_PAGES = 200, 400


class Node:
    """An open element: its tag, class, id and role words, parent and nearest block-level tag."""

    __slots__ = ("tag", "names", "up", "near")

    def __init__(self, tag: str, names: tuple[str, ...], up: Node | None):
        self.tag, self.names, self.up = tag, names, up
        self.near = tag if tag in BLOCKS else up.near if up else ""


class Block:
    """One leaf block: its text, its innermost element and how much of it is links."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """The ancestors (tag, words), outermost first."""
        found, node = [], self.node
        while node:
            found.append((node.tag, node.names))
            node = node.up
        return tuple(reversed(found))


class Tags:
    """The tags and comments of a page from left to right, in time linear in its length whatever the page holds.

    A tag ends at the first ``>`` outside quotes.  One that never ends is text, and finding that out takes a pass to the
    end of the page.  Later tags that begin outside the quotes of such a pass never end either; as a quote
    character only swaps two of the states (outside, in double, in single quotes), three passes settle all.
    """

    def __init__(self, page: str):
        self.page, self.last, self.name_end = page, page.rfind(">"), -1
        self.endless: list[tuple[int, int, list[int], list[int]]] = []

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` has its ``>``, or -1."""
        if at > self.last:
            return -1
        for first, stop, opened, closed in self.endless:
            if first <= at <= stop:
                k = bisect_left(opened, at) - 1
                if k < 0 or at >= closed[k]:
                    return -1
        end = ATTRIBUTES.match(self.page, at).end()
        if self.page[end:end + 1] == ">":
            return end
        spans = [m.span() for m in QUOTED.finditer(self.page, at, end)]
        self.endless.append((at, end, [a for a, _ in spans], [b for _, b in spans]))
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The first one from ``at`` on: (start, end, closing, name, attributes); comments and declarations have no name."""
        page = self.page
        while m := OPENING.search(page, at):
            at = m.start()
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                return at, len(page) if end < 0 else end + 3, False, "", ""
            if m[0][-1].isalpha():
                if m.end() > self.name_end:
                    self.name_end = NAME_END.search(page, m.end()).start()
                end = self._end(self.name_end)
                if end >= 0:
                    return at, end + 1, m[0][1] == "/", page[m.end() - 1:self.name_end].lower(), page[self.name_end:end]
            if m[0][1] in "!?/" and at < self.last:
                return at, page.index(">", at) + 1, False, "", ""
            at += 1
        return None


def plain_text(text: str) -> str:
    """``text`` with its character references decoded; decimal numbers may be of any length."""
    if "&#" in text:
        text = TOO_LARGE.sub("\ufffd", ZEROS.sub("&#", text))
    return html.unescape(text)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order."""
    blocks: list[Block] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
    parts: list[str] = []
    linked, hidden, at = 0, 0, 0
    tags = Tags(page)

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            plain = plain_text(text)
            parts.append(plain)
            if places["a"]:
                linked += len("".join(plain.split()))

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, stack[-1] if stack else None, linked))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden
        while len(stack) > to:
            tag = stack.pop().tag
            places[tag].pop()
            hidden -= tag in HIDDEN

    def innermost(*names: str) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    def pop_within(names: set[str], limit: set[str]) -> None:
        """End the innermost of ``names`` unless one of ``limit`` lies within it."""
        k = innermost(*names)
        if k > innermost(*limit):
            pop(k)

    while True:
        found = tags.after(at)
        text = page[at:found[0] if found else len(page)]
        if hidden and stack[-1].tag == "head" and text.strip():
            pop_within({"head"}, {"template"})  # what a template holds is not the head's
        add(text)
        if found is None:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        if hidden and not closing and tag not in IN_HEAD:
            pop_within({"head"}, {"template"})
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS and not hidden:
            close()
        if closing:
            if places[tag]:
                pop(places[tag][-1])
            continue
        if tag in BLOCKS and not hidden and stack and stack[-1].near == "p":  # a block ends an open paragraph
            pop(places["p"][-1])
        if tag in CLOSES:
            pop_within(*CLOSES[tag])
        if tag in VOID or attributes.endswith("/"):
            continue
        names = tuple(w for n in NAMES.findall(attributes) for w in WORD.findall(n.lower()))
        places[tag].append(len(stack))
        stack.append(Node(tag, names, stack[-1] if stack else None))
        hidden += tag in HIDDEN
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            pop(len(stack) - 1)
    close()
    return blocks


def ancestor_features(nodes: Iterable[Node | None], known: Container[str] | None) -> dict[Node | None, frozenset[str]]:
    """The features of each node's ancestors and itself; those of a parent are shared, not built again."""
    seen: dict[Node | None, frozenset[str]] = {None: frozenset()}
    for node in nodes:
        fresh = []
        while node not in seen:
            fresh.append(node)
            node = node.up
        base = seen[node]
        for node in reversed(fresh):
            own = {f"name:{w}" for w in node.names}
            if node.tag in BLOCKS and node.tag not in ("html", "body"):
                own.add(f"in:{node.tag}")
            if known is not None:
                own = {f for f in own if f in known}
            seen[node] = base = base if own <= base else base | own
    return seen


def features(blocks: list[Block], known: Container[str] | None = None) -> list[set[str]]:
    """The binary features of each block; of its ancestors' only ``known`` ones where these are given."""
    out = []
    n = len(blocks)
    above = ancestor_features((b.node for b in blocks), known)
    for i, b in enumerate(blocks):
        f = {"bias", *above[b.node]}
        last = b.node.tag if b.node else ""
        f.add(f"near:{b.node.near if b.node else ''}")
        if last in ("button", "label", "a"):
            f.add(f"last:{last}")
        size, share = len(b.text), b.linked / max(1, len(b.text))
        f.add(f"size:{min(6, size.bit_length() // 2)}")
        f.add(f"links:{min(3, int(share * 4))}")
        f.add("stop" if b.text[-1] in ".!?…\"”»" else "open")
        if "©" in b.text or "(c)" in b.text.lower():
            f.add("copyright")
        f.add("place:" + ("first" if i == 0 else "last" if i == n - 1 else "inner"))
        out.append(f)
    return out


class Chain:
    """Weights of features per label and of label pairs; label 1 is main text."""

    def __init__(self, names: list[str]):
        self.index = {f: k for k, f in enumerate(names)}
        self.emit = np.zeros((len(names), 2))
        self.step = np.zeros((2, 2))

    def rows(self, found: list[set[str]]) -> list[list[int]]:
        return [[self.index[f] for f in sorted(fs) if f in self.index] for fs in found]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels (Viterbi); ties go to main text."""
        score, back = None, []
        for ids in self.rows(features(blocks, self.index)):
            e = self.emit[ids].sum(0).tolist()
            if score is None:
                score = e
                continue
            s, (a, b) = self.step.tolist(), score
            from_ = [int(b + s[1][y] >= a + s[0][y]) for y in (0, 1)]
            back.append(from_)
            score = [(b + s[1][y] if from_[y] else a + s[0][y]) + e[y] for y in (0, 1)]
        if score is None:
            return []
        labels = [int(score[1] >= score[0])]
        for from_ in reversed(back):
            labels.append(from_[labels[-1]])
        return labels[::-1]

    def fit(self, pages: list[tuple[list[set[str]], list[int]]], rounds: int = 120, rate: float = 0.1,
            shrink: float = 1e-3) -> Chain:
        """Maximum likelihood with a quadratic penalty; all pages advance one block at a time."""
        pages = [p for p in pages if p[0]]
        rows = [self.rows(f) for f, _ in pages]
        n, longest, size = len(pages), max(map(len, rows)), len(self.index)
        at = np.array([(p * longest + t, k) for p, r in enumerate(rows) for t, ids in enumerate(r) for k in ids])
        cell, col = at[:, 0], at[:, 1]
        live = np.arange(longest) < np.array([len(r) for r in rows])[:, None]
        gold = np.zeros((n, longest), int)
        for p, (_, labels) in enumerate(pages):
            gold[p, :len(labels)] = labels
        truth = np.stack([live & (gold == y) for y in (0, 1)], 2).astype(float)
        pairs = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
        moments = [np.zeros((2, size, 2)), np.zeros((2, 2, 2))]
        for k in range(1, rounds + 1):
            emit = np.zeros((n * longest, 2))
            for y in (0, 1):
                emit[:, y] = np.bincount(cell, self.emit[col, y], n * longest)
            emit = emit.reshape(n, longest, 2)
            ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
            ahead[:, 0] = emit[:, 0]
            for t in range(1, longest):
                new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.step, axis=1) + emit[:, t]
                ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = np.logaddexp.reduce(self.step + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(live[:, t + 1, None], new, 0)
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            own = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
            joint = np.exp(ahead[:, :-1, :, None] + self.step + (emit + behind)[:, 1:, None, :] - total[:, None, None, None])
            expected = (joint * live[:, 1:, None, None]).sum((0, 1))
            miss = (truth - own).reshape(-1, 2)
            grad = np.stack([np.bincount(col, miss[cell, y], size) for y in (0, 1)], 1) / n - shrink * self.emit
            for w, g, mom in ((self.emit, grad, moments[0]), (self.step, (pairs - expected) / n, moments[1])):
                mom[0] += 0.1 * (g - mom[0])
                mom[1] += 0.01 * (g * g - mom[1])
                w += rate * mom[0] / (1 - 0.9 ** k) / (np.sqrt(mom[1] / (1 - 0.99 ** k)) + 1e-8)
        return self


def labelled_page(rng: random.Random, words: list[str]) -> tuple[str, list[int]]:
    """A page of some site frame and the label of each of its leaf blocks."""
    labels: list[int] = []

    def some(lo: int, hi: int) -> str:
        k = rng.randrange(max(1, len(words) - hi))
        return html.escape(" ".join(words[k:k + rng.randint(lo, hi)])) or "x"

    def leaf(tag: str, text: str, label: int, names: str = "") -> str:
        labels.append(label)
        return f"<{tag}{names}>{text}</{tag}>"

    def sentence(lo: int, hi: int) -> str:
        return some(lo, hi).rstrip(".,") + rng.choice([".", ".", ".", "!", "?", ""])

    def named(*choices: str) -> str:
        word = rng.choice(choices)
        return rng.choice([f' class="{word}"', f' id="{word}"', f' class="{word} {rng.choice(["box", "wide", "c1"])}"'])

    def menu(names: str = "") -> str:
        items = "".join(leaf("li", f'<a href="/{k}">{some(1, 3)}</a>', 0) for k in range(rng.randint(2, 8)))
        return f"<ul{names}>{items}</ul>"

    def prose(label: int) -> str:
        text = sentence(1, 90)
        if rng.random() < 0.3:
            k = text.find(" ", len(text) // 2)
            text = text if k < 0 else f"{text[:k]} <{(t := rng.choice(['b', 'em', 'i', 'span', 'a']))}>{text[k + 1:]}</{t}>"
        return leaf("p", text, label)

    def advert() -> str:
        return f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner')}>" + (
            prose(0) if rng.random() < 0.4 else leaf("span", sentence(2, 20), 0)) + "</div>"

    def notice() -> str:
        return f"<div{named('cookie', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'newsletter')}>{prose(0)}</div>"

    def form() -> str:
        return f"<form{rng.choice(['', named('search', 'login', 'subscribe', 'signup', 'contact')])}>" + leaf(
            "p", f"<label>{some(1, 8)}</label><input name=q><button>{some(1, 2)}</button>", 0) + "</form>"

    def sidebar() -> str:
        tag = rng.choice(["aside", "aside", "div"])
        names = named("sidebar", "related", "widget", "recommended", "popular", "trending") if tag == "div" or rng.random() < 0.5 else ""
        return f"<{tag}{names}>" + (leaf("h3", some(1, 3), 0) if rng.random() < 0.6 else "") + (
            menu() if rng.random() < 0.6 else prose(0)) + f"</{tag}>"

    def comments() -> str:
        tag = rng.choice(["section", "div"])
        body = "".join(f"<div{named('comment', 'reply')}>" + (leaf("h4", some(1, 2), 0) if rng.random() < 0.5 else "")
                       + prose(0) + "</div>" for _ in range(rng.randint(1, 4)))
        return f"<{tag}{named('comments', 'comment-list', 'discussion', 'responses', 'replies')}>" + (
            leaf("h3", some(1, 3), 0) if rng.random() < 0.5 else "") + body + f"</{tag}>"

    def article() -> str:
        body = [leaf(rng.choice(["h1", "h1", "h2"]), some(2, 12), 1)] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                body.append(prose(1))
            elif kind < 0.75:
                body.append(leaf(rng.choice(["h2", "h3", "h4"]), some(1, 8), 1))
            elif kind < 0.8:
                body.append("<ul>" + "".join(leaf("li", sentence(2, 25), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.84:
                body.append("<blockquote>" + prose(1) + "</blockquote>")
            elif kind < 0.87:
                body.append("<table><tr>" + "".join(leaf("td", some(1, 5), 1) for _ in range(3)) + "</tr></table>")
            elif kind < 0.9:
                body.append("<figure>" + leaf("figcaption", sentence(2, 15), 1) + "</figure>")
            elif kind < 0.92:
                body.append(leaf("pre", some(2, 20), 1))
            else:
                body.append(rng.choice([advert, notice, form, sidebar])())
        if rng.random() < 0.1:
            body.append(comments())
        opening = rng.choice(["<article>", "<article>", "<article>", "<main>", f"<div{named('content', 'post', 'entry', 'story', 'article', 'main')}>",
                              "<div role=main>", "<main><article>", "<section>"])
        closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
        return opening + "".join(body) + closing

    def header() -> str:
        return rng.choice(["<header>", f"<div{named('header', 'masthead', 'top')}>"]) + leaf(
            rng.choice(["h1", "div", "p"]), some(1, 6), 0) + (menu() if rng.random() < 0.4 else "")

    page = []
    if rng.random() < 0.5:
        opened = header()
        page.append(opened + ("</header>" if opened.startswith("<header") else "</div>"))
    if rng.random() < 0.8:
        page.append(f"<nav>{menu()}</nav>" if rng.random() < 0.7 else menu(named("menu", "nav", "navbar", "breadcrumb")))
    page += [part() for part in (notice, advert, form, sidebar) if rng.random() < 0.35]
    page.append(article())
    page += [part() for part in (comments, sidebar, advert, form, notice) if rng.random() < 0.35]
    if rng.random() < 0.85:
        text = rng.choice([f"&copy; {some(1, 6)}", sentence(3, 25), f'<a href="/">{some(1, 3)}</a> {some(1, 3)}'])
        page.append(leaf("footer", text, 0) if rng.random() < 0.7 else f"<footer>{leaf('p', text, 0)}</footer>")
    return "<html><body>" + "".join(page) + "</body></html>", labels


def fit_chain(words: list[str], pages: int = TRAINING_PAGES, seed: int = 5) -> Chain:
    """A chain fitted on labelled pages filled with ``words``."""
    rng, known = random.Random(seed), []
    words = words or ["word"] * 40
    for _ in range(pages):
        page, labels = labelled_page(rng, words)
        found = leaf_blocks(page)
        if len(found) == len(labels):
            known.append((features(found), labels))
    seen: dict[str, int] = {}
    for found, _ in known:
        for f in set().union(*found):
            seen[f] = seen.get(f, 0) + 1
    return Chain(sorted(f for f, n in seen.items() if n > 1)).fit(known)


def main_text(page: str, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(blocks, chain.decode(blocks), strict=True) if y)


def sample_words(pages: DataFrame) -> list[str]:
    """Words of the visible text of at most ``MAX_PAGES`` pages, at most 200 of each, drawn by the hash of the id."""
    share = min(1.0, 0.9 * MAX_PAGES / max(1, pages.count()))
    scale = 1 << 30
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "(?s)<(script|style|head).*?</\\1>|<[^>]*>|&[^;]{1,8};", " ")
    words = F.slice(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0), 1, 200)
    drawn = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(scale)) < int(share * scale)).select(
        "page_id", words.alias("w")).limit(MAX_PAGES).collect()
    return [w for r in sorted(drawn, key=lambda r: (r["page_id"] is None, r["page_id"] or 0)) for w in r["w"]]


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """Every row of ``pages`` as struct ``row`` with its main ``text``."""
    short_batches(pages.sparkSession)
    keyed = packed(pages, html=F.col("html"))
    schema = keyed.select("row", F.lit("").alias("text")).schema
    fitted = pages.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(p or "", fitted.value) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, pa.string())], ["row", "text"])

    return keyed.mapInArrow(run, schema)


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    found = extract(pages, fit_chain(sample_words(pages)))
    return found.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text",
                        F.length("text").cast("long").alias("n_chars"))
