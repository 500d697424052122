"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: stretches of text between block-level tags, in page order, inline markup joined through. A
block's features are its ancestors' tags and class or id words, and its text (length, share of link text, punctuation, marks
of legal lines and notices), its place, and its neighbours' tags. Two labels, main and other, form a chain; the most
probable labelling is decoded by Viterbi, and the main blocks are the page's text.

The field is trained on the driver, by stochastic gradient on the exact log likelihood (forward-backward), on labelled pages made
by ``labelled_pages``: a bounded number of layouts with the names that menus, notices, adverts, comments and articles go by. The
tables carry no labels for pages, and the trained weights are a few thousand numbers.

Defined cases: null and empty pages have the empty text; unclosed and unmatched tags are closed as a browser would, roughly: a
block tag ends an open paragraph, an end tag without a start is skipped, a head without an end tag ends at the first text or tag that
cannot stand in it; quotes count only around an attribute's value, and one that is never closed is a character like any other;
scripts, styles, templates and comments are never text; hidden blocks are judged as others are, that they are hidden being a
feature; character references are decoded once; a page of any length is read whole, in one pass.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Block-level tags, void tags, tags whose content is no text, and starts that close an open element of the same kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul button label textarea iframe noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template head title svg iframe textarea select".split())
#: Of these, the tags whose content is code: left open, they run to the end of the page. Of others left open only the tag is skipped.
CODE = frozenset("script style".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th"), "body": ("head",),
}
#: The tags that a head may hold.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SECTIONS = frozenset("article aside body footer form header main nav".split())
_SCOPES = frozenset("table ul ol dl select".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S
)
_STOP = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*+(?:([\"'])|[^\s>]*+)")
_BARE = re.compile(r"[^\s>]*+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in SILENT}
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """A leaf block: distinct tags and name words of its ancestors, the last two tags, the nearest section, name words of the nearest
    ancestor that has any, text, and how much of it is link text."""

    __slots__ = ("hidden", "last", "linked", "names", "near", "section", "tags", "text")

    def __init__(self, at: Open, text: str, linked: int) -> None:
        self.tags, self.names, self.near, self.last, self.section = at.tags, at.names, at.near, at.last, at.section
        self.text, self.linked, self.hidden = text, linked, at.hidden


class Open:
    """An open element, with what it and its ancestors give their blocks: kept up to date as elements open, so that a block costs
    the same at any depth."""

    __slots__ = ("hidden", "last", "names", "near", "section", "tag", "tags")

    def __init__(self, tag: str = "", names: frozenset[str] = frozenset(), hidden: bool = False, above: Open | None = None) -> None:
        self.tag = tag
        if above is None:
            self.tags, self.names, self.near, self.last, self.section, self.hidden = frozenset(), frozenset(), frozenset(), (), "-", False
            return
        self.tags = above.tags if tag in above.tags else above.tags | {tag}
        self.names = above.names if names <= above.names else above.names | names
        self.near, self.last, self.hidden = names or above.near, (*above.last[-1:], tag), hidden or above.hidden
        self.section = tag if tag in SECTIONS else above.section


class _Tags:
    """Where the tags of a page end: one walk over a tag's attributes, and one search for a quote that is missing."""

    def __init__(self, page: str) -> None:
        self.page, self.missing = page, set()

    def end(self, at: int) -> int:
        """Of a tag whose name ends ``at``: the place of its ``>``, or of the page's end."""
        page = self.page
        while m := _STOP.search(page, at):
            if m[0] == ">":
                return m.start()
            value = _VALUE.match(page, m.end())
            at, quote = value.end(), value[1]
            if not quote:
                continue
            close = -1 if quote in self.missing else page.find(quote, at)
            if close < 0:
                self.missing.add(quote)
                at = _BARE.match(page, at).end()
            else:
                at = close + 1
        return len(page)


def leaf_blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page, in order; white space inside a block is one space. ``known``: name words that matter (all)."""
    out: list[Block] = []
    top = Open()
    stack: list[Open] = []
    open_tags: Counter[str] = Counter()
    words: list[str] = []
    links: list[str] = []
    depth_of_link, at, page = 0, 0, page or ""
    open_ended: set[str] = set()
    tags = _Tags(page)

    def flush() -> None:
        if words:
            here = stack[-1] if stack else top
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                out.append(Block(here, text, len(" ".join(entities.unescape("".join(links)).split()))))
            words.clear()
            links.clear()

    def close() -> str:
        tag = stack.pop().tag
        open_tags[tag] -= 1
        return tag

    def end_head() -> None:
        while open_tags["head"]:
            close()

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            if open_tags["head"] and not page[at : m.start()].isspace():
                end_head()
            words.append(page[at : m.start()])
            if depth_of_link:
                links.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, end_of_name = m[2].lower(), at
        at = tags.end(at)
        attributes, at = page[end_of_name:at], min(at + 1, len(page))
        if open_tags["head"] and not m[1] and tag not in IN_HEAD:
            end_head()
        if m[1]:
            if tag == "a":
                depth_of_link = max(0, depth_of_link - 1)
            elif tag in BLOCKS and open_tags[tag]:
                flush()
                while close() != tag:
                    pass
                depth_of_link = 0
            elif tag in BLOCKS:
                flush()
            continue
        if tag in SILENT and tag != "head":
            if tag in BLOCKS:
                flush()
            if not attributes.rstrip().endswith("/") and tag not in open_ended:
                # what is inside is no markup to this: only the element's own end tag ends it
                if end := _END[tag].search(page, at):
                    at = end.end()
                elif tag in CODE:
                    at = len(page)
                else:
                    open_ended.add(tag)
            continue
        if tag == "br" or tag in VOID and tag != "hr":
            words.append(" ")
            links.append(" ")
        elif tag == "a":
            depth_of_link += 1
        elif tag in BLOCKS or tag == "head":
            flush()
            depth_of_link = 0
            while stack and stack[-1].tag == "p":
                close()
            ends = CLOSES.get(tag, ())
            while stack and any(s.tag in ends for s in stack[-3:]) and not (stack[-1].tag in _SCOPES and stack[-1].tag not in ends):
                if close() in ends and (not stack or stack[-1].tag not in ends):
                    break
            if tag != "hr":
                found = frozenset(w.lower() for a in _NAMES.finditer(attributes) for w in _PIECES.findall(a[2] or a[3] or a[4] or ""))
                found = found if known is None else found & known
                stack.append(Open(tag, found, bool(_HIDDEN.search(attributes)), stack[-1] if stack else top))
                open_tags[tag] += 1
    if at < len(page):
        words.append(page[at:])
    flush()
    return out


_ENDS = re.compile(r"[.!?…:;\"'»”)]$")
_NOTICE = re.compile(r"cookie|subscribe|newsletter|sign up|sign in|log in|privacy|all rights reserved|©|copyright|advert|sponsor|read more|related|share (?:this|on)|comment|repl(?:y|ies)", re.I)

_LEGAL = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)


def _local(block: Block, at: int, total: int) -> list[str]:
    n = len(block.text)
    count = block.text.count(" ") + 1
    out = [f"t:{t}" for t in block.tags] + [f"n:{w}" for w in block.names] + [f"p:{t}" for t in block.last[-1:]] + ["g:" + ">".join(block.last)]
    out += [f"c:{w}" for w in block.near] + ["s:" + block.section]
    out.append("len:" + str(min(6, count.bit_length())))
    out.append("link:" + str(min(4, int(5 * block.linked / max(1, n)))))
    out.append("end:" + str(bool(_ENDS.search(block.text))))
    out.append("place:" + str(min(3, 4 * at // max(1, total))))
    bare = not block.names and block.section not in ("article", "main")
    if _NOTICE.search(block.text):
        out += ["notice", f"bare-notice:{count <= 12}"] if bare else ["notice"]
    if "©" in block.text:
        out.append("legal")
    if block.hidden:
        out.append("hidden")
    if bare and count <= 12 and _LEGAL.search(block.text):
        out.append(f"bare-legal:{2 * at >= total}")
    if bare:
        out.append("bare:" + str(min(4, int(5 * block.linked / max(1, n)))))
    out.append("bias")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block: its own, and its neighbours' tags."""
    own = [_local(b, i, len(blocks)) for i, b in enumerate(blocks)]
    for i, f in enumerate(own):
        f.append("before:" + (blocks[i - 1].last[-1:] or ("-",))[0] if i else "first")
        f.append("after:" + (blocks[i + 1].last[-1:] or ("-",))[0] if i + 1 < len(blocks) else "last")
    return own


class Field:
    """The trained field: a weight of each feature for ``main`` against ``other``, and weights between neighbours' labels."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        self.known = frozenset(f[2:] for f in weights if f[:2] in ("n:", "c:"))

    def scores(self, found: list[list[str]]) -> np.ndarray:
        get = self.weights.get
        main = np.array([sum(get(f, 0.0) for f in fs) for fs in found])
        return np.stack((np.zeros(len(main)), main), axis=1)

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels, by Viterbi."""
        if not blocks:
            return []
        s = self.scores(features(blocks)).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            back.append((b + m10 > a + m00, b + m11 >= a + m01))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        label = b >= a
        out = [label]
        for zero, one in reversed(back):
            label = one if label else zero
            out.append(label)
        return out[::-1]

    def text(self, page: str | None) -> str:
        """The main blocks, joined by an empty line."""
        blocks = leaf_blocks(page, self.known)
        return "\n\n".join(b.text for b, main in zip(blocks, self.decode(blocks), strict=True) if main)


def _plus(x: float, y: float) -> float:
    """log(exp(x) + exp(y))."""
    return max(x, y) + log1p(exp(-abs(x - y)))


def expectations(main: list[float], moves: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Of a chain whose blocks weigh ``main`` as label 1: the probability of 1 at each, and the expected number of each move."""
    (m00, m01), (m10, m11) = moves
    n = len(main)
    forward, backward = [(0.0, main[0])], [(0.0, 0.0)] * n
    for y in main[1:]:
        a, b = forward[-1]
        forward.append((_plus(a + m00, b + m10), y + _plus(a + m01, b + m11)))
    for t in range(n - 2, -1, -1):
        c, d = backward[t + 1]
        d += main[t + 1]
        backward[t] = (_plus(m00 + c, m01 + d), _plus(m10 + c, m11 + d))
    z = _plus(*forward[-1])
    counts = [[0.0, 0.0], [0.0, 0.0]]
    for t in range(1, n):
        (a, b), (c, d) = forward[t - 1], backward[t]
        d += main[t]
        for i, x in enumerate((a, b)):
            for j, y in enumerate((c, d)):
                counts[i][j] += exp(x + moves[i][j] + y - z)
    return [exp(f[1] + g[1] - z) for f, g in zip(forward, backward, strict=True)], counts


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 16, rate: float = 0.6, decay: float = 1e-5, seed: int = 7) -> Field:
    """A field for pages given as features and labels: AdaGrad on the log likelihood, expectations by forward-backward."""
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for one in fs for f in one}))}
    coded = [([np.array([names[f] for f in one]) for one in fs], np.array(ys)) for fs, ys in pages if ys]
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    gw, gm = np.full(len(names), 1e-3), np.full((2, 2), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(coded)):
            fs, y = coded[i]
            flat, sizes = np.concatenate(fs), [len(f) for f in fs]
            at = np.repeat(np.arange(len(y)), sizes)
            likely, counts = expectations(np.bincount(at, weights=w[flat], minlength=len(y)).tolist(), moves.tolist())
            g, dm = np.array(likely) - y, np.array(counts)
            np.subtract.at(dm, (y[:-1], y[1:]), 1)
            dw = np.bincount(flat, weights=g[at], minlength=len(w)) + decay * w
            gw, gm = gw + dw**2, gm + dm**2
            w, moves = w - rate * dw / np.sqrt(gw), moves - rate * dm / np.sqrt(gm)
    return Field({f: float(w[i]) for f, i in names.items()}, moves)


#: What the parts of a page are called, for the training pages.
MAIN_NAMES = "article content post entry story body main text page news blog maincontent markdown prose".split()
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links tabs pagination pager".split(),
    "header": "header masthead topbar banner site brand logo toolbar hero".split(),
    "footer": "footer bottom legal copyright colophon credits imprint".split(),
    "aside": "sidebar side aside widget related recommended popular trending tags categories archive author bio promo".split(),
    "notice": "notice cookie consent alert message popup modal overlay gdpr warning disclaimer paywall announcement".split(),
    "ad": "ad ads advert advertisement adbox sponsor sponsored promo banner commercial adsense".split(),
    "form": "form search login signup newsletter subscribe subscription contact register".split(),
    "comments": "comments comment replies reply discussion responses disqus thread respond feedback reviews".split(),
    "share": "share social follow sharing buttons tools meta byline".split(),
}
NOTICE_WORDS = "all rights reserved,copyright,cookie,privacy,subscribe,newsletter,log in,advert,sponsor,read more,related,share this,comment,reply".split(",")
TRAIN_PAGES = 1200
#: Share of them whose article has no container of its own name.
BARE = 0.35


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 13) -> Iterator[tuple[str, list[str]]]:
    """(page, its main blocks' texts): pages of many layouts, made of invented words."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "an be cor du est fi gra hol in jen ko lu mer na or pla qui ros sta tur ul ven wi xa yo zet".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def sentence(lo: int, hi: int) -> str:
        if rng.random() < 0.03:  # articles use the words of notices too
            return pick(["{}.", "{}", "{} " + word() + "."]).format(pick(NOTICE_WORDS)).capitalize()
        return " ".join(word() for _ in range(int(rng.integers(lo, hi)))).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def prose(lo: int = 1, hi: int = 6) -> str:
        plain = " ".join(sentence(1 if rng.random() < 0.3 else 4, 18) for _ in range(int(rng.integers(lo, hi))))
        # what a text looks like must not decide alone: some of all parts' texts end oddly, shout or are rows of a table
        odd = [plain.rstrip(".!?"), plain.upper(), plain.replace(" ", " | ") + " |", plain.replace(" ", "&&& ") + "%%%", plain.split()[0]]
        return pick(odd) if rng.random() < 0.25 else plain

    def wrap(kind: str, inner: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        name = pick(["", "", "", "", "", "", "main-", "site-"]) + pick(PARTS[kind]) + pick(["", "", "-" + pick(["box", "wrap", "top", "list", "inner", "area", "section", "1"])])
        mark = pick([f' class="{name}"', f' id="{name}"', f' class="{pick(["row", "col", "block", "c1"])} {name}"'])
        mark += pick([" hidden", ' style="display:none"', " aria-hidden=true"]) if rng.random() < 0.06 else ""
        if tag == "div":
            tag = pick(["div", "div", "section", "aside"])
            return f"<{tag}{mark}>{inner}</{tag}>"
        return pick([f"<{tag}>{inner}</{tag}>", f"<{tag}{mark}>{inner}</{tag}>", f"<div{mark}>{inner}</div>"])

    def heading() -> str:
        tag, text = pick(["h2", "h3", "h4"]), pick([word(), f"{word()} {word()}", sentence(2, 6)])
        return pick([f"<{tag}>{text}</{tag}>", f'<{tag} class="{pick(["title", "heading", "widget-title", "section-title"])}">{text}</{tag}>', f"<div class=title>{text}</div>"])

    def menu() -> str:
        items = [f'<a href="/{word()}">{word()}</a>' for _ in range(int(rng.integers(2, 9)))]
        return pick(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items)])

    def other(kind: str) -> str:
        if kind == "nav":
            return wrap(kind, pick(["", "", heading()]) + menu())
        if kind == "header":
            return wrap(kind, pick([f"<h1>{word()} {word()}</h1>", f"<p>{prose(1, 2)}</p>", f'<a href="/">{word()}</a>', ""]) + pick(["", menu()]))
        if kind == "footer":
            return wrap(kind, pick([f"&copy; {word()}.example &middot; {prose(1, 3)}", f"<p>{prose(1, 3)}</p>", menu(), f"{word()} &copy; 2020 {word()}"]))
        if kind == "aside":
            return wrap(kind, pick([heading(), heading(), ""]) + pick([menu(), f"<p>{prose(1, 4)}</p>", prose(1, 3)]))
        if kind == "form":
            return wrap(kind, pick(["", heading()]) + f"<label>{word()}</label><input name=q><button>{word()}</button>" + pick(["", f"<p>{prose(1, 2)}</p>"]))
        if kind == "comments":
            return wrap(kind, pick(["", heading(), heading()]) + "".join(pick(["<p>{}</p>", "<div class='comment'><b>x</b><p>{}</p></div>", "<li>{}</li>"]).format(prose(1, 4)) for _ in range(int(rng.integers(1, 5)))))
        if kind == "share":
            return wrap(kind, pick([menu(), word() + " " + word()]))
        return wrap(kind, pick(["", "", heading()]) + pick([prose(1, 4), f"<p>{prose(1, 4)}</p>", f"<span>{prose(1, 3)}</span>"]))

    def bare_menu() -> str:
        links = [f'<a href="/{word()}">{pick([word(), word() + " " + word(), word().capitalize()])}</a>' for _ in range(int(rng.integers(1, 9)))]
        return pick([
            "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", pick([" | ", " ", " &middot; ", "<br>", ""]).join(links),
            "".join(f"<div>{x}</div>" for x in links), "".join(f"<p>{x}</p>" for x in links), "<p>" + " ".join(links) + "</p>",
        ])

    def bare_end() -> str:
        text = pick([f"&copy; {word()} {int(rng.integers(1990, 2030))}", f"Copyright {word()} {word()}. All rights reserved.", f"{word()} &copy; {sentence(1, 5)}"])
        return pick(["{}", "<p>{}</p>", "<small>{}</small>"]).format(text)

    def bare_page(body_block, main_part) -> str:
        """The article in containers without names, or with those of a grid, and menus and legal lines in the same ones."""
        grid = pick(["", "", "row", "col", "container", "wrapper", "grid", "inner", "c1", "page"])
        size = pick(["", "-8", "-md-6", "-1"]) if grid else ""
        mark = pick([f' class="{grid}{size}"', f" class={grid}{size}", f' id="{grid}{size}"']) if grid else ""
        brs = lambda: pick(["<br><br>", "<br>", "<br/><br/>"])
        if rng.random() < 0.25:
            lines = [prose(1, 4) for _ in range(int(rng.integers(1, 5)))]
            inner = (body_block("h1", sentence(2, 8)) if rng.random() < 0.4 else "") + "<div>" + brs().join(lines) + "</div>"
            texts.append(" ".join(lines))
        else:
            inner = main_part(False)
        menus, ends = [bare_menu() for _ in range(int(rng.integers(0, 3)))], [bare_end()] if rng.random() < 0.7 else []
        after = [bare_menu()] if rng.random() < 0.2 else []
        shape = rng.random()
        if shape < 0.3:
            cell = lambda x: f"<td{pick(['', mark, ' width=20%', ' valign=top'])}>{x}</td>"
            line = pick(["", "</tr><tr>"])
            cells = line.join([*map(cell, menus), cell(inner), *map(cell, after + ends)])
            return f"<table{pick(['', mark, ' width=100% border=0'])}><tr>{cells}</tr></table>"
        depth = int(rng.integers(1, 4))
        box = lambda x, k=1: f"<div{mark}>" * k + x + "</div>" * k
        parts = [*[box(m) for m in menus], box(inner, depth), *[box(x) for x in after + ends]]
        if shape < 0.45:
            parts = [*menus, inner, *after, *ends]
        whole = "".join(parts)
        return box(whole, int(rng.integers(1, 3))) if rng.random() < 0.4 else whole

    for _ in range(n):
        texts: list[str] = []

        def body_block(kind: str, text: str, texts: list[str] = texts) -> str:
            texts.append(text)
            inner = text
            if rng.random() < 0.2:
                first, _, rest = text.partition(" ")
                inner = pick([f"<b>{first}</b> {rest}", f'<a href="/x">{first}</a> {rest}', f"<em>{first}</em> {rest}", f"<b>{text}<br>"])
            mark = pick([" hidden", ' style="display:none"', " aria-hidden=true"]) if rng.random() < 0.03 else ""
            if kind[0] == "h" and rng.random() < 0.3:
                mark += f' class="{pick(["entry-title", "post-title", "title", "headline", "page-title", "heading"])}"'
            return f"<{kind}{mark}>{inner}" + ("" if kind in ("p", "li") and rng.random() < 0.2 else f"</{kind}>")

        def main_part(comments: bool) -> str:
            out = [body_block("h1", sentence(2, 12))] if rng.random() < 0.7 else []
            for _ in range(int(rng.integers(1, 12))):
                r = rng.random()
                if r < 0.64:
                    out.append(body_block("p", prose(1, 7)))
                elif r < 0.72:
                    out.append(body_block(pick(["h2", "h3", "h4"]), sentence(1, 6)))
                elif r < 0.78:
                    out.append("<ul>" + "".join(body_block("li", prose(1, 2)) for _ in range(int(rng.integers(1, 5)))) + "</ul>")
                elif r < 0.82:
                    out.append("<blockquote>" + body_block("p", prose(1, 3)) + "</blockquote>")
                elif r < 0.84:
                    out.append("<table><tr>" + "".join(body_block("td", sentence(1, 4)) for _ in range(3)) + "</tr></table>")
                else:
                    out.append(other(pick(["ad", "ad", "share", "aside", "form", "notice"])))
            if comments:
                out.append(other("comments"))
            return "".join(out)

        name = pick(MAIN_NAMES) + pick(["", "", "-body", "-content", "-text"])
        holder = pick(["article", "article", 'article class="post"', 'article class="hentry"', "main", f'div class="{name}"', f'div id="{name}"', f'section class="{name}"', f'article class="{name}"'])
        inner = main_part(rng.random() < 0.15)
        if rng.random() < 0.2:
            inner = f"<header>{inner.split('</h1>')[0]}</h1></header>" + inner.split("</h1>", 1)[1] if inner.startswith("<h1>") else inner
        main = inner if rng.random() < 0.12 else f"<{holder}>{inner}</{holder.split()[0]}>"
        if rng.random() < 0.25:
            main = f"<main>{main}</main>"
        before = [other(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
        after = [other(k) for k in ("share", "comments", "aside", "ad", "nav", "notice", "footer") if rng.random() < 0.45]
        page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>" + "".join([*before, main, *after])
        if rng.random() < BARE:
            texts.clear()
            page = f"<html>{pick(['<head>', ''])}<title>{word()}</title>{pick(['</head>', ''])}{pick(['<body>', '<body bgcolor=white>'])}" + bare_page(body_block, main_part)
        elif rng.random() < 0.03:
            texts[:] = [prose(2, 5)]
            page = texts[0]
        yield page + pick(["</body></html>", ""]), texts


@lru_cache(maxsize=2)
def default_field(n: int = TRAIN_PAGES, seed: int = 13) -> Field:
    """The field trained on the made pages; trained once a process."""
    pages = []
    for page, texts in labelled_pages(n, seed):
        blocks, left = leaf_blocks(page), list(texts)
        labels = []
        for b in blocks:
            labels.append(int(bool(left) and b.text == left[0]))
            if labels[-1]:
                left.pop(0)
        pages.append((features(blocks), labels))
    return train(pages)


def extract(pages: DataFrame, field: Field | None = None, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``into``."""
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [field.text(h.as_py()) for h in batch.column(batch.num_columns - 1)]  # one page at a time is a Python string
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], into])

    rest = [c for c in pages.columns if c not in (html, into)]
    schema = ", ".join(f"`{c}` {dict(pages.dtypes)[c]}" for c in rest)
    return pages.select(*rest, html).mapInArrow(run, f"{schema}, `{into}` string")


def query(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("bigint"))
