"""A small tolerant HTML reader: block elements as a tree, texts by block, features by node.

Only block elements become nodes; inline markup is read through, links are counted. Start
tags that imply an end (p, li, td, ...) give it, stray end tags are ignored, what is open at
the end is closed. Quoted values have any length; only a tag whose quote is never closed ends at its first >. Scripts, styles, templates, drawings, comments and the head are left out.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^><]*)>|<[!?][^>]*>",
    re.S,
)
BLOCK = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article aside nav header footer main form fieldset legend figure "
    "figcaption blockquote pre address details summary menu dialog center noscript iframe video audio object select option optgroup button textarea label hgroup search".split()
)
_RAW = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "template", "svg", "title")}
#: Of these the inner ones are counted, so that the outer one's end is found.
_NESTS = frozenset(("template", "svg"))
_VOID = frozenset("br img input hr meta link area base col embed source track wbr param".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dl dd dt div fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li tr td th".split()
)
#: A tag ends an open one of the second set, unless one of the third stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_P_SCOPE = frozenset("button td th caption object table".split())
_CONTROLS = frozenset("input select option textarea button label legend fieldset optgroup".split())


def _past(s: str, name: str, pos: int) -> int:
    """The place after the end of a raw element whose start tag ends at ``pos``; that of the page if it never ends."""
    depth = 1
    while m := _RAW[name].search(s, pos):
        pos = m.end()
        depth += -1 if m[1] else name in _NESTS and not m[0].endswith("/>")
        if not depth:
            return pos
    return len(s)


class Page:
    """Nodes in page order (parallel lists) and texts: (node, text), each of one block in page order."""

    __slots__ = ("tag", "attrs", "parent", "links", "inline", "controls", "texts", "link_chars")

    def __init__(self, source: str | None) -> None:
        self.tag: list[str] = ["#page"]
        self.attrs: list[str] = [""]
        self.parent: list[int] = [-1]
        self.inline, self.controls, self.links = [0], [0], [0]
        self.texts: list[tuple[int, str]] = []
        self.link_chars: list[int] = []
        self._read(source or "")

    def _read(self, s: str) -> None:
        stack, parts, pos, in_link, linked, head = [0], [], 0, False, 0, False
        tag, attrs, parent = self.tag, self.attrs, self.parent
        count = Counter(["#page"])  # open elements by tag, so that a stray end needs no walk

        def flush() -> None:
            nonlocal linked
            if parts:
                raw = "".join(parts)
                parts.clear()
                if not head:
                    text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
                    if text:
                        self.texts.append((stack[-1], text))
                        self.link_chars.append(min(linked, len(text)))
                linked = 0

        def pop_to(k: int) -> None:
            for node in stack[k:]:
                count[tag[node]] -= 1
            del stack[k:]

        n = len(s)
        while pos < n:
            m = _TAG.search(s, pos)
            if not m:
                parts.append(s[pos:])
                if in_link:
                    linked += n - pos
                break
            if m.start() > pos:
                parts.append(s[pos : m.start()])
                if in_link:
                    linked += m.start() - pos
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, close, attr = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if name in _RAW:
                if not close and not (name == "svg" and (attr or "").rstrip().endswith("/")):
                    pos = _past(s, name, pos)
                    parts.append(" ")
                continue
            if name == "head":
                flush()
                head = not close
                continue
            if head and name in BLOCK and name != "noscript":
                flush()
                head = False
            if name == "a":
                in_link = not close
                self.links[stack[-1]] += not close
                continue
            if name not in BLOCK:
                if name == "br":
                    parts.append("\n")
                elif name == "hr":
                    flush()
                if name in _CONTROLS:
                    self.controls[stack[-1]] += 1
                self.inline[stack[-1]] += not close
                continue
            if close:
                if count[name]:
                    k = next(k for k in range(len(stack) - 1, 0, -1) if tag[stack[k]] == name)
                    flush()
                    pop_to(k)
                    in_link = False
                elif name == "p":
                    flush()
                continue
            flush()
            if name in ("html", "body") and count[name]:
                continue
            if name in _CLOSES_P and count["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    t = tag[stack[k]]
                    if t == "p":
                        pop_to(k)
                        break
                    if t in _P_SCOPE or t in ("div", "section", "article", "li", "body"):
                        break
            if name in _ENDS and any(count[t] for t in _ENDS[name][0]):
                ends, scope = _ENDS[name]
                cut = None
                for k in range(len(stack) - 1, 0, -1):
                    t = tag[stack[k]]
                    if t in scope:
                        break
                    if t in ends:
                        cut = k
                if cut is not None:
                    pop_to(cut)
            tag.append(name)
            attrs.append(attr.lower() if attr else "")
            parent.append(stack[-1])
            self.inline.append(0)
            self.links.append(0)
            self.controls.append(name in _CONTROLS)
            if not (attr or "").rstrip().endswith("/") or name in ("p", "div", "a"):
                stack.append(len(tag) - 1)
                count[name] += 1
        flush()


#: Parts of class, id and role names, by what they speak for.
TOKENS = {
    "menu": "nav menu breadcrumb crumb pagination pager topbar toolbar tabs dropdown hamburger sitemap toc skip".split(),
    "header": "header masthead logo brand branding banner tagline hero".split(),
    "footer": "footer foot copyright legal colophon imprint".split(),
    "side": "sidebar side aside widget rail archive blogroll tagcloud tags related recommend trending popular more-stories readnext".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted dfp adsense banner-ad outbrain taboola affiliate".split(),
    "notice": "cookie consent gdpr notice alert modal popup overlay banner warning toast subscribe newsletter paywall message disclaimer privacy".split(),
    "form": "form search login signin signup register contact input field".split(),
    "comment": "comment comments reply replies discussion disqus respond feedback reviews".split(),
    "share": "share sharing social follow facebook twitter like byline meta author date timestamp".split(),
    "content": "article content post entry story main body text page-content prose maincontent article-body post-body".split(),
}
_GROUPS = list(TOKENS)
_TOKEN_OF = {t: k for k, g in enumerate(_GROUPS) for t in TOKENS[g]}
_NAMES = re.compile(r"(?:class|id|role|aria-label|itemprop|data-[a-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_SPLIT = re.compile(r"[^a-z]+")
_KINDS = (
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "menu", "dl"}, {"li", "dt", "dd"}, {"nav"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"article"}, {"main"}, {"section"}, {"div", "center"},
    {"form", "search", "fieldset"}, _CONTROLS, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"figure", "figcaption", "blockquote", "pre"}, {"html", "body", "#page"}, {"dialog", "noscript", "iframe", "object", "video", "audio"},
)
_KIND_OF = {t: k for k, g in reversed(list(enumerate(_KINDS))) for t in g}
#: Signs of what isn't the article, in lower case.
CUES = (
    ("©", "(c)", "copyright", "all rights reserved", "alle rechte", "derechos", "droits"), ("cookie", "consent", "gdpr", "privacy", "subscribe", "newsletter", "sign up", "log in", "accept"),
    ("advert", "sponsor", "promo"), ("comment", "reply", "replies", "says:", "wrote:"),
)
_CUES = tuple(re.compile("|".join(map(re.escape, c)), re.I) for c in CUES)
#: Letters that a pattern takes for i, s and k in any case, though their lower case is another.
_ODD = re.compile("[\u0130\u0131\u017f\u212a]")


def cue_counts(text: str) -> list[int]:
    """How often each of ``CUES`` occurs, in any case. Most texts have none, which a look for plain words tells sooner than a pattern."""
    low = text.lower()
    odd = not text.isascii() and _ODD.search(text)
    return [sum(1 for _ in cue.finditer(text)) if odd or any([w in low for w in words]) else 0 for cue, words in zip(_CUES, CUES)]


#: Longer attributes aren't kept in ``_seen``, which so has some 50 MB at most.
_KEPT = 512
_seen: dict[str, tuple[int, ...]] = {}


def attribute_groups(attrs: str) -> tuple[int, ...]:
    """How many tokens of each group the names in an element's attributes hold, and whether it is hidden."""
    if not attrs:
        return (0,) * (len(_GROUPS) + 1)
    if (known := _seen.get(attrs)) is not None:
        return known
    out = [0] * (len(_GROUPS) + 1)
    for value in _NAMES.findall(attrs):
        value = value.strip("\"'")
        for token in {value, *value.split(), *_SPLIT.split(value)}:
            if (k := _TOKEN_OF.get(token)) is not None:
                out[k] += 1
    out[-1] = int("display:none" in attrs.replace(" ", "") or re.search(r"\bhidden\b|aria-hidden=.?true", attrs) is not None)
    if len(_seen) > 20_000:
        _seen.clear()
    if len(attrs) <= _KEPT:
        _seen[attrs] = tuple(out)
    return tuple(out)


N_FEATURES = 30 + 2 * len(_KINDS) + 2 * (len(_GROUPS) + 1) + len(_CUES)


def features(page: Page) -> list[list[float]]:
    """One row of ``N_FEATURES`` numbers for each node: its subtree's densities, names, depth, kind, siblings and place."""
    n = len(page.tag)
    own, chars, words, stops, linked = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    cues = [[0.0] * len(_CUES) for _ in range(n)]
    first, last, at = [-1] * n, [0] * n, 0
    for (k, text), lc in zip(page.texts, page.link_chars):
        own[k] += len(text)
        chars[k] += len(text)
        words[k] += text.count(" ") + 1
        stops[k] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        linked[k] += lc
        for c, found in enumerate(cue_counts(text)):
            if found:
                # one cue in a long text says little
                cues[k][c] += found / max(1, len(text) / 400)
        if first[k] < 0:
            first[k] = at
        at += len(text)
        last[k] = at
    total = max(at, 1)
    tags, items, paras, links, controls, heads = [1] * n, [0] * n, [0] * n, page.links[:], page.controls[:], [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    depth = [0] * n
    for k in range(1, n):
        children[page.parent[k]].append(k)
        depth[k] = depth[page.parent[k]] + 1
        tags[k] += page.inline[k]
        t = page.tag[k]
        items[k], paras[k], heads[k] = t == "li", t == "p", len(t) == 2 and t[0] == "h" and t[1].isdigit()
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        for col in (chars, words, stops, linked, tags, items, paras, links, controls, heads):
            col[p] += col[k]
        for c in range(len(_CUES)):
            cues[p][c] += cues[k][c]
        if first[k] >= 0:
            first[p] = first[k] if first[p] < 0 else min(first[p], first[k])
        last[p] = max(last[p], last[k])
    groups = [attribute_groups(a) for a in page.attrs]
    above = [(0,) * (len(_GROUPS) + 1)] * n
    kinds_above = [0] * n
    log = math.log1p
    out = []
    place, count, alike = [0] * n, [1] * n, [1] * n
    before, after = [0.0] * n, [0.0] * n
    before_link = [0.0] * n
    for kids in children:
        by: dict[str, int] = {}
        for k in kids:
            by[page.tag[k]] = by.get(page.tag[k], 0) + 1
        for j, k in enumerate(kids):
            place[k], count[k], alike[k] = j, len(kids), by[page.tag[k]]
            if j:
                before[k], before_link[k] = log(chars[kids[j - 1]]), linked[kids[j - 1]] / max(chars[kids[j - 1]], 1)
            if j + 1 < len(kids):
                after[k] = log(chars[kids[j + 1]])
    for k in range(n):
        p = page.parent[k]
        if p >= 0:
            above[k] = tuple(map(max, above[p], groups[p])) if any(groups[p]) else above[p]
            kinds_above[k] = kinds_above[p] | (1 << _KIND_OF.get(page.tag[p], 12))
        c, w, kind = max(chars[k], 1), max(words[k], 1), _KIND_OF.get(page.tag[k], 12)
        pc = max(chars[p], 1) if p >= 0 else c
        row = [
            log(chars[k]), log(own[k]), own[k] / c, log(words[k]), chars[k] / w, stops[k] / w, linked[k] / c, links[k] / w, chars[k] / tags[k], log(tags[k]),
            depth[k], log(place[k]), place[k] / count[k], log(count[k]), alike[k] / count[k], before[k], after[k], before_link[k], chars[k] / pc, chars[k] / total,
            max(first[k], 0) / total, last[k] / total, log(items[k]), log(paras[k]), log(heads[k]), log(controls[k]), items[k] / tags[k], paras[k] / tags[k], len(children[k]), chars[k] / max(len(children[k]), 1),
        ]
        row += [kind == j for j in range(len(_KINDS))]
        row += [kinds_above[k] >> j & 1 for j in range(len(_KINDS))]
        row += groups[k]
        row += above[k]
        row += [min(x, 3) for x in cues[k]]
        out.append(row)
    return out
