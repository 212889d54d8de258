"""Made-up pages with a label for each block element: the labelled rows that the extractor learns from."""

from __future__ import annotations

import random

_SYLLABLES = "the of and ing er on re th ion an es ed in or ti st ar le nd it was con la de que os una ción el en ent le les ment eau oi aux tion und der sch keit ung ein ver ge be zu ü ß é ñ".split()
_MENU = ["Home", "About", "Contact", "News", "Sport", "Shop", "Blog", "FAQ", "Login", "Start", "Über uns", "Accueil", "Inicio", "Products", "Archive"]
_CONTENT = ["content", "post-content", "entry-content", "article-body", "story", "main-content", "post", "text", "body-text", "prose"]
_NAMES = {
    "menu": ["nav", "menu", "main-nav", "navbar", "top-menu", "breadcrumb", "pagination", "tabs"],
    "header": ["header", "masthead", "site-header", "branding", "logo", "banner"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "foot", "legal"],
    "side": ["sidebar", "side", "widget", "widget-area", "related", "related-posts", "recommended", "popular", "tag-cloud", "rail"],
    "ad": ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement", "adsense"],
    "notice": ["cookie-notice", "cookie-banner", "notice", "alert", "modal", "popup", "newsletter", "subscribe", "consent", "gdpr", "message"],
    "form": ["search", "search-form", "login", "contact-form", "signup"],
    "comment": ["comments", "comment", "comment-list", "respond", "discussion", "replies"],
    "share": ["share", "social", "share-buttons", "byline", "meta", "post-meta", "author"],
}


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r, self.labels = random.Random(seed), []
        self.plain = self.r.random() < 0.25  # a site whose names say nothing
        self.quote = self.r.choice(["\"", "\"", "'", ""])
        self.loose = self.r.random() < 0.3  # ends of p and li are left out
        self.loud = self.r.choice([0, 0, 0, 1, 2])

    def word(self) -> str:
        w = "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice([1, 1, 2, 2, 3, 4])))
        return (w.upper() + "!!" if self.loud == 1 else w + self.r.choice(["###", "***", "&amp;&amp;", "%%%"]) if self.loud == 2 else w)

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self, lo: int = 3, hi: int = 22) -> str:
        return self.words(self.r.randint(lo, hi)).capitalize() + self.r.choice([".", ".", ".", ".", "?", "!", ""])

    def prose(self, lo: int = 1, hi: int = 9) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(lo, hi))]
        s = self.r.choice([" ", " ", "\n", "  "]).join(parts)
        if self.r.random() < 0.2:
            s = s.replace(" ", f" <a href='/{self.r.randrange(99)}'>", 1).replace(" ", "</a> ", 3) if s.count(" ") > 3 and "<a" not in s else s
        if self.r.random() < 0.2:
            s = f"<{(t := self.r.choice(['b', 'i', 'em', 'strong', 'span']))}>{s}" + f"</{t}>" * (self.r.random() < 0.7)
        if self.r.random() < 0.1:
            s += "<br>" + self.sentence()
        return s

    def names(self, kind: str) -> str:
        if self.r.random() < 0.15:
            return ""
        if self.plain:
            name = "".join(self.r.choice("abcdefghijkxyz") for _ in range(5))
        else:
            name = self.r.choice(_CONTENT if kind == "content" else _NAMES[kind])
        q = self.quote or ("" if " " not in name else "\"")
        return f" {self.r.choice(['class', 'class', 'class', 'id'])}={q}{name}{q}"

    def el(self, tag: str, label: int, attrs: str, *inner) -> str:
        """An element; its children are functions or strings, so that labels come in page order."""
        self.labels.append(label)
        body = "".join(x() if callable(x) else x for x in inner)
        end = "" if self.loose and tag in ("p", "li") else f"</{tag}>"
        return f"<{tag}{attrs}>{body}{end}" + self.r.choice(["", "\n", ""])

    def link(self) -> str:
        return f"<a href=\"/{self.r.randrange(999)}\">{self.r.choice(_MENU) if self.r.random() < 0.5 else self.words(self.r.randint(1, 3))}</a>"

    # what isn't the article

    def link_list(self, tag: str = "ul", lo: int = 2, hi: int = 9) -> str:
        long = self.r.random() < 0.3
        item = lambda: self.el("li", 0, "", f"<a href='/x'>{self.sentence(3, 10)}</a>" if long else self.link())
        return self.el(tag, 0, "", *[item] * self.r.randint(lo, hi))

    def menu(self) -> str:
        tag = self.r.choice(["nav", "nav", "nav", "div", "ul", "div"])
        if tag == "ul":
            return self.link_list()
        inner = [self.link_list] if self.r.random() < 0.75 else [self.link() + self.r.choice([" | ", " &raquo; ", " ", " · ", ""]) for _ in range(self.r.randint(2, 8))]
        return self.el(tag, 0, self.names("menu"), *inner)

    def header(self) -> str:
        inner = []
        if self.r.random() < 0.6:
            inner.append(lambda: self.el(self.r.choice(["h1", "div", "p", "h2"]), 0, self.names("header"), self.words(self.r.randint(1, 4))))
        if self.r.random() < 0.5:
            inner.append(lambda: self.el("p", 0, "", self.sentence(3, 10)))
        if self.r.random() < 0.6:
            inner.append(self.menu)
        if self.r.random() < 0.3:
            inner.append(self.form)
        return self.el(self.r.choice(["header", "header", "div"]), 0, self.names("header"), *(inner or [self.words(3)]))

    def footer(self) -> str:
        inner = [self.r.choice(["&copy; ", "© 2024 ", "Copyright ", "(c) "]) + self.word() + ".example.com " + self.r.choice(["&middot; ", "- ", ""]) + self.prose(0, 3)]
        if self.r.random() < 0.5:
            inner = [(lambda s: lambda: self.el("p", 0, "", s))(inner[0])]
        if self.r.random() < 0.4:
            inner.append(self.link_list)
        self.r.shuffle(inner)
        return self.el(self.r.choice(["footer", "footer", "footer", "div"]), 0, self.names("footer"), *inner)

    def sidebar(self) -> str:
        def widget() -> str:
            return self.el(self.r.choice(["div", "section"]), 0, self.names("side"), lambda: self.el(self.r.choice(["h2", "h3", "h4"]), 0, "", self.words(self.r.randint(1, 3))), self.r.choice([self.link_list, self.link_list, lambda: self.el("p", 0, "", self.prose(1, 3))]))

        return self.el(self.r.choice(["aside", "aside", "div"]), 0, self.names("side"), *[widget if self.r.random() < 0.7 else self.r.choice([self.link_list, lambda: self.el("p", 0, "", self.prose(1, 3)), lambda: self.prose(1, 3)]) for _ in range(self.r.randint(1, 4))])

    def ad(self) -> str:
        inner = self.r.choice([lambda: self.prose(1, 2), lambda: self.el("p", 0, "", self.prose(1, 2)), lambda: self.link(), lambda: "Advertisement " + self.sentence(), lambda: f"<a href=x><img src=y></a> {self.sentence()}"])
        return self.el(self.r.choice(["div", "div", "aside", "section"]), 0, self.names("ad"), inner)

    def notice(self) -> str:
        text = self.r.choice(["We use cookies. ", "This site uses cookies to improve your experience. ", "Subscribe to our newsletter! ", "Wir verwenden Cookies. ", "Accept our privacy policy. ", "Your browser is out of date. ", ""]) + self.prose(1, 2)
        inner = [(lambda: self.el("p", 0, "", text)) if self.r.random() < 0.5 else text]
        if self.r.random() < 0.6:
            inner.append(lambda: self.el("button", 0, "", self.r.choice(["OK", "Accept", "Close", "Sign up", "Zustimmen"])))
        return self.el(self.r.choice(["div", "div", "section", "aside", "dialog"]), 0, self.names("notice") + self.r.choice(["", "", " role=\"alert\""]), *inner)

    def form(self) -> str:
        inner = []
        for _ in range(self.r.randint(1, 3)):
            if self.r.random() < 0.7:
                inner.append(lambda: self.el("label", 0, "", self.words(self.r.randint(1, 3))))
            inner.append("<input type=text name=q>")
        if self.r.random() < 0.3:
            inner.append(lambda: self.el("select", 0, "", *[lambda: self.el("option", 0, "", self.word())] * 3))
        if self.r.random() < 0.3:
            inner.append(lambda: self.el("p", 0, "", self.prose(1, 2)))
        inner.append(lambda: self.el("button", 0, "", self.r.choice(["Search", "Send", "Submit", "Go"])))
        return self.el("form", 0, self.names("form"), *inner)

    def comments(self) -> str:
        def one() -> str:
            tag = self.r.choice(["li", "div", "article", "div"])
            inner = []
            if self.r.random() < 0.8:
                inner.append(lambda: self.el(self.r.choice(["div", "p", "h4"]), 0, self.r.choice(["", " class=\"comment-author\"", " class='meta'"]), self.words(2) + self.r.choice([" says:", " wrote:", "", " 3 days ago"])))
            inner += [lambda: self.el("p", 0, "", self.prose(1, 4))] * self.r.randint(1, 2)
            return self.el(tag, 0, self.names("comment"), *inner)

        inner = [lambda: self.el(self.r.choice(["h2", "h3"]), 0, "", self.r.choice(["Comments", "3 Comments", "Kommentare", "Leave a reply", "Discussion"]))] if self.r.random() < 0.7 else []
        many = [one] * self.r.randint(1, 7)
        inner += [lambda: self.el(self.r.choice(["ul", "ol", "div"]), 0, self.names("comment"), *many)] if self.r.random() < 0.4 else many
        if self.r.random() < 0.5:
            inner.append(self.form)
        return self.el(self.r.choice(["section", "div", "div", "aside"]), 0, self.names("comment"), *inner)

    def share(self) -> str:
        return self.el(self.r.choice(["div", "ul", "p"]), 0, self.names("share"), self.r.choice([lambda: self.link() + self.link(), lambda: "By " + self.words(2) + ", " + self.r.choice(["May 3, 2023", "2024-01-02", "12.05.2021"]), lambda: "Share: " + self.link() + " " + self.link()]))

    # the article

    def paragraph(self) -> str:
        x = self.r.random()
        if x < 0.78:
            short = self.r.random() < 0.35
            return self.el("p", 1, "", self.sentence(1, 5) if short else self.prose())
        if x < 0.83:
            return self.el(self.r.choice(["h2", "h3"]), 1, "", self.words(self.r.randint(1, 8)))
        if x < 0.88:
            return self.el(self.r.choice(["ul", "ol"]), 1, "", *[lambda: self.el("li", 1, "", self.sentence(2, 15))] * self.r.randint(2, 6))
        if x < 0.91:
            return self.el("blockquote", 1, "", lambda: self.el("p", 1, "", self.prose(1, 3)))
        if x < 0.93:
            return self.el("pre", 1, "", self.prose(1, 3))
        if x < 0.95:
            return self.el("figure", 1, "", "<img src=x>", lambda: self.el("figcaption", 1, "", self.sentence()))
        if x < 0.97:
            row = lambda: self.el("tr", 1, "", *[lambda: self.el("td", 1, "", self.words(self.r.randint(1, 5)))] * 3)
            return self.el("table", 1, "", *[row] * self.r.randint(2, 4))
        return self.el("div", 1, "", self.prose())

    def article(self) -> str:
        tag = self.r.choice(["article", "article", "article", "main", "div", "div", "section"])
        n = self.r.choice([0, 1, 1, 1, 2, 2, 3, 5, 8, 12, 20])
        inner = [self.paragraph] * n
        for f, p in ((self.ad, 0.15), (self.share, 0.15), (self.notice, 0.06), (self.link_list, 0.04), (self.form, 0.04), (self.sidebar, 0.04), (self.menu, 0.04)):
            if self.r.random() < p:
                inner.insert(self.r.randint(0, len(inner)), f)
        if self.r.random() < 0.1:
            inner.append(self.comments)
        if self.r.random() < 0.1:
            inner.append(self.footer)
        if self.r.random() < 0.2:
            held = inner
            inner = [lambda: self.el("div", int(n > 0), self.names("content"), *held)]
        if self.r.random() < 0.75 or not n:
            title = lambda: self.el("h1", 1, "", self.words(self.r.randint(1, 9)))
            if self.r.random() < 0.15:
                inner.insert(0, lambda: self.el("header", 1, self.names("content"), title, *([self.share] if self.r.random() < 0.5 else [])))
            else:
                inner.insert(0, title)
        if not n and self.r.random() < 0.5:
            inner.append(self.paragraph)
        return self.el(tag, 1, self.names("content") if tag in ("div", "section") or self.r.random() < 0.3 else "", *inner)

    def page(self) -> str:
        before = [f for f, p in ((self.header, 0.45), (self.menu, 0.7), (self.notice, 0.25), (self.ad, 0.5), (self.form, 0.15), (self.sidebar, 0.15)) if self.r.random() < p]
        after = [f for f, p in ((self.comments, 0.35), (self.sidebar, 0.35), (self.ad, 0.2), (self.notice, 0.15), (self.share, 0.1), (self.menu, 0.1), (self.footer, 0.8)) if self.r.random() < p]
        if self.r.random() < 0.3:
            self.r.shuffle(before)
            self.r.shuffle(after)
        middle = [self.article]
        if self.r.random() < 0.25:
            wrapped = before[-1:] + middle + after[:1] if self.r.random() < 0.5 else middle
            before, after = (before[:-1], after[1:]) if len(wrapped) > 1 else (before, after)
            middle = [lambda: self.el(self.r.choice(["div", "main", "section"]), 1, self.r.choice(["", " class=\"wrapper\"", " id=page", " class=\"container\""]), *wrapped)]
        script = lambda: self.r.choice(["", "", "<!-- ad 1 -->", "<script>var a='<p>';</script>", "<style>p{margin:0}</style>"])
        inner = [x for f in (*before, *middle, *after) for x in (script, f)]
        head = f"<head><meta charset=utf-8><title>{self.words(4)}</title><style>p{{}}</style></head>" if self.r.random() < 0.9 else ""
        return "<!DOCTYPE html>" + self.el("html", 1, " lang=en", head, lambda: self.el("body", 1, "", *inner))


def sample(seed: int) -> tuple[str, list[int]]:
    """(html, labels of its block elements in page order)."""
    m = _Maker(seed)
    html = m.page()
    if m.r.random() < 0.1:
        html = html.removesuffix("</html>").removesuffix("</body>")
    return html, m.labels
