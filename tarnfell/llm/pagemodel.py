"""Labelled pages in many layouts, made by rule, and the field trained on them."""

from __future__ import annotations

import html
import random

from tarnfell.llm.blocks import blocks, features
from tarnfell.llm.crf import Field, train

#: Wrappers of the article, outermost first; one is drawn per page.
_ARTICLE = (("article",), ("main", "article"), ('div class="content"', "article"), ('div id="main-content"',), ('div class="post-body"',),
            ("main",), ('section class="article-text"',), ('div class="page"', 'div class="entry-content"'), ('div role="main"',),
            ("table", "tr", 'td class="content"'), ("article", "section"), ('div class="story"',), ('div id="content"', 'div class="text"'),
            ("body-only",))
#: Other parts of a page: wrapper, then what its leaves look like (links, prose or fields).
_TOP = (('nav', "links"), ('header', "title"), ('div class="header"', "title"), ('div class="menu"', "links"), ('ul id="navigation"', "links"),
        ('div class="topbar"', "links"), ('div class="breadcrumb"', "links"), ('nav role="navigation"', "links"), ('header class="site-header"', "links"))
_NOTICE = (('div class="cookie-notice"', "prose"), ('div class="notice"', "prose"), ('div id="consent-banner"', "prose"), ('div class="alert"', "prose"),
           ('div class="ad"', "prose"), ('div class="ads"', "prose"), ('div class="advert"', "prose"), ('aside class="ad"', "prose"), ('div id="ad-top"', "prose"),
           ('div class="advertisement"', "prose"), ('div class="sponsored promo"', "prose"), ('div class="banner"', "prose"))
_SIDE = (("aside", "mixed"), ('div class="sidebar"', "mixed"), ('div id="sidebar"', "links"), ('div class="related"', "links"), ('aside class="widget"', "mixed"),
         ('div class="share social"', "links"), ('div class="newsletter subscribe"', "fields"), ("form", "fields"), ('form class="search"', "fields"),
         ('div class="login"', "fields"), ('section class="related-posts"', "links"))
_AFTER = (('div class="comments"', "comments"), ('section id="comments"', "comments"), ('ol class="commentlist"', "comments"), ('div id="disqus-comments"', "comments"),
          ('div class="comment"', "comments"), ('section class="reader-comments"', "comments"), ('div class="responses"', "comments"))
_BOTTOM = (("footer", "prose"), ("footer", "links"), ('div class="footer"', "prose"), ('div id="footer"', "links"), ('footer class="site-footer"', "mixed"),
           ('div class="copyright"', "prose"), ('div class="legal"', "prose"))
#: How sentences end, tidy and not.
_ENDS = (".", ".", ".", "!", "?", "", "###", "&amp;&amp;", "$$$", " |", "%")


class _Page:
    def __init__(self, seed: int) -> None:
        self.random, self.out, self.labels = random.Random(seed), [], {}

    def words(self, low: int, high: int, end: str = "") -> str:
        r = self.random
        text = " ".join("".join(r.choice("bdfghklmnprstvw") + r.choice("aeiouyåäöéü") for _ in range(r.choice([1, 2, 3, 4, 6]))) for _ in range(r.randint(low, high)))
        return text[:1].upper() + text[1:] + end

    def leaf(self, tag: str, text: str, label: int, inner: str = "") -> None:
        """One leaf block; ``inner`` wraps its text (or a part of it) in an inline tag."""
        self.labels[" ".join(html.unescape(text).split())] = label
        name = tag.split()[0]
        close = "" if name in ("p", "li") and self.random.random() < 0.25 else f"</{name}>"
        if inner == "half":
            words = text.split(" ")
            cut = self.random.randint(0, len(words) - 1)
            body = " ".join([*words[:cut], f"<b>{words[cut]}</b>", *words[cut + 1:]])
        elif inner:
            body = f"<{inner}>{text}</{inner.split()[0]}>"
        else:
            body = text
        if self.random.random() < 0.1 and not close:
            body = "<b>" + body + "<br>"
        self.out.append(f"<{tag}>{body}{close}")

    def part(self, wrapper: str, look: str) -> None:
        r = self.random
        self.out.append(f"<{wrapper}>")
        if look in ("links", "mixed"):
            self.out.append("<ul>")
            for _ in range(r.randint(2, 6)):
                self.leaf("li", self.words(1, 4), 0, 'a href="/x"')
            self.out.append("</ul>")
        if look == "title":
            self.leaf(r.choice(["h1", "div", "p"]), self.words(1, 4), 0, r.choice(["", 'a href="/"']))
            if r.random() < 0.5:
                self.leaf("p", self.words(3, 8), 0)
        if look in ("prose", "mixed"):
            sign = r.choice(["© ", "", "", ""])
            if r.random() < 0.5:
                text = sign + self.words(4, 25, r.choice([".", "", "!"]))
                self.labels[" ".join(text.split())] = 0
                self.out.append(text)
            else:
                if r.random() < 0.3:
                    self.leaf(r.choice(["h2", "h3", "h4"]), self.words(1, 4), 0)
                for _ in range(r.randint(1, 2)):
                    self.leaf("p", sign + self.words(4, 30, r.choice([".", "."])), 0)
        if look == "fields":
            for _ in range(r.randint(1, 3)):
                self.leaf(r.choice(["legend", "p", "fieldset", "div"]), self.words(1, 6), 0)
            self.leaf("button", self.words(1, 2), 0)
        if look == "comments":
            if r.random() < 0.6:
                self.leaf(r.choice(["h2", "h3"]), self.words(1, 3), 0)
            for _ in range(r.randint(1, 4)):
                opened = r.choice(["div", 'div class="comment"', "li", "article", "div"])
                self.out.append(f"<{opened}>")
                self.leaf(r.choice(["p", "h4", "div"]), self.words(1, 3), 0)
                self.out.append("<p>" if r.random() < 0.3 else "")
                self.leaf("p", self.words(4, 50, "."), 0)
                self.out.append(f"</{opened.split()[0]}>")
        self.out.append(f"</{wrapper.split()[0]}>")

    def article(self) -> None:
        r = self.random
        wrappers = r.choice(_ARTICLE)
        wrappers = () if wrappers == ("body-only",) else wrappers
        self.out += [f"<{w}>" for w in wrappers]
        if r.random() < 0.95:
            self.leaf(r.choice(["h1", "h1", "h1", "h2"]), self.words(1, 14, r.choice(["", "", "", *_ENDS])), 1)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.75:
                self.leaf("p", " ".join(self.words(1, 25, r.choice(_ENDS)) for _ in range(r.choice([1, 1, 2, 4, 8]))), 1,
                          r.choice(["", "", "half", "b", "em"]))
            elif kind < 0.8:
                self.leaf(r.choice(["h2", "h3"]), self.words(1, 8), 1)
            elif kind < 0.86:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.leaf("li", self.words(2, 14, r.choice([".", ""])), 1)
                self.out.append("</ul>")
            elif kind < 0.9:
                self.leaf("blockquote", self.words(5, 30, "."), 1)
            elif kind < 0.93:
                self.part(*r.choice(_NOTICE))
            elif kind < 0.95:
                self.part(*r.choice(_SIDE))
            else:
                self.leaf("p", self.words(1, 3, r.choice(_ENDS)), 1)
        if r.random() < 0.3 and wrappers:
            self.part(*r.choice(_AFTER))
        self.out += [f"</{w.split()[0]}>" for w in reversed(wrappers)]

    def build(self) -> tuple[str, dict[str, int]]:
        r = self.random
        self.out.append("<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style></head><body>")
        for choices, chance in ((_NOTICE, 0.3), (_TOP, 0.8), (_TOP, 0.4), (_NOTICE, 0.5), (_SIDE, 0.25)):
            if r.random() < chance:
                self.part(*r.choice(choices))
        self.article()
        for choices, chance in ((_AFTER, 0.35), (_SIDE, 0.4), (_NOTICE, 0.2), (_BOTTOM, 0.85)):
            if r.random() < chance:
                self.part(*r.choice(choices))
        self.out.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.out), self.labels


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, dict[str, int]]]:
    """Pages and the label (1: article) of each of their leaf texts."""
    return [_Page(seed + i).build() for i in range(count)]


def trained(count: int = 700) -> Field:
    """The field that tells article blocks, trained on ``count`` labelled pages; the same at every call."""
    chains = []
    for page, labels in labelled_pages(count):
        parts = blocks(page)
        chains.append((features(parts), [labels.get(p.text, 0) for p in parts]))
    return train(chains)
