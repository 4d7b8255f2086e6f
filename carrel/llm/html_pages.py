"""Labelled pages to train the extractor on: made from many layouts, each block element labelled by the part that it was made as."""

from __future__ import annotations

import random

#: How pages name their parts.
NAMES = {
    "ad": "ad ads advert advertisement adbox banner-ad sponsored sponsor promo promotion ad-slot adsense dfp ad-container".split(),
    "nav": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs site-nav tabs toc pagination pager".split(),
    "header": "header masthead top topbar site-header branding banner logo".split(),
    "footer": "footer site-footer bottom foot colophon copyright legal credits".split(),
    "side": "sidebar side aside widget rail right-column left-column related recommended trending popular most-read teaser more-stories".split(),
    "notice": "notice cookie cookie-notice consent gdpr alert message popup modal overlay warning info-box announcement paywall".split(),
    "form": "form search login signup newsletter subscribe contact-form register poll".split(),
    "comment": "comments comment comment-list discussion replies reply disqus responses user-comments reviews feedback".split(),
    "share": "share social share-bar social-links sharing follow tags tag-list".split(),
    "content": "content article post entry story main body text article-body post-content entry-content story-body main-content page-content".split(),
}
PARTS = "er th on an ti re the tion ing en ou st ha le de ver ch au io ra me".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: Some pages have prose without marks, shouted, with a mark on each word, or of few words again and again.
        self.style = self.r.choice(["plain"] * 6 + ["bare", "loud", "marked", "again"])

    def word(self) -> str:
        return "".join(self.r.choice(PARTS) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least: int = 3, most: int = 18) -> str:
        words = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(least, most))]
        if self.style == "again":
            return " ".join(w.strip(",") for w in words[:2] for _ in range(len(words)))
        if self.style == "marked":
            return " ".join(w + self.r.choice(["***", "$$$", "%%%", " |"]) for w in words)
        text = " ".join(words).capitalize() + ("" if self.style == "bare" else self.r.choice([".", ".", ".", "?", "!", ""]))
        return text.upper().replace(" ", "!! ") if self.style == "loud" else text.replace(",", "") if self.style == "bare" else text

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.sentence()
            if self.r.random() < 0.15:
                s = s.replace(" ", f" <{(t := self.r.choice(['b', 'i', 'em', 'strong', 'span']))}>", 1) + f"</{t}>"
            if self.r.random() < 0.08:
                s += f' <a href="/{self.word()}">{self.word()}</a>'
            out.append(s)
        return " ".join(out)

    def named(self, part: str, tags: list[str], label: int, inner: str, plain: float = 0.1) -> str:
        tag = self.r.choice(tags)
        name = self.r.choice(NAMES[part])
        if self.r.random() < 0.25:
            name = self.r.choice(["site", "page", "js", "block", "c"]) + "-" + name
        attrs = "" if tag not in ("div", "section", "ul", "p") and self.r.random() < 0.6 or self.r.random() < plain else f' {self.r.choice(["class", "class", "id"])}="{name}"'
        return self.tag(tag, label, inner, attrs)

    def tag(self, tag: str, label: int, inner: str, attrs: str = "") -> str:
        return f'<{tag}{attrs} data-y="{label}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        return self.tag("ul", 0, "".join(self.tag("li", 0, f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 3)))}</a>') for _ in range(n)))

    def ad(self) -> str:
        return self.named("ad", ["div", "div", "aside", "section", "ins-box", "p"], 0, self.r.choice([self.sentence(), self.prose(2), f"<a href=x>{self.sentence()}</a>", self.tag("p", 0, self.prose(1))]), 0.0)

    def nav(self) -> str:
        return self.named("nav", ["nav", "nav", "div", "ul"], 0, self.links(self.r.randint(2, 9)))

    def header(self) -> str:
        inner = self.r.choice([self.tag("h1", 0, self.word()), self.tag("p", 0, self.sentence(2, 5)), f'<a href="/">{self.word()}</a>', self.tag("div", 0, self.sentence(2, 6))])
        return self.named("header", ["header", "header", "div"], 0, inner + (self.nav() if self.r.random() < 0.5 else "") + (self.form() if self.r.random() < 0.2 else ""))

    def footer(self) -> str:
        return self.named("footer", ["footer", "footer", "footer", "div"], 0, self.r.choice(["&copy; ", "", "Copyright "]) + self.r.choice([self.word() + ".example.com &middot; " + self.sentence(), self.prose(2), self.tag("p", 0, self.prose(1)), self.links(4), self.tag("div", 0, self.sentence())]))

    def side(self) -> str:
        inner = self.tag(self.r.choice(["h2", "h3", "h4"]), 0, self.sentence(1, 4)) + self.r.choice([self.links(5), self.tag("p", 0, self.prose(2)), self.tag("div", 0, self.prose(1)), self.links(3) + self.tag("p", 0, self.prose(1))])
        return self.named("side", ["aside", "aside", "div", "section"], 0, inner)

    def notice(self) -> str:
        return self.named("notice", ["div", "div", "section", "aside", "p", "dialog"], 0, self.r.choice([self.prose(2), self.tag("p", 0, self.prose(2)), self.sentence() + " <button>OK</button>"]), 0.0)

    def form(self) -> str:
        inner = self.r.choice([f"<label>{self.sentence(1, 4)}</label><input name=q><button>{self.word()}</button>", self.tag("p", 0, self.prose(1)) + "<input type=email>", self.tag("div", 0, self.sentence()) + "<select><option>a<option>b</select>"])
        return self.named("form", ["form", "form", "form"], 0, inner) if self.r.random() < 0.8 else self.named("form", ["div", "section"], 0, self.tag("form", 0, inner), 0.0)

    def comments(self) -> str:
        one = lambda: self.r.choice([self.tag("p", 0, self.prose(self.r.randint(1, 4))), self.tag("article", 0, self.tag("h4", 0, self.word()) + self.tag("p", 0, self.prose(2)), ' class="comment"'), self.tag("div", 0, self.tag("p", 0, self.prose(3)), ' class="comment"'), self.tag("li", 0, self.prose(2)), self.tag("div", 0, self.sentence())])
        inner = (self.tag(self.r.choice(["h2", "h3"]), 0, self.sentence(1, 3)) if self.r.random() < 0.6 else "") + "".join(one() for _ in range(self.r.randint(1, 6))) + (self.form() if self.r.random() < 0.3 else "")
        return self.named("comment", ["div", "section", "section", "ul", "aside"], 0, inner, 0.0)

    def share(self) -> str:
        return self.named("share", ["div", "ul", "p"], 0, self.links(3) if self.r.random() < 0.6 else self.sentence(1, 4), 0.0)

    def block(self) -> str:
        k = self.r.random()
        if k < 0.62:
            p = self.prose(self.r.choice([1, 1, 2, 3, 5, 9]))
            return self.r.choice([self.tag("p", 1, p)] * 5 + [f'<p data-y="1">{p}', f'<p data-y="1"><b>{p}<br>'])
        if k < 0.72:
            return self.tag(self.r.choice(["h2", "h2", "h3", "h4"]), 1, self.sentence(1, 8))
        if k < 0.80:
            items = "".join(self.tag("li", 1, self.sentence() if self.r.random() < 0.9 else f'<a href="/x">{self.sentence()}</a>') for _ in range(self.r.randint(2, 6)))
            return self.tag(self.r.choice(["ul", "ol"]), 1, items)
        if k < 0.85:
            return self.tag("blockquote", 1, self.r.choice([self.prose(2), self.tag("p", 1, self.prose(2))]))
        if k < 0.88:
            return self.tag("pre", 1, self.sentence() + "\n  " + self.sentence())
        if k < 0.92:
            return self.tag("figure", 1, "<img src=x>" + self.tag("figcaption", 1, self.sentence()))
        if k < 0.95:
            return self.tag("table", 1, "".join(self.tag("tr", 1, "".join(self.tag("td", 1, self.sentence(1, 4)) for _ in range(3))) for _ in range(2)))
        return self.tag(self.r.choice(["div", "section"]), 1, self.tag("p", 1, self.prose(2)) + self.tag("p", 1, self.prose(1)))

    def article(self) -> str:
        parts = [self.tag(self.r.choice(["h1", "h1", "h1", "h2"]), 1, self.sentence(2, 12))] if self.r.random() < 0.9 else []
        if self.r.random() < 0.12 and parts:
            parts = [self.tag("header", 1, parts[0])]
        for _ in range(self.r.choice([0, 1, 2, 3, 5, 8, 14])):
            parts.append(self.block())
            if self.r.random() < 0.06:
                parts.append(self.r.choice([self.ad, self.share, self.form, self.notice, self.side])())
        if self.r.random() < 0.15:
            parts.append(self.r.choice([self.comments, self.share, self.side])())
        if self.r.random() < 0.12:
            line = self.sentence(1, 5)
            parts += [self.tag("p", 1, line if self.r.random() < 0.7 else self.sentence(1, 5)) for _ in range(self.r.randint(10, 60))]
        inner = "".join(parts)
        if self.r.random() < 0.2:
            inner = self.tag("div", 1, inner)
        if self.r.random() < 0.6:
            return self.tag("article", 1, inner, self.r.choice(["", "", f' class="{self.r.choice(NAMES["content"])}"']))
        return self.named("content", ["main", "div", "div", "section"], 1, inner)

    def page(self) -> str:
        maybe = lambda p, f: f() if self.r.random() < p else ""
        before = [maybe(0.3, self.header), maybe(0.7, self.nav), maybe(0.3, self.notice), maybe(0.4, self.ad), maybe(0.15, self.form), maybe(0.2, self.side)]
        after = [maybe(0.35, self.comments), maybe(0.3, self.side), maybe(0.2, self.ad), maybe(0.15, self.form), maybe(0.2, self.share), maybe(0.15, self.notice), maybe(0.15, self.nav)]
        self.r.shuffle(before)
        self.r.shuffle(after)
        article = self.article()
        if self.r.random() < 0.15:
            article = self.tag("main", 1, article)
        inner = "".join(before) + article + "".join(after)
        if self.r.random() < 0.25:
            inner = self.tag("div", 0, inner, self.r.choice(["", ' class="wrapper"', ' id="page"', ' class="container"']))
        head = f'<!DOCTYPE html><html lang="en" data-y="0"><head data-y="0"><meta charset="utf-8"><title>{self.sentence()}</title><script>var a="</p>";</script></head>'
        out = head + '<body data-y="0">' + inner + maybe(0.85, self.footer) + "</body></html>"
        return out if self.r.random() < 0.9 else out[: self.r.randint(len(out) // 3, len(out))]


def labelled_pages(n: int, seed: int) -> list[str]:
    """``n`` pages in which ``data-y`` labels each block element; the same for the same arguments."""
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]
