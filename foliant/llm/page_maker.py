"""Invented pages with known main text, to train the extractor on: blocks of the article carry ``data-truth``."""

from __future__ import annotations

import random

SYLLABLES = "an be con da el fir gor hin ia jo ker lin mo nel or pu qua ren sol ti un ver wil xa yo zen é ña ün ßer ra to ma les".split()
NAV = "nav menu navbar navigation topnav breadcrumbs links tabs".split()
HEAD = "header masthead site-header top banner branding".split()
FOOT = "footer site-footer bottom copyright colophon legal".split()
SIDE = "sidebar widget rail related popular recommended aside secondary tags".split()
ADS = "ad ads advert advertisement sponsor sponsored promo banner adsense".split()
NOTE = "cookie notice consent gdpr alert message popup overlay disclaimer".split()
TALK = "comments comment-list responses discussion replies disqus".split()
BODY = "content post entry article article-body story text main post-content page-body".split()
SHARE = "share social toolbar follow buttons meta-links".split()
FORM = "search newsletter login subscribe signup contact form".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def prose(self, n: int) -> str:
        out = []
        while n > 0:
            k = min(n, self.r.randint(1, 18))
            s = self.words(k).capitalize()
            if k > 6 and self.r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            out.append(s + self.r.choice((".", ".", ".", "?", "")))
            n -= k
        return " ".join(out)

    def named(self, tag: str, names: list[str], inner: str, semantic: str = "") -> str:
        """The semantic tag, or a plain one with a telling class or id; sometimes both."""
        k = self.r.random()
        if semantic and k < 0.55:
            return f"<{semantic}>{inner}</{semantic}>"
        name = self.r.choice(names)
        attr = self.r.choice(('class="{}"', 'id="{}"', 'class="box {}"', 'class="{} wide" role="region"')).format(name)
        tag = semantic if semantic and k < 0.75 else tag
        return f"<{tag} {attr}>{inner}</{tag}>"

    def link(self) -> str:
        w = self.words(self.r.randint(1, 3))
        return f'<a href="/{w}">{w}</a>'

    def list_of_links(self, most: int = 12) -> str:
        n = self.r.randint(2, most)
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(self.link() for _ in range(n))

    def nav(self) -> str:
        return self.named("div", NAV, self.list_of_links(), "nav")

    def head(self) -> str:
        inner = self.r.choice((f"<h1>{self.words(2)}</h1>", f"<div>{self.words(3)}</div>", f"<p>{self.prose(8)}</p>", ""))
        return self.named("div", HEAD, inner + (self.nav() if self.r.random() < 0.6 else self.words(2)), "header")

    def foot(self) -> str:
        inner = f"&copy; {self.word()}.example &middot; {self.prose(self.r.randint(2, 20))}"
        inner = self.r.choice((inner, f"<p>{inner}</p>", f"<div>{inner}</div>{self.list_of_links(6)}"))
        return self.named("div", FOOT, inner, "footer")

    def ad(self) -> str:
        return self.named("div", ADS, self.r.choice((self.prose(self.r.randint(3, 30)), f"<p>{self.prose(self.r.randint(3, 40))}</p>", self.link())))

    def note(self) -> str:
        inner = self.prose(self.r.randint(5, 30))
        return self.named("div", NOTE, self.r.choice((inner, f"<p>{inner}</p>")) + self.r.choice(("", f"<button>{self.word()}</button>")))

    def side(self) -> str:
        parts = [f"<h3>{self.words(2)}</h3>", self.list_of_links(8), f"<p>{self.prose(self.r.randint(5, 40))}</p>"]
        self.r.shuffle(parts)
        return self.named("div", SIDE, "".join(parts[: self.r.randint(1, 3)]), "aside")

    def form(self) -> str:
        inner = f"<label>{self.words(2)}</label><input type=text><button>{self.word()}</button>"
        if self.r.random() < 0.4:
            inner = f"<p>{self.prose(self.r.randint(4, 20))}</p>" + inner
        return self.r.choice((f"<form>{inner}</form>", self.named("form", FORM, inner), self.named("div", FORM, f"<form>{inner}</form>")))

    def talk(self) -> str:
        each = []
        for _ in range(self.r.randint(1, 8)):
            inner = f"{self.r.choice((f'<b>{self.word()}</b>', f'<div class=author>{self.word()}</div>', ''))}<p>{self.prose(self.r.randint(3, 50))}</p>{self.r.choice(('', '<a href=#>Reply</a>'))}"
            each.append(self.r.choice((f'<div class="comment">{inner}</div>', f'<li class="comment">{inner}</li>', f'<article class="comment-body">{inner}</article>', f"<div>{inner}</div>")))
        return self.named(self.r.choice(("section", "div", "ol")), TALK, self.r.choice(("", f"<h3>{self.r.randint(1, 9)} {self.word()}</h3>")) + "".join(each) + (self.form() if self.r.random() < 0.4 else ""))

    def share(self) -> str:
        return self.named("div", SHARE, " ".join(self.link() for _ in range(self.r.randint(2, 5))))

    def kept(self, tag: str, inner: str) -> str:
        return f"<{tag} data-truth=1>{inner}</{tag}>"

    def paragraph(self) -> str:
        n = self.r.choice((self.r.randint(1, 6), self.r.randint(5, 40), self.r.randint(20, 160)))
        s = self.prose(n)
        k = self.r.random()
        if k < 0.12:
            return f"<p data-truth=1><b>{s}<br><p data-truth=1>"
        if k < 0.2:
            return f"<p data-truth=1>{s}"
        if k < 0.35:
            a, _, b = s.partition(" ")
            return self.kept("p", f"{a} {self.r.choice((self.link(), f'<em>{self.word()}</em>'))} {b}")
        return self.kept(self.r.choice(("p", "p", "p", "p", "p", "p", "div")), s)

    def by_line(self) -> str:
        return self.r.choice((self.words(self.r.randint(1, 4)), f"{self.word()} {self.link()}", f"<time>{self.r.randint(1, 28)}.{self.r.randint(1, 12)}.20{self.r.randint(10, 25)}</time> {self.word()}"))

    def title(self) -> str:
        """The heading of the article, plain or in a header of the article's own with what belongs to it."""
        h = self.kept(self.r.choice(("h1", "h1", "h2")), self.words(self.r.randint(1, 12)))
        k = self.r.random()
        if k < 0.5:
            return h
        more = "".join(self.kept(self.r.choice(("p", "div", "h2", "p")), self.r.choice((self.by_line(), self.prose(self.r.randint(3, 25))))) for _ in range(self.r.randint(0, 2)))
        if k < 0.9:
            return f"<header>{h}{more}</header>"
        tag, name = self.r.choice(("div", "header", "hgroup")), self.r.choice(("entry-header", "post-header", "article-header", "title"))
        return f'<{tag} class="{name}">{h}{more}</{tag}>'

    def steps(self) -> str:
        """A list of the article: short or long items, with or without links."""
        tag, n = self.r.choice(("ul", "ol", "ol")), self.r.randint(1, 9)
        most = self.r.choice((2, 4, 12, 40))
        item = lambda: self.r.choice((self.prose, self.words))(self.r.randint(1, most)) + (f" {self.link()}" if self.r.random() < 0.15 else "")
        rows = [self.kept("li", self.kept("p", item()) if self.r.random() < 0.15 else item()) for _ in range(n)]
        return f"<{tag} data-truth=1>" + "".join(rows) + f"</{tag}>"

    def linked(self) -> str:
        """A paragraph that is mostly links."""
        links = [self.link() for _ in range(self.r.randint(1, 6))]
        return self.kept("p", f"{self.words(self.r.randint(0, 6)).capitalize()} {', '.join(links)}{self.r.choice((' ' + self.words(2) + ' ' + self.link() + '.', '.', ''))}")

    def article(self) -> str:
        parts = [self.title()] if self.r.random() < 0.88 else []
        for _ in range(self.r.choice((1, 2, 3, self.r.randint(2, 14), self.r.randint(2, 25)))):
            k = self.r.random()
            if k < 0.66:
                parts.append(self.paragraph())
            elif k < 0.73:
                parts.append(self.kept(self.r.choice(("h2", "h3", "h3", "h4")), self.words(self.r.randint(1, 7))))
            elif k < 0.81:
                parts.append((self.kept("p", self.prose(self.r.randint(3, 20))) if self.r.random() < 0.5 else "") + self.steps())
            elif k < 0.86:
                parts.append(self.linked())
            elif k < 0.89:
                parts.append("<blockquote>" + self.kept("p", self.prose(self.r.randint(5, 50))) + "</blockquote>")
            elif k < 0.93:
                cell = self.r.choice(("td", "td", "th"))
                rows = "".join("<tr>" + "".join(self.kept(cell if not row else "td", self.words(self.r.randint(1, 4))) for _ in range(3)) + "</tr>" for row in range(self.r.randint(2, 5)))
                parts.append(f"<table>{rows}</table>")
            elif k < 0.95:
                parts.append(self.kept("pre", self.words(self.r.randint(1, 30))))
            elif k < 0.97:
                parts.append("<dl>" + "".join(self.kept("dt", self.words(2)) + self.kept("dd", self.prose(self.r.randint(2, 20))) for _ in range(self.r.randint(1, 4))) + "</dl>")
            else:
                parts.append(f"<figure><img src=x>{self.kept('figcaption', self.prose(self.r.randint(3, 15)))}</figure>")
            if self.r.random() < 0.08:
                parts.append(self.r.choice((self.ad, self.share, self.side, self.form, self.note))())
        inner = "".join(parts)
        for _ in range(self.r.choice((0, 1, 1, 1, 2))):
            k = self.r.random()
            if k < 0.55:
                tag = self.r.choice(("article", "article", "main", "section"))
                inner = f"<{tag}>{inner}</{tag}>" if self.r.random() < 0.6 else self.named(tag, BODY, inner)
            elif k < 0.85:
                inner = self.named("div", BODY, inner)
            else:
                inner = f"<div>{inner}</div>"
            if self.r.random() < 0.12:
                deep = self.r.randint(2, 8)
                inner = '<div class="x">' * deep + inner + "</div>" * deep
            if self.r.random() < 0.15:
                inner = self.r.choice((self.ad, self.share, self.nav))() + inner
            if self.r.random() < 0.15:
                inner += self.r.choice((self.talk, self.share, self.side))()
        return inner

    def bare_page(self) -> str:
        """An article and nothing else, or hardly anything; often a few words only."""
        inner = "".join(self.paragraph() if self.r.random() < 0.8 else self.steps() for _ in range(self.r.choice((1, 1, 2, 3, 5))))
        inner = (self.title() if self.r.random() < 0.6 else "") + inner
        k = self.r.random()
        if k < 0.35:
            tag = self.r.choice(("article", "main", "section"))
            inner = f"<{tag}>{inner}</{tag}>"
        elif k < 0.5:
            inner = self.r.choice((self.kept("div", self.prose(self.r.randint(6, 60))), f"<div>{inner}</div>"))
        return f"<html><head><title>{self.words(3)}</title></head><body>{inner}{self.foot() if self.r.random() < 0.2 else ''}" if self.r.random() < 0.7 else inner

    def page(self) -> str:
        if self.r.random() < 0.12:
            return self.bare_page()
        lead = [f for f, p in ((self.head, 0.5), (self.nav, 0.7), (self.ad, 0.5), (self.note, 0.3), (self.side, 0.2), (self.form, 0.15)) if self.r.random() < p]
        tail = [f for f, p in ((self.talk, 0.35), (self.side, 0.35), (self.form, 0.2), (self.ad, 0.25), (self.nav, 0.1), (self.note, 0.1)) if self.r.random() < p]
        self.r.shuffle(lead)
        self.r.shuffle(tail)
        body = "".join(f() for f in lead) + (self.article() if self.r.random() < 0.97 else "") + "".join(f() for f in tail) + (self.foot() if self.r.random() < 0.85 else "")
        if self.r.random() < 0.15:
            body = f'<div id="wrapper">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title></head><body>{body}" + ("</body></html>" if self.r.random() < 0.9 else "")
