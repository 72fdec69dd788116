"""A small labelled table for the block classifier: pages whose elements carry ``data-main`` (1: main text, 0: not).

The pages are made by a rule from a seed, in three styles: with sectioning
elements, with telling class names, and with neither, where only the shape of
blocks and of their neighbours tells an article from what surrounds it. Article
paragraphs hold links, menus may hold none, and names that tell something may
stand on an element that holds the whole page.
"""

from __future__ import annotations

from random import Random

MARK = "data-main"
PAGES, SEED = 500, 7
STYLES = ("sections", "names", "bare")
_WORDS = "river stone early market wind paper under garden seven quiet lamp road winter field voice open letter green".split()
#: Words of class names, by part of the page.
NAMES = {
    "menu": ("menu", "main-nav", "navbar", "site_navigation", "breadcrumbs", "pagination", "toolbar"),
    "header": ("header", "site-header", "masthead", "top-banner"),
    "footer": ("footer", "site-footer", "copyright", "legal"),
    "side": ("sidebar", "related", "widget", "popular-widget", "newsletter", "promo"),
    "ad": ("ad", "ads", "advert", "sponsored", "ad-slot"),
    "notice": ("cookie-notice", "consent", "notice", "popup", "modal"),
    "comments": ("comments", "comment-list", "replies", "reader-comments"),
    "share": ("share", "social", "sharing-links"),
    "form": ("search-form", "login", "signup", "subscribe"),
}
_SECTION = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}


class _Maker:
    def __init__(self, rng: Random) -> None:
        self.rng, self.style = rng, rng.choice(STYLES)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(_WORDS) for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        """Words of which some may be linked: none mostly, a few often, most of them now and then."""
        share = self.rng.choice((0, 0, 0, 0, 0.05, 0.1, 0.2, 0.35))
        words = self.words(low, high).split()
        return " ".join(f'<a href="/{i}">{w}</a>' if len(words) > 5 and self.rng.random() < share else w for i, w in enumerate(words))

    def part(self, kind: str, inner: str) -> str:
        """A part that is not the article, as the page's style marks it."""
        tag = _SECTION.get(kind) if self.style == "sections" else None
        name = self.rng.choice(NAMES[kind]) if self.style == "names" or (tag is None and self.style == "sections") else None
        marked = f' class="{name}"' if name else ""
        return f'<{tag or "div"}{marked} {MARK}="0">{inner}</{tag or "div"}>'

    def menu(self) -> str:
        # Without links only where a mark or the place at the top tells it.
        linked = self.rng.random() < 0.7
        items = [self.words(1, 3) for _ in range(self.rng.randint(3, 9))]
        return self.part("menu", "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' if linked else f"<li>{t}</li>" for i, t in enumerate(items)) + "</ul>")

    def link_list(self) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(2, 9)}</a></li>' for i in range(self.rng.randint(3, 7))) + "</ul>"

    def side(self) -> str:
        if self.style == "bare":
            # Only the links after it tell its heading from one of the article.
            return self.part("side", (f"<h3>{self.words(1, 4)}</h3>" if self.rng.random() < 0.6 else "") + self.link_list())
        inner = self.rng.choice((self.link_list(), f"<p>{self.words(10, 70)}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.words(15, 40)}</p>" + self.link_list()))
        return self.part("side", inner)

    def footer(self) -> str:
        links = " ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(self.rng.randint(2, 5)))
        if self.style == "bare":
            return self.part("footer", f"<p>{links}</p>")
        return self.part("footer", self.rng.choice((f"<p>{self.words(3, 16)}</p>", f"{self.words(3, 30)} {links}", f"<p>{self.words(20, 60)}</p>")))

    def marked_only(self) -> list[str]:
        """Parts that shape alone can't tell."""
        if self.style == "bare":
            return []
        made = {
            "ad": f"<p>{self.words(3, 50)}</p>", "notice": f"<p>{self.words(5, 40)}</p>", "share": self.words(2, 6),
            "comments": "".join(f"<div><p>{self.words(2, 60)}</p></div>" for _ in range(self.rng.randint(1, 4))),
            "form": f"<p>{self.words(2, 12)}</p><label>{self.words(1, 3)}</label>",
        }
        return [self.part(k, v) for k, v in made.items() if self.rng.random() < 0.35]

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.85:
            out.append(f'<h1 {MARK}="1">{self.words(2, 9)}</h1>')
        short = r.random() < 0.2
        for _ in range(r.randint(1, 3 if short else 7)):
            kind = r.random()
            if short:
                out.append(f'<p {MARK}="1">{self.words(1, 11)}</p>')
                if self.style == "sections" and r.random() < 0.5:
                    # Without long text around it, only the section tells such a list from a menu.
                    items = "".join(f'<li {MARK}="1">{self.words(1, 5)}</li>' for _ in range(r.randint(2, 4)))
                    out.append(f"<ul>{items}</ul>")
            elif kind < 0.58:
                out.append(f'<p {MARK}="1">{self.prose(14, 120)}</p>')
            elif kind < 0.68 and out:
                # A line that is all link, between long ones without.
                out.append(f'<p {MARK}="1">{self.words(16, 60)}</p><p {MARK}="1"><a href="/more">{self.words(2, 8)}</a></p><p {MARK}="1">{self.words(16, 60)}</p>')
            elif kind < 0.76 and out:
                # Short lines stand next to long ones.
                out.append(f'<p {MARK}="1">{self.words(1, 9)}</p><p {MARK}="1">{self.prose(20, 90)}</p>')
            elif kind < 0.83:
                out.append(f'<h2 {MARK}="1">{self.words(1, 6)}</h2><p {MARK}="1">{self.prose(15, 80)}</p>')
            elif kind < 0.92:
                most = r.choice((2, 4, 14))
                items = "".join(f'<li {MARK}="1">{self.words(1, most)}</li>' for _ in range(r.randint(2, 5)))
                out.append(f'<p {MARK}="1">{self.words(12, 40)}</p><ul>{items}</ul><p {MARK}="1">{self.prose(14, 60)}</p>')
            else:
                out.append(f'<blockquote {MARK}="1">{self.words(8, 40)}</blockquote><p {MARK}="1">{self.prose(14, 60)}</p>')
        if not any("<p" in x for x in out):
            out.append(f'<p {MARK}="1">{self.prose(20, 90)}</p>')
        for _ in range(r.randint(0, 2)):
            # Lines of a word or two stand anywhere, also first.
            out.insert(r.randint(0, len(out)), f'<p {MARK}="1">{self.words(1, 3)}</p>')
        for extra in self.marked_only():
            out.insert(r.randint(1, len(out)), extra)
        inner = "".join(out)
        if self.style == "sections":
            return f"<{(tag := r.choice(('article', 'main')))}>{inner}</{tag}>"
        # A name that would tell, on an element that holds the article and more.
        return f'<div class="{r.choice(("content", "post", "has-sidebar", "with-comments wide", "entry"))}">{inner}</div>'

    def page(self) -> str:
        r = self.rng
        top = [x for x in (self.menu() if r.random() < 0.85 else "", self.side() if r.random() < 0.2 else "") if x]
        if self.style != "bare" and r.random() < 0.6:
            top.insert(r.randint(0, len(top)), self.part("header", f"<p>{self.words(1, 8)}</p>"))
        end = [x for x in (self.side() if r.random() < 0.5 else "", *self.marked_only(), self.footer() if r.random() < 0.85 else "") if x]
        body = r.choice(("", ' class="has-sidebar home"', ' class="no-ads"', ' id="top"'))
        head = r.choice(("<head><title>t</title></head>", "<head><title>t</title><meta charset=utf-8>", "<title>t</title>"))
        return f"<html>{head}<body{body}>{''.join(top)}{self.article()}{''.join(end)}</body></html>"


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[str]:
    """``count`` pages, the same for a seed."""
    rng = Random(seed)
    return [_Maker(rng).page() for _ in range(count)]


LABELLED_PAGES = labelled_pages()
