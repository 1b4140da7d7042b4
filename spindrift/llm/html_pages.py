"""Labelled pages for training: many layouts drawn by rule, with the text that is content known."""

from __future__ import annotations

import html
import random

#: The generator's own choice: names that class and id attributes of each part of a page are built from.
PARTS = {
    "content": "article post entry content story main body text page single blog news detail copy prose section column",
    "nav": "nav navigation navbar menu topnav breadcrumb breadcrumbs crumbs links toc pager pagination tabs mainmenu",
    "header": "header masthead banner top topbar brand logo head branding tagline hero",
    "footer": "footer foot bottom copyright colophon legal imprint credits sitemap",
    "side": "sidebar side aside widget widgets related recommended popular trending rail more teaser secondary archive tags",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted banner dfp affiliate",
    "notice": "cookie cookies consent notice alert modal popup overlay gdpr privacy disclaimer warning subscribe newsletter paywall toast",
    "form": "form search login signup contact subscribe newsletter field input register",
    "comments": "comment comments commentlist disqus discussion replies reply respond reviews review feedback responses thread",
    "share": "share sharing social follow tweet like buttons toolbar tools actions print",
}
_LETTERS = "aeiou aeiou eeaatinors thandorling éèüäöñóçßí".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(rng.choice(_LETTERS)) for _ in range(rng.choice((1, 2, 2, 3, 4, 5, 6, 8, 11))))


def _sentence(rng: random.Random) -> str:
    style = rng.random()
    words = [_word(rng) for _ in range(rng.choice((1, 2, 3, 5, 8, 12, 18, 30)))]
    if style < 0.06:
        words = [w + rng.choice(("!!", "***", "%%%", "###", "&&&", " |")) for w in words]
    text = " ".join(words)
    if style < 0.9:
        text = text[:1].upper() + text[1:] + rng.choice((".", ".", ".", ".", "?", "!", ".”"))
    return text


def _prose(rng: random.Random, most: int = 8) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.randint(1, rng.choice((1, 2, most)))))


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.kept, self.dropped = rng, set(), set()
        self.plain = rng.random() < 0.35  # few names
        self.sloppy = rng.random() < 0.4  # end tags left out

    def names(self, part: str) -> str:
        rng = self.rng
        if rng.random() < (0.5 if self.plain else 0.12):
            return ""
        first = rng.choice(PARTS[part].split())
        name = first if rng.random() < 0.5 else rng.choice(("-", "_", "")).join((first, rng.choice("box wrap wrapper inner list item block area container left right 1 2".split())))
        return f' {rng.choice(("class", "class", "class", "id"))}="{name}"'

    def escape(self, text: str) -> str:
        return html.escape(text, quote=self.rng.random() < 0.5)

    def inline(self, text: str, links: float) -> str:
        """The escaped text, with some words inside inline elements."""
        rng, out = self.rng, []
        for w in text.split(" "):
            x = self.escape(w)
            roll = rng.random()
            if roll < links:
                x = f'<a href="/{rng.randint(1, 99)}">{x}</a>'
            elif roll < links + 0.03:
                x = rng.choice(("<b>{}</b>", "<em>{}</em>", "<strong>{}</strong>", "<span>{}</span>", "<code>{}</code>", "{}<br>")).format(x)
            out.append(x)
        return " ".join(out)

    def block(self, tag: str, text: str, content: bool, links: float = 0.0, names: str = "", end: bool = True) -> str:
        text = " ".join(text.split())
        (self.kept if content else self.dropped).add(text)
        whole = self.rng.random() < 0.06 and tag == "p"
        inner = f"<b>{self.escape(text)}" + ("<br>" if self.sloppy else "</b>") if whole else self.inline(text, links)
        return f"<{tag}{names}>{inner}" + (f"</{tag}>" if end else "")

    # parts of a page

    def link_list(self, part: str, tag: str) -> str:
        rng = self.rng
        items = []
        for _ in range(rng.randint(2, 9)):
            text = " ".join(_word(rng) for _ in range(rng.choice((1, 1, 2, 3, 8))))
            self.dropped.add(text)
            items.append(f'<a href="/{rng.randint(1, 99)}">{self.escape(text)}</a>')
        style = rng.random()
        if style < 0.6:
            body = "<ul>" + "".join(f"<li>{x}" + "</li>" * (not self.sloppy) for x in items) + "</ul>"
        elif style < 0.8:
            self.dropped.add(" | ".join(html.unescape(x.split(">")[1][:-3]) for x in items))
            body = " | ".join(items)
        else:
            body = "".join(f"<div>{x}</div>" for x in items)
        head = self.block(rng.choice(("h2", "h3", "h4", "p")), " ".join(_word(rng) for _ in range(rng.randint(1, 3))), False) if rng.random() < 0.3 else ""
        return f"<{tag}{self.names(part)}>{head}{body}</{tag}>"

    def prose_box(self, part: str, tag: str, most: int = 2) -> str:
        rng, text = self.rng, lambda: _prose(self.rng, most)
        style = rng.random()
        if style < 0.4:
            return self.block(tag, text(), False, 0.05, self.names(part))
        inner = "".join(self.block(rng.choice(("p", "p", "div", "h3", "span")), text(), False, 0.08) for _ in range(rng.randint(1, 3)))
        if "<span" in inner:
            inner = self.block("p", text(), False)
        if part in ("notice", "share") and rng.random() < 0.6:
            inner += self.block("button", _word(rng), False)
        return f"<{tag}{self.names(part)}>{inner}</{tag}>"

    def form(self) -> str:
        rng = self.rng
        rows = "".join(
            self.block("label", " ".join(_word(rng) for _ in range(rng.randint(1, 3))), False) + f'<input name="{_word(rng)}">' for _ in range(rng.randint(1, 4))
        )
        if rng.random() < 0.4:
            rows += "<select>" + "".join(self.block("option", _word(rng), False) for _ in range(3)) + "</select>"
        note = self.block("p", _prose(rng, 2), False) if rng.random() < 0.5 else ""
        return f'<form action="/x"{self.names("form")}>{note}{rows}{self.block("button", _word(rng), False)}</form>'

    def comments(self) -> str:
        rng = self.rng
        tag = rng.choice(("div", "section", "aside", "div"))
        item, outer = rng.choice((("div", "div"), ("li", "ol"), ("li", "ul"), ("article", "div")))
        part = "comments"
        each = []
        for _ in range(rng.randint(1, 6)):
            by = self.block(rng.choice(("span", "div", "h4")), f"{_word(rng)} {rng.randint(1, 28)}.{rng.randint(1, 12)}.", False) if rng.random() < 0.5 else ""
            if by.startswith("<span"):
                by = ""
            each.append(f"<{item}{self.names(part)}>{by}{self.block('p', _prose(rng, 3), False)}</{item}>")
        head = self.block("h3", " ".join(_word(rng) for _ in range(rng.randint(1, 3))), False)
        name = self.names(part) or f' class="{rng.choice(PARTS[part].split())}"'
        return f"<{tag}{name}>{head}<{outer}>{''.join(each)}</{outer}></{tag}>"

    def footer(self) -> str:
        rng = self.rng
        mark = rng.choice(("&copy; ", "&copy; ", "© ", ""))
        text = f"{html.unescape(mark)}{_word(rng)}.example.{_word(rng)} " + rng.choice(("· ", "- ", "| ", "")) + _prose(rng, 2)
        tag = rng.choice(("footer", "footer", "footer", "div"))
        name = self.names("footer") or ("" if tag == "footer" else ' id="footer"')
        if rng.random() < 0.5:
            return self.block(tag, text, False, 0.1, name)
        return f"<{tag}{name}>{self.block('p', text, False, 0.1)}{self.link_list('footer', 'div') if rng.random() < 0.4 else ''}</{tag}>"

    def article(self) -> str:
        rng, out = self.rng, []
        title = _sentence(rng)
        for _ in range(rng.randint(0, 1) if rng.random() < 0.2 else 1):
            out.append(self.block(rng.choice(("h1", "h1", "h1", "h2")), title, True))
        if out and rng.random() < 0.15:
            out[0] = f"<header>{out[0]}</header>"
        tag = rng.choice(("p", "p", "p", "p", "p", "p", "div"))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 14))):
            roll = rng.random()
            if roll < 0.72:
                out.append(self.block(tag, _prose(rng), True, rng.choice((0, 0, 0.02, 0.06)), end=not (self.sloppy and tag == "p")))
            elif roll < 0.82:
                out.append(self.block(rng.choice(("h2", "h3", "h4")), _sentence(rng), True))
            elif roll < 0.88:
                items = "".join(self.block("li", _sentence(rng), True, end=not self.sloppy) for _ in range(rng.randint(2, 5)))
                out.append(f"<{(x := rng.choice(('ul', 'ol')))}>{items}</{x}>")
            elif roll < 0.92:
                out.append(f"<blockquote>{self.block('p', _prose(rng, 3), True)}</blockquote>")
            elif roll < 0.94:
                out.append(self.block("pre", _prose(rng, 2), True))
            elif roll < 0.96:
                rows = "".join(f"<tr>{''.join(self.block('td', _sentence(rng), True) for _ in range(2))}</tr>" for _ in range(rng.randint(1, 3)))
                out.append(f"<table>{rows}</table>")
            elif roll < 0.98:
                out.append(f'<figure><img src="x.png">{self.block("figcaption", _sentence(rng), True)}</figure>')
            else:
                part = rng.choice(("ad", "share", "notice", "side"))
                name = self.names(part) or f' class="{rng.choice(PARTS[part].split())}"'
                out.append(self.block(rng.choice(("div", "aside")), _prose(rng, 2), False, 0.1, name))
        inner = "".join(out)
        outer = rng.choice(("article", "article", "article", "main", "div", "div", "section"))
        name = self.names("content")
        if outer in ("div", "section") and not name:
            name = f' class="{rng.choice(PARTS["content"].split())}"'
        if rng.random() < 0.3:
            inner = f"<div{self.names('content')}>{inner}</div>"
        return f"<{outer}{name}>{inner}</{outer}>"

    def source(self) -> str:
        rng, before, after = self.rng, [], []
        if rng.random() < 0.5:
            tag = rng.choice(("header", "header", "div"))
            name = self.names("header") or ("" if tag == "header" else ' id="header"')
            inner = self.block(rng.choice(("h1", "h2", "p", "div")), _sentence(rng), False, rng.choice((0, 0.5))) if rng.random() < 0.7 else ""
            before.append(f"<{tag}{name}>{inner}{self.link_list('nav', rng.choice(('nav', 'div'))) if rng.random() < 0.5 or not inner else ''}</{tag}>")
        if rng.random() < 0.7:
            before.append(self.link_list("nav", rng.choice(("nav", "nav", "div"))))
        for where, odds in ((before, 0.4), (after, 0.25)):
            for part in ("ad", "notice", "share"):
                if rng.random() < odds:
                    name_free = self.prose_box(part, rng.choice(("div", "div", "aside", "section")))
                    if "class=" in name_free.split(">")[0] or "id=" in name_free.split(">")[0] or name_free.startswith("<aside"):
                        where.append(name_free)
        if rng.random() < 0.5:
            (before if rng.random() < 0.3 else after).append(
                self.prose_box("side", "aside", 3) if rng.random() < 0.5 else self.link_list("side", rng.choice(("aside", "div")))
            )
        if rng.random() < 0.35:
            (before if rng.random() < 0.3 else after).append(self.form())
        body = self.article()
        if rng.random() < 0.35:
            after.insert(0, self.comments())
        rng.shuffle(before)
        tail = after[1:]
        rng.shuffle(tail)
        after = after[:1] + tail
        if rng.random() < 0.85:
            after.append(self.footer())
        before.insert(rng.randint(0, len(before)), "<script>var t='<p>';</script>")
        join = rng.choice(("", "\n", "\n  "))
        middle = join.join([*before, body, *after])
        if rng.random() < 0.4:
            middle = f'<div id="{rng.choice(("page", "wrapper", "container", "root", "site"))}">{middle}</div>'
        head = f"<head><meta charset=utf-8><title>{_word(rng)}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{middle}" + ("</body></html>" if rng.random() < 0.85 else "")


def labelled_pages(number: int, seed: int):
    """(html, is_content) pairs; is_content tells of a run of text whether it belongs to the article."""
    for i in range(number):
        page = _Page(random.Random(seed * 1_000_003 + i))
        source = page.source()
        yield source, (page.kept - page.dropped).__contains__
