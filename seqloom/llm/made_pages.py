"""Labelled pages made by rule, to train the block labeller: pages of many shapes, with every kind of block that is not main text.

Words are made of letters at random, so that a labeller can only learn from elements, names, telling words and the sequence of
blocks. Shapes are drawn independently of each other: what holds the main text (an element of its own, a named div, a table
cell, or nothing), what stands around it and how it is marked (by element, by class or id, by telling words alone), what stands
inside it, and what is left unclosed or cut off."""

from __future__ import annotations

import numpy as np

#: Stand before a block's text in made pages: main text, or not.
MAIN, OTHER = "", ""

#: Words that give a block away, by kind.
_HINTS = {
    "nav": "home about news menu contact more next previous sitemap top shop blog forum help services products".split(),
    "footer": "copyright rights reserved privacy terms imprint contact policy powered accessibility company".split(),
    "ad": "advertisement sponsored offer buy sale now deal shop discount free promotion".split(),
    "notice": "cookies we use accept consent policy notice browser update javascript enable warning agree".split(),
    "form": "email password name submit search subscribe login register send username message required".split(),
    "comments": "reply said comment comments posted ago guest thanks agree wrote likes report".split(),
    "side": "related popular recent tags archive categories follow share trending newsletter author".split(),
    "head": "welcome site logo tagline search sign in language account cart".split(),
}
#: Class and id words by kind of block.
_CLASSES = {
    "nav": "nav navbar menu navigation breadcrumbs breadcrumb main-menu topnav pager pagination toc links tabs".split(),
    "footer": "footer site-footer bottom copyright colophon legal foot credits".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad adbox ad-slot commercial sponsor".split(),
    "notice": "notice cookie-notice cookie-banner consent gdpr alert notification popup modal disclaimer message cookies".split(),
    "form": "form login search-form newsletter subscribe signup contact-form searchbox".split(),
    "comments": "comments comment-list comment discussion replies disqus responses reader-comments thread".split(),
    "side": "sidebar side aside related widget recommended popular share social rail secondary trending author-box".split(),
    "head": "header site-header masthead top banner branding logo topbar hero".split(),
}
_MAIN_CLASSES = "content main article post entry story body text article-body entry-content post-content page-content main-content prose markdown copy wiki".split()
_TAGS = {
    "nav": ("nav", "ul", "div", "menu", "table", "ol"), "footer": ("footer", "div", "center", "table"), "ad": ("div", "aside", "ins", "section", "p", "a"),
    "notice": ("div", "section", "dialog", "noscript"), "form": ("form", "div", "fieldset"), "comments": ("section", "div", "ol", "ul", "dl"),
    "side": ("aside", "div", "section", "ul"), "head": ("header", "div", "table"),
}
#: Elements that say by themselves what they hold.
_TELLING = frozenset("nav footer aside header form menu dialog ins noscript fieldset".split())
_PLAIN = "x row col inner box c1 wide grid item block left right".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.letters = "bcdfghjklmnpqrstvwz", "aeiouyéüöä"

    def pick(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def word(self) -> str:
        return "".join(self.pick(self.letters[(i + 1) % 2]) for i in range(int(self.r.integers(2, 9))))

    def words(self, lo: int, hi: int) -> str:
        n = int(np.exp(self.r.uniform(np.log(lo), np.log(hi + 1))))
        text = " ".join(self.word() + (self.pick([",", "", "", ""]) if self.chance(0.2) else "") for _ in range(max(n, 1))).capitalize()
        return text + (self.pick([".", ".", "", "!", "?"]) if self.chance(0.8) else "")

    def said(self, kind: str, sure: bool = False) -> str:
        """Text of a kind of block; half the time (sure: always) with a word that gives it away."""
        text = self.words(1, self.pick([3, 6, 25]))
        if sure or self.chance(0.5):
            hint = self.pick(_HINTS[kind]).capitalize()
            text = hint if self.chance(0.3) else f"{hint} {text}" if self.chance(0.7) else f"{text} {hint.lower()}"
        return ("&copy; " if kind == "footer" and self.chance(0.4) else "") + text + (self.pick([" &middot; ", " | ", " &raquo; "]) + self.words(1, 5) if self.chance(0.15) else "")

    def attrs(self, names: list[str], p: float = 0.8) -> str:
        if not self.chance(p):
            return self.pick(["", "", f' class="{self.pick(_PLAIN)}"', f' id="{self.word()}"', ' style="margin:0"'])
        key = self.pick(["class", "class", "class", "id", "role"])
        more = [self.pick(_PLAIN) for _ in range(int(self.r.integers(0, 3)))] if key == "class" and self.chance(0.4) else []
        at = int(self.r.integers(0, len(more) + 1))
        quote = self.pick(['"', '"', "'"])
        return f" {key}={quote}{' '.join([*more[:at], self.pick(names), *more[at:]])}{quote}"

    def link(self, text: str) -> str:
        return f'<a href="{self.pick(["/", "#", "https://" + self.word() + ".test/"])}{self.word()}">{text}</a>'

    def other(self, kind: str) -> str:
        """One element that is not main text."""
        tag = self.pick(_TAGS[kind])
        # an element without a telling name or class has telling words instead
        named = self.chance(0.45 if tag in _TELLING else 0.85)
        sure = not named and tag not in _TELLING
        out = [f"<{tag}{self.attrs(_CLASSES[kind], 1.0 if named else 0.0)}>"]
        if sure and self.chance(0.5):
            out.append(f"<{(h := self.pick(['h2', 'h3', 'h4', 'b']))}>{OTHER}{self.pick(_HINTS[kind]).capitalize()}</{h}>")
        n = int(self.r.integers(1, 8 if kind in ("nav", "comments", "side") else 4))
        one = lambda: OTHER + (self.words(3, 70) if kind == "comments" and self.chance(0.7) else self.said(kind, sure))
        if tag in ("ul", "ol", "menu", "dl"):
            item = "dd" if tag == "dl" else "li"
            out += [f"<{item}>{self.link(one()) if kind != 'comments' or self.chance(0.2) else one()}{f'</{item}>' if self.chance(0.8) else ''}" for _ in range(n)]
        elif tag == "table":
            out.append("<tr>" + "".join(f"<td>{self.link(one())}</td>" for _ in range(n)) + "</tr>")
        else:
            style = self.pick(["text", "links", "list", "blocks", "blocks"])
            if style == "text":
                out.append(one())
            elif style == "links":
                out.append(self.pick([" ", " | ", "<br>"]).join(self.link(one()) for _ in range(n)))
            elif style == "list":
                out.append("<ul>" + "".join(f"<li>{self.link(one()) if self.chance(0.7) else one()}</li>" for _ in range(n)) + "</ul>")
            else:
                for _ in range(n):
                    inner = self.pick(["p", "div", "h3", "h4", "p"] if kind != "comments" else ["p", "article", "div", "blockquote"])
                    out.append(f"<{inner}>{one()}</{inner}>")
            if kind == "form" or self.chance(0.06):
                out.append(f'<label>{OTHER}{self.said("form")}</label><input name="{self.word()}"><select><option>{OTHER}{self.word()}<option>{OTHER}{self.word()}</select><button>{OTHER}{self.said("form")}</button>')
        out.append(f"</{tag}>")
        return "".join(out)

    def thread(self, depth: int = 0) -> str:
        """Reader comments as elements of their own, named like an article's or not at all, with headers, paragraphs and replies inside; only the
        thread's name says what they are."""
        made = []
        for _ in range(int(self.r.integers(1, 6 - 2 * depth))):
            tag = self.pick(["article", "article", "div", "li", "section"])
            head = self.pick([f"<header>{OTHER}{self.words(1, 3)}</header>", f"<h4>{OTHER}{self.words(1, 3)}</h4>", f"<cite>{OTHER}{self.words(1, 2)}</cite>", ""])
            text = "".join(f"<p>{OTHER}{self.words(3, 90)}</p>" for _ in range(int(self.r.integers(1, 4)))) if self.chance(0.8) else OTHER + self.words(3, 60)
            if self.chance(0.3):
                text = f"<div{self.attrs(_MAIN_CLASSES + ['comment-body'], 1.0)}>{text}</div>"
            replies = self.thread(depth + 1) if depth == 0 and self.chance(0.2) else ""
            made.append(f"<{tag}{self.attrs(_CLASSES['comments'] + _MAIN_CLASSES, 0.4)}>{head}{text}{replies}</{tag}>")
        title = f"<{(h := self.pick(['h2', 'h3', 'h4']))}>{OTHER}{self.said('comments', True)}</{h}>" if self.chance(0.6) else ""
        outer = self.pick(["div", "div", "section", "ol", "ul"])
        return f"<{outer}{self.attrs(_CLASSES['comments'], 1.0)}>{title}{''.join(made)}</{outer}>"

    def paragraph(self, text: str) -> str:
        """A paragraph, now and then unclosed or with inline elements that are."""
        start, end = self.pick([("<p>", "</p>")] * 6 + [("<p>", ""), ("<p><i>", "<br></p>"), ("<p><strong>", "</p>"), ("<p>", "<br>"), (f"<p{self.attrs(['lead', 'intro', 'first', 'summary'], 1.0)}>", "</p>"), ("<p><em>", "</em></p>"), ("<p><span>", "")])
        return start + text + end

    def main_blocks(self) -> list[str]:
        out = []
        if self.chance(0.85):
            level = self.pick(["h1", "h1", "h1", "h2"])
            title = f"<{level}{self.attrs(['title', 'headline', 'entry-title'], 0.2)}>{MAIN}{self.words(1, 14)}</{level}>"
            out.append(f"<header>{title}</header>" if self.chance(0.1) else title)
        for _ in range(int(self.r.integers(1, self.pick([14] * 9 + [50])))):
            what, text = self.r.random(), MAIN + self.words(1, 90)
            if self.chance(0.12):
                text += f" {self.link(self.words(1, 4))} &amp; <em>{self.words(1, 3)}</em> {self.words(1, 20)}"
            if what < 0.66:
                out.append(self.paragraph(text))
            elif what < 0.73:
                out.append(f"<{(h := self.pick(['h2', 'h3', 'h4']))}>{MAIN}{self.words(1, 9)}</{h}>")
            elif what < 0.81:
                t = self.pick(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{MAIN}{self.words(1, 20)}{'</li>' if self.chance(0.8) else ''}" for _ in range(int(self.r.integers(1, 6)))) + f"</{t}>")
            elif what < 0.86:
                out.append(f"<blockquote><p>{text}</p></blockquote>" if self.chance(0.5) else f"<blockquote>{text}</blockquote>")
            elif what < 0.91:
                cell = lambda t: f"<{t}>{MAIN}{self.words(1, 6)}</{t}>"
                cols = int(self.r.integers(1, 4))
                head = "<tr>" + "".join(cell("th") for _ in range(cols)) + "</tr>" if self.chance(0.4) else ""
                out.append("<table>" + head + "".join("<tr>" + "".join(cell("td") for _ in range(cols)) + "</tr>" for _ in range(int(self.r.integers(1, 4)))) + "</table>")
            elif what < 0.95:
                out.append(f"<figure><img src=\"{self.word()}.png\"><figcaption>{MAIN}{self.words(2, 15)}</figcaption></figure>" if self.chance(0.5) else f"<pre><code>{text}</code></pre>")
            else:
                out.append(f"<div>{text}</div>")
        if self.chance(0.25):
            # an article may end in a word or two, or in words that stand in footers elsewhere
            out.append(f"<p>{MAIN}{self.words(1, 3) if self.chance(0.6) else ' '.join(self.pick(_HINTS['footer']) for _ in range(int(self.r.integers(1, 4)))).capitalize() + '.'}</p>")
        return out

    def head(self) -> str:
        parts = [f"<title>{OTHER}{self.words(2, 10)}</title>"]
        for made in (
            f'<meta name="{self.word()}" content="{self.words(1, 9)}">', f'<link rel="stylesheet" href="/{self.word()}.css">', f"<style>.{self.word()} > b {{ color: #{int(self.r.integers(100, 999))}; }}</style>",
            f"<script>if (1 < 2) {{ {self.word()}('<div>{self.word()}</div>'); }}</script>", f"<!-- {self.words(1, 5)} <p>{self.word()}</p> -->", f'<script src="/{self.word()}.js"></script>',
        ):
            if self.chance(0.4):
                parts.insert(int(self.r.integers(0, len(parts) + 1)), made)
        return f"<head>{''.join(parts)}</head>"

    def page(self) -> str:
        inside = self.main_blocks()
        for kind in ("ad", "side", "form", "notice", "nav", "ad"):
            if self.chance(0.12):
                inside.insert(int(self.r.integers(1, len(inside) + 1)), self.other(kind))
        shape = self.r.random()
        if shape < 0.35:
            a, b = f"<article{self.attrs(_MAIN_CLASSES, 0.3)}>", "</article>"
            if self.chance(0.3):
                a, b = f"<main>{a}", f"{b}</main>"
        elif shape < 0.5:
            a, b = f"<main{self.attrs(_MAIN_CLASSES, 0.3)}>", "</main>"
        elif shape < 0.72:
            a, b = f"<{(t := self.pick(['div', 'div', 'section']))}{self.attrs(_MAIN_CLASSES, 1.0)}>", f"</{t}>"
        elif shape < 0.82:
            a, b = f"<table><tr><td>{self.other('nav') if self.chance(0.6) else ''}</td><td{self.attrs(_MAIN_CLASSES, 0.4)}>", "</td></tr></table>"
        elif shape < 0.92:
            a, b = "<div>", "</div>"
        else:
            a, b = "", ""
        if self.chance(0.15):
            a, b = a + f"<div{self.attrs(_MAIN_CLASSES)}>", "</div>" + b
        middle = a + self.pick(["", "\n"]).join(inside) + b
        before = [self.other(k) for k in ("notice", "head", "nav", "ad", "side", "nav", "form") if self.chance(0.45)]
        after = [self.other(k) for k in ("comments", "side", "ad", "form", "nav", "notice", "comments") if self.chance(0.3)]
        if self.chance(0.25):
            after.append(self.thread())
        if self.chance(0.3):
            self.r.shuffle(after)
        if self.chance(0.8):
            after.append(self.other("footer"))
        gap = self.pick(["", "\n", f"<!-- {self.word()} -->", "<hr>"])
        body = gap.join([*before, middle, *after])
        if self.chance(0.25):
            body = f'<div{self.attrs(["wrapper", "container", "page", "site", "layout"], 0.8)}>{body}</div>'
        html = f"{self.pick(['<!DOCTYPE html>', ''])}<html>{self.head() if self.chance(0.85) else ''}<body{self.attrs(['home', 'single', 'page'], 0.2)}>{body}</body></html>"
        if self.chance(0.1):
            html = html[: int(len(html) * self.r.uniform(0.3, 1))]
        return html


def pages(n: int, seed: int) -> list[str]:
    m = _Maker(seed)
    return [m.page() for _ in range(n)]
