"""Labelled web pages for training: invented pages of many layouts whose content is known.

Every page is put together from parts whose label is known by construction. Layouts vary
in semantic tags, class and id names, order, closing of tags, and language.
"""

from __future__ import annotations

import random
from html import escape

# Names that sites give to their page parts.
_NAMES = {
    "nav": ["nav", "navbar", "menu", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "site-navigation", "tabs", "toc-nav", "pagination"],
    "header": ["header", "site-header", "masthead", "top", "banner", "page-header", "branding", "topbar", "logo"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "page-footer", "copyright", "legal", "credits"],
    "side": ["sidebar", "side", "aside", "widget", "widgets", "related", "related-posts", "recommended", "popular", "trending", "more-stories", "tags", "author-box", "promo-box"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad", "adsbox", "google-ads", "sponsor", "werbung", "anzeige"],
    "notice": ["cookie", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "paywall", "toast"],
    "share": ["share", "social", "sharing", "share-buttons", "social-links", "toolbar"],
    "form": ["search", "search-form", "login", "signup", "contact-form", "newsletter-form", "comment-form", "respond"],
    "comments": ["comments", "comment-list", "commentlist", "disqus", "discussion", "responses", "reader-comments", "replies", "comment"],
    "main": ["content", "article", "post", "entry", "entry-content", "post-body", "article-body", "main-content", "story", "text", "page-content", "body-text", "main"],
}
_ROOTS = {
    "en": "the and of that to in is on with from people small large water school found river night story paper light under garden".split(),
    "de": "der und die von mit ein nicht haus stadt wasser schule fluss nacht kleine über straße garten für auch wird dass".split(),
    "fr": "le et la de que dans une pour maison ville école rivière nuit petite été jardin aussi avec très être".split(),
    "es": "el y la de que en una para casa ciudad agua escuela río noche pequeña jardín también con más está".split(),
}
_SYLLABLES = "ra te mi lo sen dar pol vin gor ely st ner qua bri tal um ex ion ad fi".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.lang = rng.choice(["en", "en", "de", "fr", "es"])
        self.marked = rng.random() < 0.1

    def word(self) -> str:
        r = self.rng
        w = r.choice(_ROOTS[self.lang]) if r.random() < 0.6 else "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
        return w + r.choice(["***", "$$$", "###", "&&&", "%%%"]) if self.marked else w

    def words(self, a: int, b: int) -> str:
        text = " ".join(self.word() for _ in range(self.rng.randint(a, b)))
        return text[:1].upper() + text[1:]

    def paragraph(self, a: int = 1, b: int = 7) -> str:
        return " ".join(f"{self.words(3, 22)}{self.rng.choice('....!?')}" for _ in range(self.rng.randint(a, b)))


def _open(rng: random.Random, kind: str, tags: list[str]) -> tuple[str, str]:
    """Start and end tag of a part: a telling tag, a telling name, or both."""
    tag = rng.choice(tags)
    telling = tag not in ("div", "section", "ul", "ol")
    attrs = ""
    if not telling or rng.random() < 0.5:
        name = rng.choice(_NAMES[kind])
        name += rng.choice(["", "", "", "-wrapper", "-inner", "_block", " clearfix", " col-md-8"])
        attrs = f' {rng.choice(["class", "class", "id"])}="{name}"'
    return f"<{tag}{attrs}>", f"</{tag}>"


def _links(w: _Writer, a: int, b: int) -> str:
    items = [f'<li><a href="/{i}">{escape(w.words(1, 3), False)}</a></li>' for i in range(w.rng.randint(a, b))]
    return "<ul>" + "".join(items) + "</ul>"


def _wrapped(rng: random.Random, kind: str, tags: list[str], inner: str) -> str:
    a, b = _open(rng, kind, tags)
    return f"{a}{inner}{b}"


def _furniture(w: _Writer, kind: str) -> str:
    r, e = w.rng, lambda s: escape(s, False)
    if kind == "nav":
        inner = _links(w, 2, 9) if r.random() < 0.8 else " | ".join(f'<a href="#">{e(w.words(1, 2))}</a>' for _ in range(4))
        return _wrapped(r, kind, ["nav", "nav", "div", "ul"], inner)
    if kind == "header":
        inner = f'<a href="/">{e(w.words(1, 3))}</a>' + (f"<p>{e(w.words(3, 8))}</p>" if r.random() < 0.5 else "") + (_furniture(w, "nav") if r.random() < 0.3 else "")
        return _wrapped(r, kind, ["header", "header", "div"], inner)
    if kind == "footer":
        text = r.choice([f"&copy; {r.randint(1999, 2025)} {e(w.words(1, 4))}", f"&copy; www.{w.word()[:9]}.example &middot; {e(w.paragraph(1, 2))}", e(w.paragraph(1, 2)), "All rights reserved. " + e(w.words(2, 5))])
        return _wrapped(r, kind, ["footer", "footer", "div"], (_links(w, 2, 5) if r.random() < 0.4 else "") + r.choice([text, f"<p>{text}</p>"]))
    if kind == "side":
        return _wrapped(r, kind, ["aside", "aside", "div"], f"<h3>{e(w.words(1, 3))}</h3>" + r.choice([_links(w, 2, 7), f"<p>{e(w.paragraph(1, 3))}</p>"]))
    if kind == "ad":
        return _wrapped(r, kind, ["div", "div", "aside", "section", "ins"], r.choice(["{0}", "<p>{0}</p>", "<a href='/x'>{0}</a>"]).format(e(w.paragraph(1, 3))))
    if kind == "notice":
        text = r.choice(["We use cookies. ", "", "Accept our privacy terms. ", "Subscribe to our newsletter! "]) + w.paragraph(1, 3)
        return _wrapped(r, kind, ["div", "div", "section", "dialog"], f"<p>{e(text)}</p>" + r.choice(["", "<button>OK</button>", "<button>Accept</button>"]))
    if kind == "share":
        return _wrapped(r, kind, ["div", "ul"], "".join(f'<a href="#">{x}</a> ' for x in ["Share", "Tweet", "Mail"]) if r.random() < 0.7 else "<span>Share</span>")
    if kind == "form":
        inner = f"<label>{e(w.words(1, 3))}</label><input type=text><select><option>{e(w.word())}<option>{e(w.word())}</select><button>{e(w.words(1, 2))}</button>"
        return _wrapped(r, kind, ["form"], (f"<p>{e(w.paragraph(1, 2))}</p>" if r.random() < 0.4 else "") + inner)
    single = [f"<p>{e(w.word())}: {e(w.paragraph(1, 4))}</p>" for _ in range(r.randint(1, 6))]
    shape = r.choice(["{0}", '<div class="comment">{0}</div>', "<li>{0}</li>", '<article class="comment">{0}</article>'])
    head = r.choice(["", f"<h3>{len(single)} comments</h3>", f"<h2>{e(w.words(1, 2))}</h2>"])
    return _wrapped(r, "comments", ["section", "div", "div", "ol"], head + "".join(shape.format(s) for s in single))


def _article(w: _Writer, content: list[str]) -> list[str]:
    """Markup pieces of an article; what they show is appended to ``content``."""
    r, e, out = w.rng, lambda s: escape(s, False), []

    def put(text: str, shape: str) -> None:
        content.append(" ".join(text.split()))
        out.append(shape.format(e(text)))

    loose = r.random() < 0.3
    title = w.words(1, 10)
    put(title, r.choice(["<h1>{0}</h1>", "<h1>{0}</h1>", "<header><h1>{0}</h1></header>", '<h2 class="title">{0}</h2>']))
    for _ in range(r.choice([1, 2, 3, 5, 8, 14, 22])):
        roll = r.random()
        if roll < 0.66:
            put(w.paragraph(), "<p>{0}" if loose else r.choice(["<p>{0}</p>", "<p>{0}</p>", "<div>{0}</div>", '<p><a href="/z">{0}</a></p>' if r.random() < 0.05 else "<p>{0}</p>"]))
        elif roll < 0.74:
            put(w.paragraph(1, 2), "<p><b>{0}<br>")
        elif roll < 0.82:
            put(w.words(1, 6), r.choice(["<h2>{0}</h2>", "<h3>{0}</h3>"]))
        elif roll < 0.88:
            out.append("<ul>" if not loose else "<ol>")
            for _ in range(r.randint(2, 5)):
                put(w.words(1, 14), "<li>{0}" if loose else "<li>{0}</li>")
            out.append("</ul>" if not loose else "</ol>")
        elif roll < 0.91:
            put(w.paragraph(1, 3), "<blockquote>{0}</blockquote>")
        elif roll < 0.94:
            put(w.words(2, 12), '<figure><img src="i.png"><figcaption>{0}</figcaption></figure>')
        elif roll < 0.97:
            out.append("<table>")
            for _ in range(2):
                out.append("<tr>")
                for _ in range(3):
                    put(w.words(1, 3), "<td>{0}</td>")
                out.append("</tr>")
            out.append("</table>")
        else:
            put(w.words(2, 12), "<pre>{0}</pre>")
    return out


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    w, content = _Writer(rng), []
    inner = _article(w, content)
    for kind, chance in (("ad", 0.25), ("share", 0.2), ("form", 0.08), ("side", 0.1)):
        if rng.random() < chance:
            at = rng.randint(1, len(inner))
            if not any(x in ("<ul>", "<ol>", "<table>", "<tr>") for x in inner[:at][-6:]):
                inner.insert(at, _furniture(w, kind))
    if rng.random() < 0.15:
        inner.append(_furniture(w, "comments"))
    a, b = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), _open(rng, "main", ["div", "section", "article", "main"])])
    if rng.random() < 0.25:
        a, b = f"<main>{a}", f"{b}</main>"
    before = [k for k, c in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.6), ("form", 0.15), ("side", 0.12)) if rng.random() < c]
    after = [k for k, c in (("share", 0.2), ("comments", 0.35), ("side", 0.4), ("ad", 0.2), ("form", 0.2), ("notice", 0.15), ("nav", 0.1), ("footer", 0.85)) if rng.random() < c]
    head = f'<!DOCTYPE html><html lang="{w.lang}"><head><title>{escape(content[0])}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    wrap = rng.choice([("", ""), ("", ""), ('<div id="page">', "</div>"), ('<div class="container">', "</div>")])
    parts = [_furniture(w, k) for k in before] + [a, *inner, b] + [_furniture(w, k) for k in after]
    end = "</body></html>" if rng.random() < 0.85 else ""
    return head + wrap[0] + "".join(parts) + wrap[1] + end, content


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]
