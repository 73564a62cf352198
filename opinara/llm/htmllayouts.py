"""Made pages with known main text, in many layouts: what the trees of htmltext.py are fitted on and tested with.

Every text begins with MAIN (the article) or NONE (all else), so that a page carries its own labels. Words are made of random
syllables: layouts, not languages, are to be learned.
"""

from __future__ import annotations

import random

MAIN, NONE = "\x01", "\x02"

_CONTENT = (
    "content main article post entry body text story page primary single hentry markdown prose document mainContent articleBody post-content entry-content article-body"
    " story-body blog-post main-content page-content rich-text news detail"
).split()
_NEUTRAL = "container wrapper wrap inner row col grid layout outer site box section block module center left right clearfix content-wrapper page-wrapper area holder".split()
_BOILER = {
    "nav": "nav navbar menu navigation main-menu topnav nav-links menu-list breadcrumb breadcrumbs pagination pager tabs toolbar skip-link language-switcher sitemap".split(),
    "header": "header site-header masthead topbar top-bar banner branding logo site-title tagline page-header hero-banner".split(),
    "footer": "footer site-footer page-footer bottom copyright legal colophon footer-links foot credits".split(),
    "aside": "sidebar side-bar aside widget widget-area secondary rail related related-posts recommended most-read popular trending recent-posts more-stories tags tag-list categories archive".split(),
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert warning popup modal overlay newsletter-popup announcement toast paywall message-bar disclaimer".split(),
    "ad": "ad ads advert advertisement ad-slot adsbygoogle sponsored sponsor promo promotion banner-ad ad-container dfp outbrain taboola commercial partner".split(),
    "form": "form search search-form login signup subscribe newsletter contact-form comment-form register subscription".split(),
    "comments": "comments comment comment-list commentlist discussion responses reply replies disqus user-comments reader-comments comment-body feedback reviews".split(),
    "share": "share social share-buttons social-links sharing follow-us byline-tools tools print-link author-box author-bio meta-links".split(),
}
_HEADINGS = "Related|More|Comments|Share|Tags|Menu|Search|Follow us|Recent posts|Subscribe|Archive".split("|")


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.stems = ["".join(r.choice("bcdfghklmnprstvzéüñ") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(120)]
        self.noisy = r.random() < 0.25
        self.ends_p = r.random() < 0.8

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = [self.r.choice(self.stems) + (self.r.choice(("&amp;&amp;", "###", "***", "$$")) if self.noisy else "") for _ in range(n)]
        return " ".join(w + ("," if self.r.random() < 0.08 else "") for w in out)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 22).capitalize() + self.r.choice("....?!") for _ in range(self.r.randint(low, high)))

    def named(self, names: list[str], always: bool = False) -> str:
        r = self.r
        if not always and r.random() < 0.25:
            return ""
        shape = r.choice(("{}", "{}", "{}", "{}-wrap", "js-{}", "{}-1", "c-{}", "{} " + r.choice(_NEUTRAL)))
        return f" {r.choice(('class', 'class', 'class', 'id'))}=\"{shape.format(r.choice(names))}\""

    def neutral(self) -> str:
        return self.named(_NEUTRAL) if self.r.random() < 0.6 else ""

    def p(self, mark: str, low: int = 1, high: int = 7) -> str:
        r, text = self.r, self.sentences(low, high)
        kind = r.random()
        if kind < 0.1:
            text = f"<b>{mark}{text}</b>" if r.random() < 0.7 else f"<b>{mark}{text}<br>"
        elif kind < 0.25:
            text = f"{text} <a href=\"/{r.choice(self.stems)}\">{mark}{self.words(1, 5)}</a>, {mark}{self.sentences(1, 2)}"
        elif kind < 0.35:
            text = f"{text} <em>{mark}{self.words(1, 3)}</em> <span{self.neutral()}>{mark}{self.sentences(1, 1)}</span>"
        return f"<p{self.neutral() if r.random() < 0.15 else ''}>{mark}{text}{'</p>' if self.ends_p or r.random() < 0.6 else ''}"

    def links(self, n: int, attributes: str = "") -> str:
        r = self.r
        items = [f"<a href=\"/{r.choice(self.stems)}\">{NONE}{self.words(1, 5 if n > 4 else 9)}</a>" for _ in range(n)]
        if r.random() < 0.7:
            return f"<ul{attributes}>{''.join(f'<li>{i}</li>' for i in items)}</ul>"
        return f"<div{attributes}>{f' {NONE}| '.join(items) if r.random() < 0.5 else ' '.join(items)}</div>"

    def title(self, mark: str, tags: str = "h2 h3 h4") -> str:
        tag = self.r.choice(tags.split())
        return f"<{tag}>{mark}{self.words(1, 9).capitalize() if mark == MAIN else self.r.choice(_HEADINGS)}</{tag}>"

    def boiler(self, kind: str) -> str:
        r, names = self.r, _BOILER[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section", "ad": "aside", "notice": "section"}.get(kind, "div")
        if kind == "ad" and r.random() < 0.15:
            tag = "ins"
        a = self.named(names, always=tag != "nav" and tag != "header" and tag != "footer")
        if r.random() < 0.55 and kind != "form":
            tag, a = "div", self.named(names, always=True)
        text = lambda low, high: f"{r.choice(('<p>', '<div>', ''))}{NONE}{self.sentences(low, high)}"
        inner = {
            "nav": lambda: self.links(r.randint(2, 12), self.neutral()),
            "header": lambda: f"<div{self.named(['logo', 'brand', 'site-title'])}><a href=\"/\">{NONE}{self.words(1, 3)}</a></div>" + (f"<p>{NONE}{self.words(2, 8)}</p>" if r.random() < 0.6 else "") + (self.boiler("nav") if r.random() < 0.5 else ""),
            "footer": lambda: f"{r.choice(('<p>', '', '<small>'))}{NONE}&copy; {self.words(1, 4)} {r.choice(('&middot;', '|', '-'))} {self.sentences(1, 3)}" + (self.links(r.randint(2, 6)) if r.random() < 0.4 else ""),
            "aside": lambda: "".join((self.title(NONE) if r.random() < 0.6 else "") + r.choice((lambda: self.links(r.randint(2, 8)), lambda: text(1, 4)))() for _ in range(r.randint(1, 3))),
            "notice": lambda: text(1, 3) + r.choice((f"<button>{NONE}OK</button>", f"<a href=\"#\">{NONE}{self.words(1, 3)}</a>", "")),
            "ad": lambda: r.choice((lambda: text(1, 4), lambda: f"{NONE}{self.sentences(1, 3)}", lambda: f"<a href=\"/ad\"><img src=\"a.png\">{NONE}{self.sentences(1, 2)}</a>"))(),
            "form": lambda: f"<label>{NONE}{self.words(1, 4)}</label><input name=q>" * r.randint(1, 3) + (f"<p>{NONE}{self.sentences(1, 2)}</p>" if r.random() < 0.4 else "") + f"<button>{NONE}Go</button>",
            "comments": lambda: (self.title(NONE) if r.random() < 0.7 else "") + "".join(f"<{t}{self.named(names)}><span{self.named(['author', 'user', 'date'])}>{NONE}{self.words(1, 2)}</span>{self.p(NONE, 1, 5)}</{t}>" for t in [r.choice(("li", "div", "article"))] for _ in range(r.randint(1, 7))) + (self.boiler("form") if r.random() < 0.4 else ""),
            "share": lambda: self.links(r.randint(2, 5)) if r.random() < 0.7 else f"{NONE}{self.words(1, 3)} {self.links(2)}",
        }[kind]()
        if r.random() < 0.2:
            inner = f"<div{self.neutral()}>{inner}</div>"
        return f"<{tag}{a}>{inner}</{tag}>"

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.72:
            return self.p(MAIN)
        if kind < 0.82:
            return self.title(MAIN)
        if kind < 0.88:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>{''.join(f'<li>{MAIN}{self.sentences(1, 2) if r.random() < 0.6 else self.words(1, 8)}</li>' for _ in range(r.randint(2, 7)))}</{tag}>"
        if kind < 0.92:
            return f"<blockquote{self.neutral()}>{self.p(MAIN)}</blockquote>"
        if kind < 0.95:
            return f"<figure><img src=\"i.png\"><figcaption>{MAIN}{self.sentences(1, 1)}</figcaption></figure>"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MAIN}{self.words(1, 3)}" for _ in range(3)) for _ in range(r.randint(2, 5))) + "</table>"
        return f"<pre>{MAIN}{self.words(5, 30)}</pre>" if kind < 0.985 else f"<div{self.neutral()}>{MAIN}{self.sentences(1, 4)}</div>"

    def article(self) -> str:
        r = self.r
        n = r.choice((0, 1, 1, 2, 3, 5, 8, 14, 25))
        blocks = [self.block() for _ in range(n)] or [self.p(MAIN, 1, 3)]
        if r.random() < 0.12:
            blocks = [f"{MAIN}{self.sentences(1, 5)}<br><br>" for _ in blocks]
        if r.random() < 0.75:
            head = self.title(MAIN, "h1 h1 h1 h2")
            if r.random() < 0.2:
                tag = r.choice(("header", "div"))
                head = f"<{tag}{self.named('entry-header article-header post-header story-header headline title'.split())}>{head}</{tag}>"
            blocks.insert(0, head)
        for kind in ("share", "ad", "aside", "form", "notice", "nav"):
            if r.random() < 0.09:
                blocks.insert(r.randint(0, len(blocks)), self.boiler(kind))
        inner = "".join(blocks)
        if r.random() < 0.2:
            inner = f"<div{self.named(_CONTENT)}>{inner}</div>"
        kind = r.random()
        if kind < 0.45:
            return f"<article{self.named(_CONTENT) if r.random() < 0.5 else ''}>{inner}</article>"
        if kind < 0.85:
            return f"<{(t := r.choice(('div', 'div', 'div', 'section', 'main')))}{self.named(_CONTENT, always=t != 'main')}>{inner}</{t}>"
        return f"<div>{inner}</div>" if kind < 0.92 else inner

    def html(self) -> str:
        r = self.r
        around = lambda kinds: "".join(self.boiler(k) for k in r.sample(kinds, r.randint(0, len(kinds))))
        body = self.article()
        if r.random() < 0.04:  # nothing but text
            return r.choice((f"{MAIN}{self.sentences(1, 9)}", f"<html><body>{MAIN}{self.sentences(1, 9)}</body></html>", body))
        if r.random() < 0.3:
            side = around(["aside", "ad", "form"])
            if r.random() < 0.2:
                side = side or self.links(r.randint(2, 6))
                head = f"<tr><td colspan=2>{NONE}{self.words(1, 3)}</td></tr>" if r.random() < 0.5 else ""
                body = f"<table>{head}<tr><td{self.neutral()}>{side}</td><td{self.neutral()}>{body}</td></tr></table>"
            else:
                body = side + body if r.random() < 0.4 else body + side
        if r.random() < 0.4:
            body = f"<{(t := r.choice(('main', 'div', 'div', 'form')))}{self.neutral() or self.named(_CONTENT[:3])}>{body}</{t}>"
        top = (self.boiler("header") if r.random() < 0.5 else "") + (self.boiler("nav") if r.random() < 0.7 else "") + around(["notice", "ad", "form"])
        end = (self.boiler("comments") if r.random() < 0.35 else "") + around(["aside", "ad", "share", "notice"]) + (self.boiler("footer") if r.random() < 0.85 else "")
        whole = f"{top}<!-- x -->{body}{end}"
        if r.random() < 0.4:
            whole = f"<div{self.neutral()}>{whole}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var a = '<p>';</script></head><body{self.neutral()}>{whole}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    return [_Page(seed * 1_000_003 + i).html() for i in range(n)]
