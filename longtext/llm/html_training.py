"""Training of the block labeller on generated pages: python -m longtext.llm.html_training."""

from __future__ import annotations

import html
import os
import random

import numpy as np

from .html_extraction import HIDDEN_UNITS, WEIGHTS, backward_side, blocks_of, label_blocks, padded, page_matrix, run_side, sigmoid, start_weights, turned

MARK = "\u0001"

MENU = "Home|About us|Contact|News|Sport|Login|Sign up|Products|Services|Blog|Archive|Careers|Privacy policy|Terms|Help|FAQ|Search|Shop|Support|Start|Kontakt|Accueil|Inicio|Impressum|Next|Previous|Older posts|Categories|Tags".split("|")
NOTICE = "We use cookies to improve your experience.|Accept all|This site uses cookies|Subscribe to our newsletter|Please enable JavaScript|You have 3 free articles left|Log in to continue|Sign up now|Notice: maintenance tonight|Wir verwenden Cookies|Nous utilisons des cookies".split("|")
FOOT = "Copyright 2024 All rights reserved|Follow us on social media|Imprint|Powered by the engine|Terms of use|Contact the editor|Back to top|Sitemap|© 2023".split("|")
REMARK = "Great post, thanks!|I do not agree with this at all.|First!|Can you share the source?|Reply|Report|Posted by|Like|This helped me a lot, thank you.".split("|")
NAMES = {
    "menu": ("menu", "nav", "navbar", "main-nav", "navigation", "topnav", "breadcrumb", "breadcrumbs", "links", "menu-item", "pagination", "pager"),
    "head": ("header", "masthead", "banner", "site-header", "top", "branding", "logo"),
    "side": ("sidebar", "aside", "widget", "related", "right-col", "recommended", "popular", "trending", "side", "share", "social"),
    "ad": ("ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot", "banner-ad"),
    "notice": ("notice", "cookie", "cookie-banner", "alert", "popup", "consent", "newsletter", "subscribe", "modal", "overlay"),
    "foot": ("footer", "site-footer", "bottom", "copyright", "legal", "credits"),
    "form": ("search", "form", "login", "signup", "contact-form"),
    "remarks": ("comments", "comment", "responses", "discussion", "replies", "reader-comments", "disqus"),
    "main": ("content", "post", "article", "entry", "story", "main", "post-content", "article-body", "text", "body-text", "entry-content"),
}


class Maker:
    """Random pages; the text of main blocks carries a mark that is taken out again when the blocks are read."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        parts = ["".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouéäö") for _ in range(r.randint(1, 2))) + r.choice(["", "n", "r", "s", "t"]) for _ in range(60)]
        self.vocabulary = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(400)]
        self.common = self.vocabulary[:20]

    def words(self, n: int) -> str:
        r = self.r
        found = [r.choice(self.common) if r.random() < 0.35 else r.choice(self.vocabulary) for _ in range(n)]
        return " ".join(found)

    def sentence(self, least=4, most=24) -> str:
        r = self.r
        s = self.words(r.randint(least, most)).capitalize()
        if r.random() < 0.1:
            s = " ".join(w + r.choice(["***", "&&&", "%%%", "$$$", "###"]) for w in s.split())
        k = r.random()
        if k < 0.05:
            s = s.replace(" ", " | ")
        elif k < 0.08:
            s = " ".join([self.words(1).capitalize()] * r.randint(5, 60))
        elif k < 0.1:
            s = " ".join(w.upper() + "!!" for w in s.split())
        elif k < 0.4:
            s = s.replace(" ", ", ", 1)
        return s + r.choice([".", ".", ".", "!", "?"])

    def paragraph(self) -> str:
        return self.sentence(1, 5) if self.r.random() < 0.12 else " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 1, 2, 3, 4, 6])))

    def attrs(self, kind: str) -> str:
        r = self.r
        name = r.choice(NAMES[kind])
        if r.random() < 0.3:
            name += r.choice([" wide", " box", " row", " clearfix", "-1", " col"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def box(self, kind: str, tags: tuple, inner: str) -> str:
        """An element for a part of a page: by its own tag, by a named div, or both."""
        r = self.r
        way = r.random()
        if way < 0.45 and tags:
            t = r.choice(tags)
            return f"<{t}>{inner}</{t}>"
        if way < 0.7 and tags:
            t = r.choice(tags)
            return f"<{t}{self.attrs(kind)}>{inner}</{t}>"
        t = r.choice(["div", "div", "section", "ul" if kind == "menu" and "<li" in inner and not inner.startswith("<ul") else "div"])
        return f"<{t}{self.attrs(kind)}>{inner}</{t}>"

    def own(self, text: str, main: bool) -> str:
        safe = html.escape(text, quote=False)
        return MARK + safe if main else safe

    def label(self, pool: list[str]) -> str:
        return self.r.choice(pool) if self.r.random() < 0.5 else self.words(self.r.randint(1, 3))

    def menu(self) -> str:
        r = self.r
        items = [f'<a href="/{i}">{html.escape(self.label(MENU))}</a>' for i in range(r.randint(2, 9))]
        if r.random() < 0.7:
            inner = "<ul>" + "".join(f"<li>{x}" + ("</li>" if r.random() < 0.9 else "") for x in items) + "</ul>"
        else:
            inner = r.choice([" ", " | ", "\n"]).join(items)
        return self.box("menu", ("nav",), inner)

    def chatter(self, pool: list[str]) -> str:
        r = self.r
        return self.own(r.choice(pool) if r.random() < 0.4 else self.sentence(3, 16), False)

    def wrapped(self, text: str) -> str:
        return self.r.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<div>{}</div>", "<small>{}</small>", "<p>{}"]).format(text)

    def side(self) -> str:
        r = self.r
        inner = f"<h3>{html.escape(self.label(['Related', 'Popular posts', 'Archive', 'Tags', 'About the author']))}</h3>" if r.random() < 0.7 else ""
        if r.random() < 0.6:
            inner += "<ul>" + "".join(f'<li><a href="#">{self.chatter(MENU)}</a></li>' for _ in range(r.randint(2, 6))) + "</ul>"
        else:
            inner += "".join(f"<p>{self.chatter(NOTICE)}</p>" for _ in range(r.randint(1, 3)))
        return self.box("side", ("aside",), inner)

    def remarks(self) -> str:
        r = self.r
        one = lambda: self.box("remarks", (), f"<p>{self.own(self.words(1).capitalize(), False)}</p><p>{self.chatter(REMARK)}</p>") if r.random() < 0.5 else f"<li><b>{html.escape(self.words(1))}</b> {self.chatter(REMARK)}</li>"
        items = "".join(one() for _ in range(r.randint(1, 6)))
        head = r.choice(["<h3>Comments</h3>", "<h2>Reader comments</h2>", "", "<h3>Responses</h3>", "<h4>Discussion</h4>"])
        return f"<{(t := r.choice(['div', 'section', 'ol', 'div']))}{self.attrs('remarks')}>{head}{items}</{t}>"

    def form(self) -> str:
        r = self.r
        inner = "".join(f"<label>{html.escape(self.words(1))}</label><input name=x>" for _ in range(r.randint(1, 3)))
        inner += r.choice(["<button>Send</button>", "<button>Search</button>", f"<select><option>{self.words(1)}<option>{self.words(1)}</select>", "<textarea>Your comment</textarea>", f"<p>{self.chatter(NOTICE)}</p>"])
        return f"<form{self.attrs('form') if r.random() < 0.5 else ''}>{inner}</form>"

    def ad(self) -> str:
        return self.box("ad", (), self.wrapped(self.chatter(["Buy now and save 20%", "Sponsored", "Advertisement", "Limited offer", "Special deal"])))

    def notice(self) -> str:
        return self.box("notice", (), "".join(self.wrapped(self.chatter(NOTICE)) for _ in range(self.r.randint(1, 2))))

    def header(self) -> str:
        r = self.r
        inner = r.choice([f"<a href='/'>{html.escape(self.words(2))}</a>", f"<h1>{html.escape(self.words(2).title())}</h1>", f"<p>{self.chatter(MENU)}</p>", f"<div class='logo'>{html.escape(self.words(1))}</div>"])
        if r.random() < 0.4:
            inner += self.menu()
        return self.box("head", ("header",), inner)

    def footer(self) -> str:
        r = self.r
        inner = "".join(self.wrapped(self.chatter(FOOT)) for _ in range(r.randint(1, 3)))
        if r.random() < 0.4:
            inner += self.menu()
        if r.random() < 0.5:
            inner = f"&copy; {self.words(1)}.example.com &middot; {self.chatter(FOOT)}"
        return self.box("foot", ("footer",), inner)

    def article(self) -> str:
        r = self.r
        title = self.sentence(2, 12).rstrip(".") if r.random() < 0.6 else self.sentence(2, 14)
        out = [f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{self.own(title, True)}</{t}>"] if r.random() < 0.9 else []
        if r.random() < 0.15 and out:
            out[0] = f"<header>{out[0]}</header>"
        loose = r.random() < 0.15
        same = self.sentence(1, 6) if r.random() < 0.06 else None
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 20, 20 if same is None else 60])):
            k = r.random()
            text = self.own(self.paragraph() if same is None or r.random() < 0.2 else same, True)
            if r.random() < 0.2:
                text = text.replace(" ", f' <a href="/x">{html.escape(self.words(1))}</a> ', 1)
            if r.random() < 0.15:
                text = text.replace(" ", " <em>", 1) + "</em>"
            if k < 0.6:
                out.append(f"<p>{text}</p>" if not loose else f"<p>{text}")
            elif k < 0.72:
                out.append(f"<p><b>{text}<br>")
            elif k < 0.78:
                out.append(f"<h{(n := r.choice([2, 3, 4]))}>{self.own(self.words(r.randint(1, 6)).capitalize(), True)}</h{n}>")
            elif k < 0.85:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{self.own(self.sentence(2, 12), True)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>")
            elif k < 0.9:
                out.append(f"<blockquote>{r.choice(['', '<p>'])}{text}</blockquote>")
            elif k < 0.93:
                out.append(f"<pre>{self.own(self.words(8), True)}</pre>")
            elif k < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.own(self.words(r.randint(1, 4)), True)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif k < 0.98:
                out.append(f"<div>{text}</div>")
            else:
                out.append(self.ad() if r.random() < 0.5 else self.notice())
        if len(out) > 3 and r.random() < 0.3:
            out = [out[0], *self.sections(out[1:])]
        if r.random() < 0.15:
            out.insert(r.randint(1, len(out)), f"<figure><img src=x><figcaption>{self.own(self.sentence(2, 8), True)}</figcaption></figure>")
        if r.random() < 0.15:
            out.insert(r.randint(1, len(out)), f"<aside{self.attrs('side') if r.random() < 0.5 else ''}>{self.wrapped(self.chatter(NOTICE))}</aside>")
        inner = "".join(out)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            inner = f"<div{self.attrs('main') if r.random() < 0.6 else ''}>{inner}</div>"
        if r.random() < 0.12:
            inner += self.remarks() if r.random() < 0.7 else self.side()
        way = r.random()
        if way < 0.5:
            return f"<article>{inner}</article>"
        if way < 0.65:
            return f"<main>{inner}</main>" if r.random() < 0.5 else f"<main><article>{inner}</article></main>"
        if way < 0.7:
            return inner
        if way < 0.78:
            return f"<article{self.attrs('main')}>{inner}</article>"
        return f"<div{self.attrs('main')}>{inner}</div>"

    def sections(self, parts: list[str]) -> list[str]:
        """Parts of an article dealt over sections with headings."""
        r, out, at = self.r, [], 0
        t = r.choice(["section", "section", "div"])
        while at < len(parts):
            n = r.randint(1, 4)
            head = f"<h3>{self.own(self.words(r.randint(1, 4)).capitalize(), True)}</h3>" if r.random() < 0.7 else ""
            out.append(f"<{t}>{head}{''.join(parts[at : at + n])}</{t}>")
            at += n
        return out

    def page(self) -> str:
        r = self.r
        some = lambda p, f: [f()] if r.random() < p else []
        top = [*some(0.5, self.header), *some(0.75, self.menu), *some(0.3, self.notice), *some(0.45, self.ad)]
        r.shuffle(top)
        low = [*some(0.35, self.side), *some(0.3, self.remarks), *some(0.25, self.form), *some(0.25, self.ad), *some(0.15, self.notice), *some(0.15, self.menu)]
        r.shuffle(low)
        middle = [*some(0.15, self.side), self.article(), *low]
        inner = "".join(middle)
        if r.random() < 0.2:
            inner = f"<main>{inner}</main>"
        if r.random() < 0.3:
            inner = f'<div class="{r.choice(["container", "wrapper", "page", "row"])}">{inner}</div>'
        foot = some(0.8, self.footer)
        tail = "</body></html>" if r.random() < 0.8 else ""
        extra = r.choice(["", '<script>var a="<p>x</p>";</script>', "<!-- note --> ", "<noscript>Enable scripts</noscript>"])
        return f"<!DOCTYPE html><html><head><title>{html.escape(self.words(4))}</title><style>p{{}}</style></head><body>{''.join(top)}{extra}{inner}{''.join(foot)}{tail}"


def example(seed: int) -> tuple[list, np.ndarray]:
    found = blocks_of(Maker(seed).page())
    labels = np.array([MARK in text for _, text, _ in found], float)
    return [(path, text.replace(MARK, "").strip() or "-", linked) for path, text, linked in found], labels


def gradients(pages: list[np.ndarray], labels: list[np.ndarray], w: dict) -> tuple[dict, float]:
    h = HIDDEN_UNITS
    x, y, mask = padded(pages)
    f, kept_f = run_side(x, w["wf"], w["uf"], w["cf"], True)
    b, kept_b = run_side(y, w["wb"], w["ub"], w["cb"], True)
    both = np.concatenate([f, turned(b, pages)], axis=2)
    chance = sigmoid(both @ w["out"] + w["bias"])
    target = np.zeros(mask.shape)
    for i, t in enumerate(labels):
        target[: len(t), i] = t
    error = np.where(mask, chance - target, 0) / mask.sum()
    loss = -float((np.where(mask, target * np.log(chance + 1e-9) + (1 - target) * np.log(1 - chance + 1e-9), 0)).sum() / mask.sum())
    d_both = error[:, :, None] * w["out"]
    g = {"out": np.einsum("tb,tbh->h", error, both), "bias": np.array([error.sum()])}
    g["wf"], g["uf"], g["cf"] = backward_side(x, d_both[:, :, :h], kept_f, w["uf"])
    g["wb"], g["ub"], g["cb"] = backward_side(y, turned(d_both[:, :, h:], pages), kept_b, w["ub"])
    return g, loss


def train(pages: int = 16000, epochs: int = 12, batch: int = 32, rate: float = 4e-3, seed: int = 5) -> dict:
    made = [example(1_000_000 + i) for i in range(pages)]
    made = [(page_matrix(b).astype(np.float64), t) for b, t in made if b]
    rng, w = np.random.default_rng(seed), start_weights(seed)
    m, s, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = np.argsort([len(p) + rng.uniform(0, 8) for p, _ in made])
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        total = 0.0
        for rows in groups:
            g, loss = gradients([made[i][0] for i in rows], [made[i][1] for i in rows], w)
            total += loss
            step += 1
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * (0.5 ** (epoch / 4))
            for k in w:
                x = g[k] * min(1.0, 1.0 / max(size, 1e-9))
                m[k], s[k] = 0.9 * m[k] + 0.1 * x, 0.999 * s[k] + 0.001 * x * x
                w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        print(epoch, round(total / len(groups), 4), flush=True)
    return w


def accuracy(w: dict, pages: int = 400) -> tuple[float, float]:
    """(share of blocks, share of pages) labelled rightly on pages that training did not see."""
    good = blocks = whole = 0
    for i in range(pages):
        b, t = example(i)
        if b:
            right = (label_blocks([page_matrix(b)], w)[0] > 0.5) == (t > 0.5)
            good, blocks, whole = good + right.sum(), blocks + len(t), whole + right.all()
    return good / blocks, whole / pages


if __name__ == "__main__":
    found = train()
    os.makedirs(os.path.dirname(WEIGHTS), exist_ok=True)
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in found.items()})
    print(accuracy({k: v.astype(np.float32) for k, v in found.items()}))
