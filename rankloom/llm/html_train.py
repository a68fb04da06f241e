"""Fits the block labeller to generated pages: python -m rankloom.llm.html_train

Pages are drawn from a grammar of layouts: menus, headers, notices, adverts, sidebars, forms,
reader comments and footers around and inside an article, in semantic tags or in plain
``div`` with telling or meaningless class names, closed properly or not, cut off or whole.
Words are invented, so that the labeller can't learn an article's vocabulary.
"""

from __future__ import annotations

import random

import numpy as np

from .html import BUCKETS, COUNTS, PATH, STATE, WEIGHTS, WORD, Inputs, Labeller, _sigmoid, blocks

#: A character that marks article text in generated pages; it is taken away again before the blocks are read.
SIGN = "␂"

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch ée qu eau aux ung sch ción".split()
NEUTRAL = "wrap wrapper inner outer row col container box block x1 a7 css-1q grid flex page site l-main layout c3 u-full section unit".split()
CONTENT = "content article post entry story main body text article-body post-content entry-content main-content page-content storytext".split()
KINDS = {
    "menu": ("nav", "menu nav navbar navigation main-menu topnav breadcrumb breadcrumbs pagination site-nav links toc".split()),
    "header": ("header", "header masthead top topbar site-header branding banner logo".split()),
    "ad": ("div", "ad ads advert advertisement sponsored promo ad-slot banner-ad ad-container adbox promotion sponsor".split()),
    "side": ("aside", "sidebar side widget related aside secondary rail recommended more-stories trending popular".split()),
    "notice": ("div", "notice cookie cookies cookie-banner alert consent gdpr warning message modal popup overlay newsletter paywall".split()),
    "form": ("form", "form search search-form subscribe login signup contact newsletter-form".split()),
    "comments": ("section", "comments comment comment-list commentlist responses discussion replies reader-comments disqus reply".split()),
    "footer": ("footer", "footer foot bottom site-footer copyright legal colophon page-footer".split()),
    "share": ("div", "share social sharing tags byline meta author post-meta article-meta date author-bio credits".split()),
}
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Sports", "Next", "Previous", "More", "Archive", "Skip to content"],
    "header": ["Menu", "Log in", "Subscribe", "Daily News", "Search"],
    "ad": ["Advertisement", "Sponsored", "Buy now!", "Ad"],
    "side": ["Related", "Most read", "Popular posts", "You may also like", "Tags"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "Please enable JavaScript.", "Got it"],
    "form": ["Search", "Email address", "Subscribe", "Submit", "Your name", "Send"],
    "comments": ["Comments", "Reply", "3 comments", "says:", "Great article!", "Leave a reply", "Posted by", "Anonymous"],
    "footer": ["&copy; 2024", "All rights reserved.", "Privacy policy", "Terms of use", "Contact us", "&copy;"],
    "share": ["Share", "Tweet", "By", "Published", "min read", "Filed under"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))
        if self.r.random() < 0.15:
            w = w.capitalize()
        if self.odd:
            w += self.r.choice(("", "$$$", "###", "&amp;&amp;", "!!", " |"))
        return w

    def prose(self, least: int = 3, most: int = 60) -> str:
        words = [self.word() for _ in range(self.r.randint(least, most))]
        for i in range(len(words)):
            if self.r.random() < 0.07:
                words[i] += self.r.choice((",", ".", ".", "&nbsp;", "&mdash;"))
        return words[0].capitalize() + " ".join(["", *words[1:]]) + "."

    def inline(self, text: str, sign: str) -> str:
        k = self.r.random()
        words = text.split(" ")
        if k < 0.1:
            at = self.r.randrange(len(words))
            words[at] = f'<a href="/{self.r.randint(1, 99)}">{words[at]}</a>'
        elif k < 0.2:
            at = self.r.randrange(len(words))
            tag = self.r.choice(("b", "i", "em", "strong", "span", "code"))
            words[at] = f"<{tag}>{words[at]}" + (f"</{tag}>" if self.r.random() < 0.7 else "")
        elif k < 0.3:
            words[self.r.randrange(len(words))] += "<br>"
        return sign + " ".join(words)

    def attr(self, names: list[str], strong: bool) -> str:
        own = [self.r.choice(NEUTRAL)] if self.r.random() < 0.3 else []
        if strong or self.r.random() < 0.6:
            own.insert(0, self.r.choice(names))
        if not own:
            return ""
        k = self.r.choice(("class", "class", "id"))
        return f" {k}={self.r.choice((chr(34), chr(39)))}".rstrip("'\"") + f'"{" ".join(own)}"'

    def wrap(self, kind: str, inner: str) -> str:
        tag, names = KINDS[kind]
        semantic = tag != "div" and tag != "section" and self.r.random() < 0.6
        name = tag if semantic else self.r.choice(("div", "div", "section", "div", "ul" if kind == "menu" else "div"))
        role = {"menu": "navigation", "footer": "contentinfo", "header": "banner", "side": "complementary", "form": "search", "notice": "alert"}.get(kind)
        extra = f' role="{role}"' if role and self.r.random() < 0.1 else ""
        return f"<{name}{self.attr(names, not semantic)}{extra}>{inner}</{name}>"

    def bits(self, kind: str) -> str:
        r = self.r
        phrase = lambda: r.choice(PHRASES[kind]) if r.random() < 0.5 else self.prose(1, 8).rstrip(".")
        if kind in ("menu", "footer") and r.random() < 0.75:
            items = [f'<a href="/{i}">{phrase()}</a>' for i in range(r.randint(2, 9))]
            style = r.random()
            body = "<ul>" + "".join(f"<li>{x}" + ("</li>" if r.random() < 0.8 else "") for x in items) + "</ul>" if style < 0.7 else " ".join(items) if style < 0.85 else "".join(f"<div>{x}</div>" for x in items)
            return body + (f"<p>{phrase()}</p>" if kind == "footer" else "")
        if kind == "form":
            return "".join(r.choice((f"<label>{phrase()}</label>", "<input name=q>", f"<button>{phrase()}</button>", f"<p>{phrase()}</p>")) for _ in range(r.randint(1, 4)))
        if kind == "comments":
            inner = "ol" if r.random() < 0.5 else "div"
            item = "li" if inner == "ol" else r.choice(("div", "article", "div"))
            rows = "".join(
                f"<{item}{self.attr(['comment', 'reply', 'response', 'c'], False)}><p>{phrase()}</p>" + "".join(f"<p>{self.prose()}</p>" for _ in range(r.randint(1, 2))) + f"</{item}>"
                for _ in range(r.randint(1, 5)))
            return (f"<h3>{phrase()}</h3>" if r.random() < 0.6 else "") + f"<{inner}>{rows}</{inner}>" + (self.wrap("form", self.bits("form")) if r.random() < 0.4 else "")
        if kind == "side":
            return "".join(
                (f"<h{r.randint(2, 4)}>{phrase()}</h3>" if r.random() < 0.5 else "") + r.choice((f"<p>{self.prose()}</p>", "<ul>" + "".join(f'<li><a href="#">{self.prose(2, 9)}</a></li>' for _ in range(r.randint(2, 6))) + "</ul>"))
                for _ in range(r.randint(1, 3)))
        if kind == "header":
            return r.choice((f"<h1>{phrase()}</h1>", f"<div>{phrase()}</div>", f"<p>{phrase()}</p>", f"<a href='/'>{phrase()}</a>")) + (self.wrap("menu", self.bits("menu")) if r.random() < 0.5 else "")
        text = phrase() if r.random() < 0.4 else self.prose(3, 40)
        return r.choice((text, text, f"<p>{text}</p>", f"<p>{text}</p><p>{self.prose(2, 20)}</p>", f"<span>{text}</span>"))

    def paragraph(self) -> str:
        r, k = self.r, self.r.random()
        text = lambda least=1, most=80: self.inline(self.prose(least, most), SIGN)
        if k < 0.72:
            return f"<p>{text()}" + ("</p>" if r.random() < 0.85 else "")
        if k < 0.8:
            return f"<h{r.randint(2, 4)}>{text(1, 8)}</h2>"
        if k < 0.86:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{text(1, 20)}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if k < 0.9:
            return f"<blockquote><p>{text()}</p></blockquote>"
        if k < 0.93:
            return f"<pre>{text(2, 20)}</pre>"
        if k < 0.96:
            return f"<div>{text()}</div>"
        if k < 0.98:
            return f"<figure><img src=x><figcaption>{text(2, 15)}</figcaption></figure>"
        return "<table><tr>" + "".join(f"<td>{text(1, 4)}</td>" for _ in range(4)) + "</tr></table>"

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.inline(self.prose(2, 12), SIGN)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.25:
            title = f"<header>{title}" + (self.wrap("share", self.bits("share")) if r.random() < 0.3 else "") + "</header>"
        parts = [title]
        messy = r.random() < 0.4
        if r.random() < 0.1:  # many blocks alike, and long pages
            text = self.prose(1, 5)
            return self.framed("".join([title, *(f"<p>{SIGN}{text}</p>" for _ in range(r.choice((5, 20, 80, 150))))]))
        for _ in range(r.choice((1, 2, 3, 5, 8, 13, 20, 20, 60)) if r.random() < 0.95 else 150):
            if messy and r.random() < 0.25:
                parts.append(f"<p><b>{self.inline(self.prose(1, 60), SIGN)}<br>")
            else:
                parts.append(self.paragraph())
            if r.random() < 0.06:
                kind = r.choice(("ad", "side", "share", "form", "notice", "ad"))
                parts.append(self.wrap(kind, self.bits(kind)))
        if r.random() < 0.15:
            parts.append(self.wrap("share", self.bits("share")))
        if r.random() < 0.08:
            parts.append(f"<footer>{self.bits('share')}</footer>")
        if r.random() < 0.1:
            parts.append(self.wrap("comments", self.bits("comments")))
        return self.framed("".join(parts))

    def framed(self, inner: str) -> str:
        r = self.r
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        strong = tag in ("div", "section", "td")
        if tag == "td":
            return f"<table><tr><td{self.attr(CONTENT, True)}>{inner}</td></tr></table>"
        return f"<{tag}{self.attr(CONTENT, strong)}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        self.odd = r.random() < 0.1
        before, after = [], []
        for kind, chance, where in (
            ("notice", 0.25, before), ("header", 0.45, before), ("menu", 0.65, before), ("form", 0.12, before), ("ad", 0.45, before), ("side", 0.12, before),
            ("share", 0.12, after), ("ad", 0.25, after), ("side", 0.35, after), ("comments", 0.4, after), ("form", 0.15, after), ("notice", 0.15, after),
            ("menu", 0.15, after), ("footer", 0.75, after),
        ):
            if r.random() < chance:
                where.append((f"<!-- {kind} {r.randint(0, 9)} -->" if r.random() < 0.2 else "") + self.wrap(kind, self.bits(kind)))
        if r.random() < 0.25:
            r.shuffle(before)
        if r.random() < 0.25:
            foot = after.pop() if after else ""
            r.shuffle(after)
            after.append(foot)
        body = self.article()
        if r.random() < 0.3:
            tag = r.choice(("main", "div", "div"))
            body = f"<{tag}{self.attr(NEUTRAL + CONTENT, False)}>{body}" + ("".join(after[:-1]) if r.random() < 0.5 and len(after) > 1 else "") + f"</{tag}>"
            if after and "".join(after[:-1]) in body:
                after = after[-1:]
        whole = "".join(before) + body + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            whole = f"<div{self.attr(NEUTRAL, False)}>{whole}</div>"
        head = f'<head><meta charset="utf-8"><title>{self.prose(1, 10)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        out = f'<!DOCTYPE html><html lang="en">{head if r.random() < 0.9 else ""}<body{self.attr(NEUTRAL, False) if r.random() < 0.2 else ""}>{whole}</body></html>'
        if r.random() < 0.12:
            out = out[: r.randint(len(out) // 2, len(out))]
        return out


def examples(seed: int, count: int):
    made, maker = [], Maker(seed)
    while len(made) < count:
        found = blocks(maker.page())
        if not found:
            continue
        marks = np.array([SIGN in b.text for b in found], dtype=float)
        for b in found:
            b.text = b.text.replace(SIGN, "").strip() or "-"
        made.append((found, marks))
    return made


def gradient(net: Labeller, x: Inputs, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    w = net.w
    flat = net.inputs(x)
    padded, mask, place = net.padded(flat, x.sizes)
    steps, pages, width = padded.shape
    ahead, kept_a = net.run(w["forward"], padded, mask, keep=True)
    back, kept_b = net.run(w["backward"], padded[::-1], mask[::-1], keep=True)
    joined = np.concatenate([ahead.reshape(-1, STATE)[place], back[::-1].reshape(-1, STATE)[place], flat[:, :PATH], np.ones((len(flat), 1))], axis=1)
    p = _sigmoid(joined @ w["out"])
    loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
    d = (p - y) / len(y)
    grads = {"out": joined.T @ d}
    dj = d[:, None] * w["out"][None, :]
    dx = np.zeros((steps * pages, width))
    dx[place, :PATH] += dj[:, 2 * STATE : 2 * STATE + PATH]

    def through(name: str, kept, given: np.ndarray, m: np.ndarray, dout: np.ndarray) -> np.ndarray:
        weights = w[name]
        wh = weights[width:-1]
        dh, dc = np.zeros((pages, STATE)), np.zeros((pages, STATE))
        dz_all, h_all = np.zeros((steps, pages, 4 * STATE)), np.zeros((steps, pages, STATE))
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tanh = kept[t]
            h_all[t] = h
            dh = dh + dout[t]
            on = m[t][:, None]
            dnew = np.where(on, dh, 0)
            dcell = np.where(on, dc, 0) + dnew * o * (1 - tanh**2)
            dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dnew * tanh * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            dh = np.where(on, dz @ wh.T, dh)
            dc = np.where(on, dcell * f, dc)
        flat_dz = dz_all.reshape(-1, 4 * STATE)
        grads[name] = np.concatenate([given.reshape(-1, width).T @ flat_dz, h_all.reshape(-1, STATE).T @ flat_dz, flat_dz.sum(0)[None]])
        return (flat_dz @ weights[:width].T).reshape(steps, pages, width)

    out_a, out_b = np.zeros((steps * pages, STATE)), np.zeros((steps * pages, STATE))
    out_a[place], out_b[place] = dj[:, :STATE], dj[:, STATE : 2 * STATE]
    dx += through("forward", kept_a, padded, mask, out_a.reshape(steps, pages, STATE)).reshape(-1, width)
    dx += through("backward", kept_b, padded[::-1], mask[::-1], out_b.reshape(steps, pages, STATE)[::-1])[::-1].reshape(-1, width)
    dflat = dx[place]
    for name, ids, sizes, part in (("path", x.path_ids, x.path_sizes, dflat[:, :PATH]), ("word", x.word_ids, x.word_sizes, dflat[:, PATH : PATH + WORD] / np.maximum(x.word_sizes, 1)[:, None])):
        grads[name] = np.zeros_like(w[name])
        if sizes.sum():
            np.add.at(grads[name], ids, np.repeat(part, sizes, axis=0))
    return loss, grads


def accuracy(net: Labeller, made) -> tuple[float, float]:
    """Share of blocks and of whole pages that are right."""
    got = net.label([f for f, _ in made])
    right = [(p >= 0.5) == (y > 0.5) for p, (_, y) in zip(got, made)]
    return float(np.mean(np.concatenate(right))), float(np.mean([r.all() for r in right]))


def fit(pages: int = 24_000, epochs: int = 8, batch: int = 48, seed: int = 7, rate: float = 0.006, log=print) -> Labeller:
    rng = np.random.default_rng(seed)
    net = Labeller({k: rng.normal(0, 0.3 if k in ("path", "word") else 0.15, s) for k, s in Labeller.SHAPES.items()})
    for k in ("forward", "backward"):
        net.w[k][-1] = 0
        net.w[k][-1, STATE : 2 * STATE] = 1
    data, held = examples(seed, pages), examples(seed + 1, 1000)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step, total = 0, epochs * -(-pages // batch)
    for epoch in range(epochs):
        order = np.argsort([len(f) + rng.random() * 8 for f, _ in data])
        starts = rng.permutation(np.arange(0, len(order), batch))
        losses = []
        for at in starts:
            own = [data[i] for i in order[at : at + batch]]
            loss, grads = gradient(net, Inputs([f for f, _ in own]), np.concatenate([y for _, y in own]))
            losses.append(loss)
            step += 1
            lr = rate * min(1, step / 100) * (1 - 0.97 * step / total)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        log(f"epoch {epoch}: loss {np.mean(losses):.4f}, held out {accuracy(net, held)}")
    return net


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in fit().w.items()})
