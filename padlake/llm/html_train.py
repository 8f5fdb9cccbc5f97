"""Makes the weights of the block labeller: ``python -m padlake.llm.html_train`` writes them beside ``html_text``.

Two fifths of the made-up pages have no telling class names and few telling elements, so that the network has to go by what
blocks look like and stand beside.
"""

from __future__ import annotations

import numpy as np

from padlake.llm.html_text import AROUND, CELLS, HASHED, INPUTS, OWN, WEIGHTS, Network, _Vectors, blocks

PAGES, EPOCHS, BATCH, RATE, SEED = 14000, 12, 48, 0.006, 5
#: Share of the blocks whose words are hidden in training, so that the network doesn't lean on made-up words.
HIDDEN = 0.4

MAIN, REST = "\ue000", "\ue001"
#: Words that pages use around their text.
CHROME = {
    "nav": "home about contact login search news sports blog shop help menu start archive topics más inicio accueil startseite kontakt über".split(),
    "footer": "copyright rights reserved privacy terms imprint impressum sitemap legal mentions légales aviso contact © ·".split(),
    "notice": "cookies cookie consent accept privacy policy browser javascript please enable notice continue settings".split(),
    "ad": "advertisement sponsored buy now offer sale discount free click here promoted anzeige publicité".split(),
    "form": "email name subscribe newsletter password submit sign up your send search address".split(),
    "side": "related popular recent posts tags categories most read trending follow share archives".split(),
    "comments": "comment reply says ago comments posted by anonymous like".split(),
}
NAMED = {
    "nav": ("nav", "menu navbar navigation breadcrumb breadcrumbs topnav mainmenu toc pagination".split()),
    "header": ("header", "header masthead top banner site-header topbar branding".split()),
    "footer": ("footer", "footer site-footer bottom copyright colophon foot".split()),
    "notice": ("div", "cookie notice alert consent gdpr popup modal cookie-banner message overlay".split()),
    "ad": ("div", "ad ads advert advertisement sponsored promo adbox banner-ad sponsor".split()),
    "form": ("form", "form newsletter subscribe signup search login contact-form".split()),
    "side": ("aside", "sidebar related widget recommended side share social rail popular tags".split()),
    "comments": ("section", "comments comment-list discussion responses replies disqus reader-comments".split()),
}
ARTICLE = "content post entry article article-body story main text post-content entry-content body-text article-content main-content".split()


class _Maker:
    """Made-up pages whose blocks begin with MAIN or REST."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        #: Whether the page at hand has no telling names.
        self.plain = False
        self.syllables = ["".join(rng.choice(list("bcdfghlmnprst"), 1)) + "".join(rng.choice(list("aeiou"), 1)) + "".join(rng.choice(["", "n", "r", "s", "ch", "é"], 1)) for _ in range(60)]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int, own: tuple | list = ()) -> str:
        out = []
        for _ in range(int(self.rng.integers(low, high))):
            out.append(self.pick(own) if own and self.chance(0.6) else "".join(self.rng.choice(self.syllables, int(self.rng.integers(1, 4)))))
        return " ".join(out)

    def prose(self, low: int = 8, high: int = 60) -> str:
        text = self.words(low, high)
        if self.chance(0.15):
            text = text.upper()
        if self.chance(0.15):
            text = " ".join(w + self.pick(["!!", "***", "&amp;&amp;", " |", "%%%"]) for w in text.split())
        if self.chance(0.15):
            text = " ".join(w for x in text.split()[: int(self.rng.integers(1, 12))] for w in [x] * int(self.rng.integers(3, 40)))
        if self.chance(0.12):
            number = str(int(self.rng.integers(10**6, 10**15)))
            text = self.pick([number, f"+{number[:2]} {number[2:5]} {number[5:]}", f'key = "{number}"', f"{self.words(1, 2)}: {number}", f"{self.words(1, 2)}@{self.words(1, 2)}.org", f"{number[:2]}.{number[2:4]}.{number[4:6]}"]) + " " + text
        return text[:1].upper() + text[1:] + self.pick([".", ".", ".", "", "?", "!"])

    def year(self) -> int:
        return int(self.rng.integers(1995, 2031))

    def byline(self, own: list) -> str:
        name = self.words(1, 3)
        return self.pick([self.words(1, 3, own), f"{name} says:", f"{name}, {int(self.rng.integers(1, 30))} days ago", f"Posted by {name} on {self.year()}-0{int(self.rng.integers(1, 10))}-11", f"{name} wrote at {int(self.rng.integers(1, 24))}:30"])

    def wrap(self, kind: str, inner: str) -> str:
        tag, names = NAMED[kind]
        if self.plain:
            attribute = f' class="{self.words(1, 3)}"' if self.chance(0.6) else ""
            tag = tag if self.chance(0.25) else self.pick(["div", "div", "section"])
            return f"<{tag}{attribute}>{inner}</{tag}>"
        semantic = self.chance(0.6)
        name = self.pick(names) if not semantic or self.chance(0.5) or tag in ("div", "section") else ""
        attribute = f' {self.pick(["class", "class", "id"])}="{name}{self.pick(["", "", " wide", "-1", " box"])}"' if name else ""
        tag = tag if semantic else "div"
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int, own: list) -> str:
        items = [f'<a href="/{k}">{REST}{self.words(1, 4, own)}</a>' for k in range(int(self.rng.integers(low, high)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.8) else "".join(f"<div>{x}</div>" for x in items)

    def rest(self, kind: str) -> str:
        own = CHROME.get(kind, CHROME["nav"])
        tag = self.pick(["p", "div", "span"])
        if kind in ("nav", "header"):
            inner = (f"<h2>{REST}{self.words(1, 4)}</h2><p>{REST}{self.words(2, 9)}</p>" if kind == "header" else "") + (self.links(3, 9, own) if kind == "nav" or self.chance(0.5) else "")
        elif kind == "footer":
            inner = f"<{tag}>{REST}{self.pick(['&copy; ', '', '2024 '])}{self.words(2, 14, own)}</{tag}>" * (1 if self.chance(0.7) else 2) + (self.links(2, 6, own) if self.chance(0.4) else "")
            if self.chance(0.4):
                inner = f"{REST}&copy; {self.words(1, 3)} &middot; {self.prose(2, 20)}"
            elif self.chance(0.4):
                inner = f"<{tag}>{REST}{self.pick(['&copy;', '&copy;', 'Copyright', '(c)'])} {self.year()} {self.words(1, 4)}{self.pick(['', '. All rights reserved.', '.'])}</{tag}>" + inner * self.chance(0.4)
        elif kind == "form":
            inner = "".join(f"<p>{REST}<label>{self.words(1, 3, own)}</label><input></p>" for _ in range(int(self.rng.integers(1, 4)))) + f"<button>{REST}{self.words(1, 3, own)}</button>"
        elif kind == "comments":
            each = self.pick(["<li>{}</li>", "<div>{}</div>"] if self.plain else ['<div class="comment">{}</div>', "<li>{}</li>", "<div>{}</div>", "<article class='comment'>{}</article>"])
            inner = f"<h3>{REST}{self.pick(['', '', '2 ', '14 '])}{self.words(1, 4, own)}</h3>" + "".join(each.format(f"<{self.pick(['h4', 'b', 'div'])}>{REST}{self.byline(own)}</div><p>{REST}{self.prose(3, 40)}</p>" + (f"<div>{REST}{self.pick(['Reply', 'Like', 'Report'])}</div>" if self.chance(0.3) else "")) for _ in range(int(self.rng.integers(1, 6))))
        elif kind == "side" and self.chance(0.25):
            inner = f"<{tag}>{REST}{self.pick(['Categories', 'Tags', 'Filed under', 'Topics', 'Share', 'See also', 'Posted in'])}: {', '.join(self.words(1, 3) for _ in range(int(self.rng.integers(1, 6))))}</{tag}>"
        elif kind == "side":
            inner = f"<h3>{REST}{self.words(1, 4, own)}</h3>" + (self.links(2, 7, own) if self.chance(0.6) else f"<p>{REST}{self.prose(4, 30)}</p>")
        elif self.chance(0.5):
            inner = f"{REST}{self.prose(2, 25) if self.chance(0.6) else self.words(2, 25, own)}"
        else:
            inner = f"<p>{REST}{self.words(3, 25, own)}</p>" + (f"<button>{REST}{self.words(1, 3, own)}</button>" if self.chance(0.4) else "")
        return self.wrap(kind, inner)

    def article(self) -> str:
        inner = [f"<h1>{MAIN}{self.prose(2, 14)}</h1>"] if self.chance(0.9) else []
        if inner and self.chance(0.15):
            inner[0] = f"<header>{inner[0]}</header>"
        block = self.pick(["p", "p", "p", "p", "div"])
        for _ in range(int(self.rng.integers(1, 12))):
            r = self.rng.random()
            if r < 0.12:
                inner.append(f"<{block}>{MAIN}{self.pick([self.words(1, 3).upper() + '!!', 'Licensed under ' + self.words(2, 9) + ', version ' + str(int(self.rng.integers(1, 9))) + '.', self.words(1, 2).title(), *(self.prose(1, 5) for _ in range(4))])}</{block}>")
            elif r < 0.7:
                start = self.pick(["", "", "", "<b>", '<a href="/x">see</a> '])
                inner.append(f"<{block}>{MAIN}{start}{self.prose(1, 90)}" + self.pick(["", "<br>"]) + ("" if self.chance(0.2) and block == "p" else f"</{block}>"))
            elif r < 0.78:
                inner.append(f"<{self.pick(['h2', 'h3'])}>{MAIN}{self.words(1, 8)}</h2>")
            elif r < 0.84:
                inner.append("<ul>" + "".join(f"<li>{MAIN}{self.prose(2, 20)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif r < 0.89:
                inner.append(f"<blockquote><p>{MAIN}{self.prose(5, 40)}</p></blockquote>")
            elif r < 0.92:
                inner.append("<table>" + f"<tr><td>{MAIN}{self.words(1, 4)}</td><td>{MAIN}{self.words(1, 4)}</td></tr>" * 2 + "</table>")
            else:
                inner.append(self.rest(self.pick(["ad", "side", "form", "notice", "nav"])))
        if self.chance(0.1):
            inner.append(f"<footer>{REST}{self.words(2, 8)}</footer>")
        shape = self.rng.random()
        text = "".join(inner)
        if self.plain and self.chance(0.8):
            return text if self.chance(0.3) else f'<div class="{self.words(1, 3)}">{text}</div>' if self.chance(0.7) else f"<div>{text}</div>"
        if shape < 0.4:
            return f"<article>{text}</article>"
        if shape < 0.6:
            return f"<main>{text}</main>" if self.chance(0.5) else f'<main id="{self.pick(ARTICLE)}"><article>{text}</article></main>'
        if shape < 0.93:
            return f'<div {self.pick(["class", "id"])}="{self.pick(ARTICLE)}">{text}</div>'
        return text if self.chance(0.5) else f"<div>{text}</div>"

    def page(self) -> str:
        self.plain = self.chance(0.4)
        before = [self.rest(k) for k in ("notice", "header", "nav", "nav", "ad", "form") if self.chance({"notice": 0.3, "form": 0.15}.get(k, 0.5))]
        after = [self.rest(k) for k in ("ad", "side", "side", "form", "comments", "footer", "notice") if self.chance({"footer": 0.85, "notice": 0.2, "comments": 0.5}.get(k, 0.4))]
        if self.chance(0.3):
            self.rng.shuffle(before)
        side = self.rest("side") if self.chance(0.2) else ""
        body = "".join(before) + side + self.article() + "".join(after)
        return f'<html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>' if self.chance(0.85) else f'<body><div id="wrapper">{body}</div></body>'


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """The network; the same at every call."""
    rng = np.random.default_rng(seed)
    make, vectors, xs, ys = _Maker(rng), _Vectors(), [], []
    for _ in range(pages):
        page = [(path, text, linked) for path, text, linked in blocks(make.page()) if text[0] in MAIN + REST and len(text) > 1]
        if page:
            ys.append(np.array([text[0] == MAIN for _, text, _ in page], np.float32))
            xs.append(vectors.of([(path, text[1:].strip() or "-", max(0, linked - 1)) for path, text, linked in page]))
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"out": init(2 * CELLS), "bias": np.zeros(1, np.float32)}
    for way in "12":
        w |= {f"wx{way}": init(INPUTS, 4 * CELLS), f"wh{way}": init(CELLS, 4 * CELLS), f"b{way}": np.zeros(4 * CELLS, np.float32)}
        w[f"b{way}"][CELLS : 2 * CELLS] = 1
    net, m, s, step = Network(w), {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // BATCH)):
            lengths = np.array([len(xs[k]) for k in some])
            y = np.zeros((len(some), lengths.max()), np.float32)
            for row, k in enumerate(some):
                y[row, : len(ys[k])] = ys[k]
            step += 1
            x = _padded([xs[k] for k in some])
            x[:, :, OWN + AROUND : OWN + AROUND + HASHED] *= rng.random((*x.shape[:2], 1)) >= HIDDEN
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for k, g in net.gradients(x, lengths, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _padded(pages: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(pages), max(map(len, pages)), INPUTS), np.float32)
    for k, page in enumerate(pages):
        x[k, : len(page)] = page
    return x


def main() -> None:
    np.savez_compressed(WEIGHTS, **{name: w.astype(np.float16) for name, w in train().weights.items()})


if __name__ == "__main__":
    main()
