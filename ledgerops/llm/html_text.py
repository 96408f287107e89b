"""Main text of web pages: a recurrent labeller over the sequence of leaf blocks.

A page is cut into blocks of text at block-level tags. Each block becomes a vector: hashed names and class words on its tag path, mean of hashed
word vectors, and a few sizes. A bidirectional LSTM in numpy reads the blocks of a page in both directions, so each label depends on the whole page.
The network is trained here, on generated page layouts whose labels are known; it is a few thousand numbers.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerops.llm import words as W
from ledgerops.llm.tables import slices

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORD = re.compile("[a-z]+|[0-9]+")
_DIGIT = re.compile("[0-9]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_HIDDEN = frozenset("head noscript template select option datalist button canvas audio video map".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var object param".split()
)
#: Names inside drawings and formulas: they do not end a block, and a slash closes them.
_FOREIGN = frozenset(
    "svg circle clippath defs desc ellipse filter g image line lineargradient marker mask metadata path pattern polygon polyline radialgradient rect stop symbol text textpath tspan use "
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
_INLINE |= _FOREIGN
#: Start tags that leave an open head open; any other, or text, ends it.
_IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())
_BLANK = " \t\n\r\f"
#: Block-level tags that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
_CLOSE = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_DEPTH = 10
_PATH, _LEAF, _WORDS, _SIZES = 32, 16, 12, 8
INPUT = _PATH + _LEAF + _WORDS + _SIZES
HIDDEN = 20


def blocks_of(page: str) -> list[tuple[str, tuple[tuple[str, ...], ...], float, str]]:
    """(text, names on the tag path, share of linked characters, given label) of each block with text, in page order.

    Character references are decoded, and white space inside a block is one space. Script, style, title, hidden and form-control text is left out.
    The end tag of a head and the start tag of a body may be missing: what may not stand in a head ends it. Text of formulas, drawings, objects and xmp is text.
    """
    out: list[tuple[str, tuple, float, str]] = []
    stack: list[tuple[str, tuple[str, ...], str]] = []
    parts: list[str] = []
    linked = links = hidden = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(s[1] for s in stack if s[0] not in _INLINE)[-_DEPTH:]
                label = next((s[2] for s in reversed(stack) if s[2]), "")
                out.append((text, path, min(1.0, linked / len(text)), label))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links, hidden
        for name, *_ in stack[to:]:
            links -= name == "a"
            hidden -= name in _HIDDEN
        del stack[to:]

    def end_head() -> None:
        while stack and stack[-1][0] == "head":
            pop(len(stack) - 1)

    def add(text: str, raw: bool = False) -> None:
        nonlocal linked
        if hidden and stack[-1][0] == "head" and text.strip(_BLANK):
            end_head()
        if text and not hidden:
            text = text if raw else html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if m["end"] or m["end2"]:
            if name not in _INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if name in _INLINE and stack[k][0] not in _INLINE:
                    break
            continue
        if name not in _IN_HEAD:
            end_head()
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in _RAW:
            if attrs.endswith("/") and any(s[0] in ("svg", "math") for s in stack):
                continue
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            inside, at = at, close.start() if close else n
            if name == "xmp":
                flush()
                add(page[inside:at], raw=True)
                flush()
            if close:
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            continue
        if name not in _INLINE:
            flush()
            if name == "body":
                pop(0)
            elif name in _ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] not in _INLINE:
                        break
            if name in _CLOSE:
                names, stop = _CLOSE[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in names.split():
                        pop(k)
                        break
                    if stack[k][0] in stop:
                        break
        if name in _VOID or attrs.endswith("/") and (name in _FOREIGN or name not in _INLINE and name not in _ENDS_P):
            continue
        tokens, label = [name], ""
        if attrs and name not in _INLINE:
            for key, a, b, c in _ATTR.findall(attrs):
                if key == "data-y":
                    label = a or b or c
                else:
                    tokens += [f".{w}" for w in _WORD.findall((a or b or c).lower())]
        links += name == "a"
        hidden += name in _HIDDEN
        stack.append((name, tuple(tokens[:9]), label))
    flush()
    return out


def _vector(token: str, size: int, salt: int) -> np.ndarray:
    seed = W.word_hashes(np.frombuffer(token.encode(), dtype=np.uint8), np.array([0]), np.array([len(token.encode())]))[0]
    state = W.mix((np.arange(size, dtype=np.uint64) + np.uint64(salt * 1000 + 1)) * W._BASE ^ seed)
    return ((state >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1) * np.float32(1.7)


@lru_cache(maxsize=20_000)
def _token(token: str, leaf: bool) -> np.ndarray:
    return _vector(token, _LEAF if leaf else _PATH, int(leaf))


@lru_cache(maxsize=20_000)
def _path(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Sum over the path, nearer elements counting more, and the leaf's own names.

    Names that no training page has say nothing: class words of other makers are left out, and elements count as the plainest of their kind.
    """
    path = tuple((_PLAIN.get(e[0], e[0] if e[0] in _TAGS else "div"), *(n for n in e[1:] if n in _CLASSES)) for e in path)
    total, leaf = np.zeros(_PATH, np.float32), np.zeros(_LEAF, np.float32)
    for depth, names in enumerate(reversed(path)):
        for name in names:
            total += _token(name, False) * np.float32(0.8**depth / len(names) ** 0.5)
    for name in path[-1] if path else ():
        leaf += _token(name, True) / np.float32(len(path[-1]) ** 0.5)
    return np.concatenate([total, leaf])


_WORD_TABLE = np.random.default_rng(5).normal(0, 1, (4096, _WORDS)).astype(np.float32)


def _inputs(pages: list[list[tuple]]) -> list[np.ndarray]:
    """One matrix (blocks x INPUT) per page."""
    flat = [b for p in pages for b in p]
    if not flat:
        return [np.zeros((0, INPUT), np.float32) for _ in pages]
    raw, bounds = W.text_bytes(pa.array([b[0] for b in flat], type=pa.large_string()))
    start, end, first = W.word_spans(raw, bounds)
    slots = (W.word_hashes(raw, start, end) >> np.uint64(52)).astype(np.int64)
    count = np.diff(first)
    mean = np.zeros((len(flat), _WORDS), np.float32)
    full = np.flatnonzero(count > 0)
    for at in range(0, len(full), 512):
        part = full[at : at + 512]
        lo, hi = first[part[0]], first[part[-1] + 1]
        mean[part] = np.add.reduceat(_WORD_TABLE[slots[lo:hi]], first[part] - lo, axis=0)
    mean /= np.sqrt(np.maximum(count, 1))[:, None]
    mean *= np.minimum(1, 5 / np.maximum(np.linalg.norm(mean, axis=1), 1e-6))[:, None]
    x = np.zeros((len(flat), INPUT), np.float32)
    x[:, : _PATH + _LEAF] = [_path(b[1]) for b in flat]
    x[:, _PATH + _LEAF : _PATH + _LEAF + _WORDS] = 0.5 * mean
    chars = np.array([len(b[0]) for b in flat])
    sizes = x[:, -_SIZES:]
    sizes[:, 0] = np.log1p(chars) / 4 - 1
    sizes[:, 1] = np.log1p(count) / 3 - 1
    sizes[:, 2] = [2 * b[2] for b in flat]
    sizes[:, 3] = [b[0][-1] in ".!?:;\"'”»" for b in flat]
    sizes[:, 4] = [_DIGIT.search(b[0]) is not None for b in flat]
    sizes[:, 7] = 1
    out, at = [], 0
    for p in pages:
        n = len(p)
        page = x[at : at + n]
        if n:
            page[:, 5] = np.linspace(-1, 1, n) if n > 1 else 0
            page[:, 6] = np.cumsum(chars[at : at + n]) / chars[at : at + n].sum()
        out.append(page)
        at += n
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: bool):
    """One direction over time-major input (steps x pages x INPUT); masked steps pass the state on."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    wx, wh = w[:INPUT], w[INPUT:]
    pre = x.reshape(-1, INPUT) @ wx
    pre = pre.reshape(steps, pages, 4 * HIDDEN)
    out, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ wh
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        th = np.tanh(c2)
        m = mask[t][:, None]
        if keep:
            saved.append((h, c, i, f, o, g, th, m))
        h, c = np.where(m, o * th, h), np.where(m, c2, c)
        out[t] = h
    return out, saved


def _back(x, w, saved, dout):
    steps, pages, _ = x.shape
    wh = w[INPUT:]
    dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, th, m = saved[t]
        dh = dh + dout[t]
        dho = np.where(m, dh, 0)
        dc2 = np.where(m, dc, 0) + dho * o * (1 - th * th)
        dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dho * th * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh = np.where(m, 0, dh) + dz @ wh.T
        dc = np.where(m, dc2 * f, dc)
    return np.concatenate([x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * HIDDEN), dwh])


def _pad(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    x, mask = np.zeros((steps, len(xs), INPUT), np.float32), np.zeros((steps, len(xs)), bool)
    for k, p in enumerate(xs):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def _logits(model, x, mask, keep=False):
    fw, bw, out, bias = model
    a, sa = _run(x, mask, fw, keep)
    b, sb = _run(x[::-1], mask[::-1], bw, keep)
    both = np.concatenate([a, b[::-1]], axis=2)
    return both @ out + bias, both, sa, sb


# --- generated layouts -------------------------------------------------------------------------------------------------------

#: Class words by the kind of area; the generator draws from them, the network sees their hashes.
_AREAS = {
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs tabs links toolbar",
    "header": "header masthead banner site-header top logo branding page-header topbar",
    "sidebar": "sidebar aside widget related rail secondary side-column trending popular recommended teaser",
    "notice": "notice cookie cookies consent alert gdpr message modal popup overlay newsletter subscribe signup paywall",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adbox ad-slot banner-ad",
    "form": "form search search-form login contact-form signin subscribe-form",
    "comments": "comments comment comment-list replies reply discussion disqus thread responses user-comment",
    "footer": "footer site-footer bottom copyright legal colophon page-footer",
    "share": "share social sharing tags meta author byline toolbar",
}
_MAIN = "article content main post entry story body text post-content entry-content article-body main-content page"
_LABELS = {
    "menu": "home about contact news sport products blog login help shop",
    "notice": "we use cookies accept privacy policy continue agree subscribe newsletter inbox",
    "advert": "advertisement sponsored buy now offer discount sale deal shop free shipping",
    "comments": "reply says posted ago likes comment user great thanks agree",
    "footer": "copyright all rights reserved terms privacy imprint contact",
    "form": "name email password search submit send message required",
    "sidebar": "related read more most popular latest trending see also",
    "share": "share tweet tags filed under by author posted",
    "header": "welcome site the daily official portal",
}


_BOXES = "box block row col wrap inner section container wide clear page wrapper site layout"
#: What training pages are made of. A heading below the third level counts as one of the third, other elements as a ``div``.
_TAGS = frozenset("html body div nav header aside footer form section article main h1 h2 h3 ul ol li p blockquote table tbody tr td th pre dl dt dd figure figcaption".split())
_PLAIN = {"h4": "h3", "h5": "h3", "h6": "h3", "thead": "tbody", "tfoot": "tbody", "menu": "ul", "dir": "ul", "listing": "pre", "plaintext": "pre", "xmp": "pre", "caption": "figcaption"}
_CLASSES = frozenset(f".{w}" for w in _WORD.findall(" ".join([*_AREAS.values(), _MAIN, _BOXES])))


class _Pages:
    """Random page layouts; every text carries its label in a data-y attribute, which the inputs do not show."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        letters = list("etaoinshrdlucmfwypvbgkéñüöäçó")
        self.naming = 1.0
        self.vocabulary = ["".join(self.r.choice(letters, self.r.integers(1, 11))) for _ in range(4000)]

    def pick(self, words: str) -> str:
        return str(self.r.choice(words.split()))

    def text(self, n: int, own: str = "", share: float = 0.3, dots: bool = True) -> str:
        own_words, out = own.split(), []
        for _ in range(max(1, n)):
            out.append(str(self.r.choice(own_words)) if own_words and self.r.random() < share else self.vocabulary[int(self.r.integers(4000))])
        s = " ".join(out).capitalize()
        if dots:
            s = re.sub(r"((?:\S+ ){6,14}?\S+) ", lambda m: m[1] + (". " if self.r.random() < 0.5 else ", "), s) + "."
        return s

    def named(self, kind_words: str, tag: str = "div", p: float = 0.9) -> str:
        if self.r.random() > p * (self.naming if kind_words == _MAIN else max(self.naming, 0.75)):
            return f"<{tag}>" if self.r.random() < 0.5 else f'<{tag} class="{self.pick("box block row col wrap inner section container")}">'
        key = "class" if self.r.random() < 0.75 else "id"
        extra = f" {self.pick('box block row wide clear inner')}" if self.r.random() < 0.3 else ""
        return f'<{tag} {key}="{self.pick(kind_words)}{extra}">'

    def area(self, kind: str) -> str:
        r, own = self.r, _LABELS[kind]
        tag = {"menu": "nav", "header": "header", "sidebar": "aside", "footer": "footer", "form": "form"}.get(kind, "section")
        semantic = r.random() < 0.5 and kind not in ("notice", "advert", "comments", "share")
        if kind == "form":
            semantic = r.random() < 0.85
        opened, close = (f"<{tag}>" if r.random() < 0.6 else self.named(_AREAS[kind], tag), tag) if semantic else (self.named(_AREAS[kind]), "div")
        out = [opened]
        if kind in ("menu", "sidebar") and r.random() < 0.8 or kind == "footer" and r.random() < 0.4:
            if kind == "sidebar" and r.random() < 0.6:
                out.append(f"<h3>{self.text(2, own, 0.6, False)}</h3>")
            out.append("<ul>" + "".join(f'<li><a href="/x">{self.text(r.integers(1, 4 if kind == "menu" else 9), own, 0.3, False)}</a></li>' for _ in range(r.integers(3, 9))) + "</ul>")
        elif kind == "comments":
            if r.random() < 0.6:
                out.append(f"<h3>{self.text(2, own, 0.7, False)}</h3>")
            for _ in range(r.integers(1, 6)):
                out.append((self.named(_AREAS[kind]) if r.random() < 0.7 else "<div>") + (f"<span>{self.text(2, own, 0.5, False)}</span>" if r.random() < 0.6 else "") + f"<p>{self.text(r.integers(3, 60), own, 0.15)}</p></div>")
        elif kind == "form":
            out.append("".join(f"<label>{self.text(r.integers(1, 3), own, 0.7, False)}</label><input>" for _ in range(r.integers(1, 4))) + (f"<p>{self.text(r.integers(3, 12), own, 0.4)}</p>" if r.random() < 0.5 else ""))
        else:
            for _ in range(r.integers(1, 3)):
                body = self.text(r.integers(1, 26), own, 0.35, r.random() < 0.6)
                body = f'<a href="/x">{body}</a>' if r.random() < 0.25 else body
                body = f"&copy; {body}" if kind == "footer" and r.random() < 0.6 else body
                out.append(body if r.random() < 0.45 else f"<p>{body}</p>")
        out.append(f"</{close}>")
        return re.sub(r"<(\w+)", r'<\1 data-y="0"', "".join(out), count=1)

    def article(self) -> str:
        r = self.r
        tag = self.pick("article article main section div div")
        opened = f"<{tag}>" if tag != "div" and r.random() < 0.6 else self.named(_MAIN, tag, 0.85)
        out = [re.sub(r"<(\w+)", r'<\1 data-y="1"', opened, count=1)]
        if r.random() < 0.7:
            out.append(f"<h1>{self.text(r.integers(2, 14), dots=False)}</h1>")
        nested = int(r.integers(1, 4)) if r.random() < 0.35 else 0
        out.append("<div>" * nested)
        form = str(r.choice(["p", "p", "p", "p", "p", "p", "p", "p", "td", "div", "section"]))  # what most paragraphs of this article are
        out.append("<table>" if form == "td" else "")
        odd = r.random() < 0.15
        for k in range(int(r.integers(1, 5)) if r.random() < 0.3 else int(r.integers(3, 22))):
            n = int(r.integers(1, 6)) if r.random() < 0.25 else int(r.integers(8, 140))
            n = n if r.random() < 0.97 else int(r.integers(400, 1500))
            body = self.text(n)
            if odd and r.random() < 0.8 or r.random() < 0.03:  # tables, code, junk and keys in running text
                body = str(r.choice([" | ", " ### ", " = ", " 7 ", "; ", " www."])).join(self.text(n, dots=r.random() < 0.5).split())
            elif odd and r.random() < 0.5:  # one word or sentence over and over
                body = " ".join([self.text(int(r.integers(1, 8)), dots=r.random() < 0.5)] * int(r.integers(3, 60)))
            if r.random() < 0.15:
                body = f"<b>{body}<br>" if r.random() < 0.5 else f'{body} <a href="/y">{self.text(2, dots=False)}</a> {self.text(5)}'
            kind = r.random()
            if form == "td":
                out.append(f"<tr><td>{body}</td></tr>" if kind < 0.7 else f"<tr><th>{self.text(2, dots=False)}</th><td>{body}</td></tr>")
                continue
            if kind < 0.66:
                out.append(f"<{form}>{body}" + (f"</{form}>" if form != "p" or r.random() < 0.85 else ""))
            elif kind < 0.69:
                out.append("<dl>" + "".join(f"<dt>{self.text(r.integers(1, 5), dots=False)}</dt><dd>{self.text(r.integers(3, 40))}</dd>" for _ in range(r.integers(1, 7))) + "</dl>")
            elif kind < 0.71:
                out.append(f"<pre>{body}</pre>")
            elif kind < 0.73:
                out.append(f"<figure><img>" + f"<figcaption>{self.text(r.integers(2, 20))}</figcaption></figure>")
            elif kind < 0.8:
                out.append(f"<h2>{self.text(r.integers(1, 8), dots=False)}</h2>")
            elif kind < 0.87:
                tag2 = "ul" if r.random() < 0.7 else "ol"
                out.append(f"<{tag2}>" + "".join(f"<li>{self.text(r.integers(2, 25))}</li>" for _ in range(r.integers(2, 12 if r.random() < 0.3 else 6))) + f"</{tag2}>")
            elif kind < 0.91:
                out.append(f"<blockquote>{body}</blockquote>")
            elif kind < 0.95:
                out.append(f"<div>{body}</div>")
            else:
                head = f"<tr><th>{self.text(1, dots=False)}</th><th>{self.text(2, dots=False)}</th></tr>" if r.random() < 0.5 else ""
                out.append(f"<table>{head}" + f"<tr><td>{self.text(2, dots=False)}</td><td>{self.text(3, dots=False)}</td></tr>" * int(r.integers(1, 4)) + "</table>")
            if r.random() < 0.06:
                out.append(self.area(self.pick("advert advert share notice form sidebar")))
        out.append("</table>" if form == "td" else "")
        out.append("</div>" * nested)
        if r.random() < 0.15:
            out.append(self.area(self.pick("comments share")))
        out.append(f"</{tag}>")
        return "".join(out)

    def page(self) -> str:
        r = self.r
        # most makers name their areas by other words, which count as none
        self.naming = 0.1 if r.random() < 0.4 else 1.0
        before = [k for k, p in (("header", 0.5), ("menu", 0.85), ("notice", 0.3), ("advert", 0.45), ("form", 0.2), ("sidebar", 0.2)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("comments", 0.35), ("sidebar", 0.35), ("advert", 0.25), ("form", 0.2), ("notice", 0.15), ("footer", 0.85)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        body = "".join(self.area(k) for k in before) + (self.article() if r.random() < 0.97 else "") + "".join(self.area(k) for k in after)
        if r.random() < 0.3:
            body = f"{self.named('page wrapper container site layout', 'div')}{body}</div>"
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


@lru_cache(maxsize=4)
def train(pages: int = 1200, epochs: int = 10, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the network after ``epochs`` over ``pages`` generated layouts (Adam); the same on every run."""
    made = _Pages(seed)
    cut = [b for b in (blocks_of(made.page()) for _ in range(pages)) if b]
    xs, ys = _inputs(cut), [np.array([b[3] == "1" for b in p], np.float32) for p in cut]
    r = np.random.default_rng(seed)
    model = [r.normal(0, 0.12, (INPUT + HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
    model += [r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model], 0
    order = np.argsort([len(x) for x in xs], kind="stable")
    batches = [order[i : i + 24] for i in range(0, len(order), 24)]
    for epoch in range(epochs):
        for k in r.permutation(len(batches)):
            x, mask = _pad([xs[i] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(ys[i]), j] = ys[i]
            z, both, sa, sb = _logits(model, x, mask, True)
            dz = np.where(mask, _sigmoid(z) - y, 0) / mask.sum() * 8
            dboth = dz[:, :, None] * model[2]
            grads = [
                _back(x, model[0], sa, dboth[:, :, :HIDDEN]), _back(x[::-1], model[1], sb, dboth[::-1, :, HIDDEN:]),
                (both * dz[:, :, None]).sum((0, 1)), np.array([dz.sum()], np.float32),
            ]
            step += 1
            rate = 0.006 * (0.5 if epoch > epochs * 0.7 else 1)
            for i, g in enumerate(grads):
                g = np.clip(g, -5, 5)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                model[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return tuple(model)


def label(pages: list[list[tuple]], model) -> list[np.ndarray]:
    """For each page, whether each of its blocks is main text."""
    xs = _inputs(pages)
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = [i for i in np.argsort([len(x) for x in xs], kind="stable") if len(xs[i])]
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 256 and (to - at + 1) * len(xs[order[to]]) <= 16384:
            to += 1
        part = order[at:to]
        z = _logits(model, *_pad([xs[i] for i in part]))[0]
        for j, i in enumerate(part):
            out[i] = z[: len(xs[i]), j] > 0
        at = to
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), model=None) -> DataFrame:
    """(id, kept columns, text, n_chars) for each row of ``pages``: the blocks labelled main text, joined by line feeds.

    Null and empty pages, and pages without main text, give an empty text. Every row is labelled for itself; repeated rows and null ids give rows too.
    """
    weights = model or train()
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, *keep)]
    names = ["id", *(f"k{i}" for i in range(len(keep)))]
    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names[1:])])

    def run(batches):
        for piece in slices(batches, 256, 2 << 20):
            cut = [blocks_of(h or "") for h in piece.column(1).to_pylist()]
            text = ["\n".join(b[0] for b, y in zip(p, marks) if y) for p, marks in zip(cut, label(cut, weights))]
            columns = [piece.column(0), *[piece.column(2 + i) for i in range(len(keep))], pa.array(text, type=pa.string()), pa.array([len(t) for t in text], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    out = source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", text string, n_chars long")
    return out.select(F.col("id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names[1:], keep)], "text", "n_chars")
