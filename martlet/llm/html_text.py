"""Main text of web pages.

Method: a linear-chain conditional random field over the leaf blocks of a page. A
leaf block is a stretch of text without a block element's border in it; its features
are the tags, classes, ids and roles of its ancestors, its own length, links, marks
and words, and those of its neighbours. The transition weights depend on whether two
consecutive blocks lie in the same container. The field is trained by gradient
ascent on labelled pages (``sample_pages`` draws some; any list of (html, main
blocks) will do) and decoded by Viterbi.

Only the model, a few thousand weights, goes to the tasks; each page is read whole by
itself, so nothing is exchanged. Training sees ``TRAIN_PAGES`` pages on the driver.

Text: character references are decoded, white space (as in Unicode, hence no-break
spaces too) becomes one space, blocks are joined by an empty line. A line break
element is white space. Contents of scripts, styles, titles and controls are no
text. Markup may be left unclosed: paragraphs, list items and cells end where the
next one begins.

Defined cases: null html is empty and gives empty text; a page without main blocks
too; null ids and urls and repeated rows stay as they are; an empty table gives no
row; further columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from martlet.llm.common import pick
from martlet.llm.token_files import slices

#: Labelled pages that the default model is trained on, and how long.
TRAIN_PAGES = 900
ROUNDS = 150
SEED = 20
#: Bytes of html that a task turns into text at once; a longer page is taken whole.
CHUNK_BYTES = 4 << 20

# Fixed values of the markup language.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_SKIPPED = frozenset("audio button canvas datalist math noscript object select svg template video".split())
#: What ends an open element of the same kind, and what keeps it from being looked for further out.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
}
_SCOPE = frozenset("table td th caption".split())
_KEEP_P = frozenset("caption head html body tbody td tfoot th thead tr".split())

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)", re.DOTALL
)
#: For pages with an attribute that is never closed.
_LOOSE = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.DOTALL)
_OPEN_END = re.compile(r"<[a-zA-Z/!?][^>]*+\Z")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Stems by which longer names are known that no labelled page has.
_STEMS = (
    "comment", "sidebar", "footer", "header", "cookie", "consent", "advert", "banner", "sponsor", "related", "widget",
    "newsletter", "subscri", "navig", "menu", "share", "social", "promo", "notice", "popup", "breadcrumb", "discuss",
    "article", "content", "entry", "story", "paragraph",
)


@dataclass
class Block:
    """One leaf block: its text, how much of it is linked, its ancestors and its container."""

    text: str
    linked: int
    path: tuple[tuple[str, tuple[str, ...]], ...]
    container: int


@lru_cache(50_000)
def _tokens(attributes: str) -> tuple[str, ...]:
    found = []
    for match in _NAMES.finditer(attributes):
        for token in _TOKEN.findall(match[1] or match[2] or match[3] or ""):
            token = token.lower()
            found.append(token)
            found += [stem for stem in _STEMS if stem in token and stem != token]
    return tuple(dict.fromkeys(found))


class _Reader:
    """The leaf blocks of one page."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        # tag, names, number of each open element
        self.open: list[tuple[str, tuple[str, ...], int]] = []
        self.made = 0
        self.skipped = 0
        self.links = 0
        self.pieces: list[str] = []
        self.linked = 0

    def read(self, page: str) -> list[Block]:
        at = 0
        markup = _MARKUP
        # Behind the last ">" there is no whole tag; looking for one there would be quadratic.
        last = page.rfind(">") + 1
        while True:
            found = markup.search(page, at, last)
            if markup is _MARKUP and "<" in page[at : found.start() if found else last]:
                # Either a lone "<" or a quote that is never closed.
                gap = page[at : found.start() if found else last]
                if re.search("<[a-zA-Z/!?]", gap):
                    markup = _LOOSE
                    continue
            if not found:
                break
            self.text(page[at : found.start()])
            at = found.end()
            if not found[2]:
                if found[0].startswith("<!--") and not found[0].endswith(("-->", "--!>")):
                    at = len(page)
                continue
            tag = found[2].lower()
            if found[1]:
                self.end(tag)
                continue
            self.start(tag, found[3])
            if tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else len(page)
                self.end(tag)
        self.text(_OPEN_END.sub("", page[at:]))
        self.border()
        return self.blocks

    def text(self, raw: str) -> None:
        if not raw or self.skipped:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.links:
            self.linked += len(text)

    def border(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                around = [(tag, names, n) for tag, names, n in self.open if tag in _BLOCKS]
                path = tuple((tag, names if tag not in ("html", "body") else ()) for tag, names, _ in around)
                # A list item, a cell and a paragraph lie in what is around them.
                container = around[-2][2] if len(around) > 1 else -1
                self.blocks.append(Block(text, self.linked, path, container))
            self.pieces = []
            self.linked = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self.border()
            if tag not in _KEEP_P:
                self.close_one(("p",), ("table", "td", "th", "caption"))
            if tag in _ENDS:
                self.close_one(*_ENDS[tag])
        elif tag == "br":
            self.text(" ")
        if tag in _VOID:
            return
        self.made += 1
        self.open.append((tag, _tokens(attributes) if attributes else (), self.made))
        self.skipped += tag in _SKIPPED or tag in _RAW
        self.links += tag == "a"

    def close_one(self, tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.cut(i)
                return
            if self.open[i][0] in barriers:
                return

    def end(self, tag: str) -> None:
        block = tag in _BLOCKS
        if block:
            self.border()
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                if block or all(t not in _BLOCKS for t, _, _ in self.open[i:]):
                    self.cut(i)
                else:
                    self.forget(i)
                return
            if name in _SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                return

    def cut(self, i: int) -> None:
        while len(self.open) > i:
            self.forget(len(self.open) - 1)

    def forget(self, i: int) -> None:
        tag = self.open.pop(i)[0]
        self.skipped -= tag in _SKIPPED or tag in _RAW
        self.links -= tag == "a"


def blocks_of(page: str | None) -> list[Block]:
    return _Reader().read(page or "")


#: Words that notices, menus and footers have in common, fixed.
_CUES = frozenset(
    "cookie cookies copyright rights reserved privacy terms subscribe newsletter login comment comments reply share tweet follow "
    "sponsored advertisement related menu home contact search datenschutz impressum kommentare anzeige mentions commentaires publicité "
    "comentarios publicidad aviso".split()
)
_TELLING = frozenset("article aside dialog footer form header main nav".split())
_EDGES = (1, 3, 6, 11, 21, 41, 81)


def _grade(n: int) -> int:
    return sum(n >= edge for edge in _EDGES)


@lru_cache(20_000)
def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    found = set()
    for depth, (tag, names) in enumerate(reversed(path)):
        found.add(f"in:{tag}")
        found.update(f"in.{name}" for name in names)
        if depth < 2:
            found.add(f"{depth}:{tag}")
            found.update(f"{depth}.{name}" for name in names)
    # The nearest ancestor that says what it holds.
    for tag, names in reversed(path):
        if names or tag in _TELLING:
            found.add(f"near:{tag}")
            found.update(f"near.{name}" for name in names)
            break
    return tuple(sorted(found))


def _text_features(block: Block) -> list[str]:
    text = block.text
    words = text.split(" ")
    density = block.linked / len(text)
    found = [
        "any",
        f"words:{_grade(len(words))}",
        f"linked:{0 if density == 0 else 1 if density < 0.3 else 2 if density < 0.8 else 3}",
        f"end:{'stop' if text[-1] in '.!?…。' else 'colon' if text[-1] == ':' else 'other'}",
    ]
    if "©" in text:
        found.append("has:©")
    if "|" in text or "»" in text or "›" in text:
        found.append("has:bar")
    if len(words) <= 40:
        found += [f"cue:{w}" for w in {w.strip(".,:;!?()").lower() for w in words} & _CUES]
    return found


def features(blocks: list[Block]) -> tuple[list[list[str]], list[bool]]:
    """Features of each block, and whether it lies in the container of the block before."""
    own = [_text_features(b) for b in blocks]
    found, same = [], []
    for i, block in enumerate(blocks):
        around = []
        for name, j in (("before", i - 1), ("after", i + 1)):
            inside = 0 <= j < len(blocks)
            around += [f"{name}:{f}" for f in own[j][1:3]] if inside else [f"{name}:none"]
        found.append([*_path_features(block.path), *own[i], *around])
        same.append(i > 0 and blocks[i - 1].container == block.container)
    return found, same


@dataclass
class Model:
    """Weights of features for main text, and of transitions [same container][from][to]."""

    weight: dict[str, float]
    moves: list[list[list[float]]]
    first: float

    def label(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels of all blocks together."""
        if not blocks:
            return []
        get = self.weight.get
        found, same = features(blocks)
        other, main = 0.0, self.first + sum(get(f, 0.0) for f in found[0])
        came: list[tuple[bool, bool]] = []
        for names, together in zip(found[1:], same[1:], strict=True):
            move = self.moves[together]
            score = sum(get(f, 0.0) for f in names)
            to_other = (other + move[0][0], main + move[1][0])
            to_main = (other + move[0][1], main + move[1][1])
            came.append((to_other[1] > to_other[0], to_main[1] > to_main[0]))
            other, main = max(to_other), max(to_main) + score
        labels = [main > other]
        for step in reversed(came):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(labelled: Iterable[tuple[str, list[str]]], rounds: int = ROUNDS, decay: float = 0.02) -> Model:
    """A model of pages given as (html, texts of their main blocks).

    Full-batch gradient ascent with adaptive steps on the log-likelihood less ``decay`` times
    the squares of the weights.
    """
    pages = []
    for page, main in labelled:
        blocks, left = blocks_of(page), Counter(main)
        truth = []
        for block in blocks:
            truth.append(left[block.text] > 0)
            left[block.text] -= truth[-1]
        if blocks:
            pages.append((*features(blocks), truth))
    seen = Counter(f for found, _, _ in pages for names in found for f in names)
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 2))}
    n, longest = len(pages), max((len(p[2]) for p in pages), default=0)
    row, column = [], []
    same, truth, real = np.zeros((n, longest), int), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (found, together, labels) in enumerate(pages):
        k = len(labels)
        same[i, :k], truth[i, :k], real[i, :k] = together, labels, True
        for t, names in enumerate(found):
            at = [index[f] for f in names if f in index]
            column += at
            row += [i * longest + t] * len(at)
    row, column = np.array(row, int), np.array(column, int)
    weight, moves, first = np.zeros(len(index)), np.zeros((2, 2, 2)), np.zeros(1)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weight, moves, first)]
    steps = np.zeros((2, 2, 2))
    np.add.at(steps, (same[:, 1:][real[:, 1:]], truth[:, :-1][real[:, 1:]], truth[:, 1:][real[:, 1:]]), 1)
    for turn in range(1, rounds + 1):
        score = np.bincount(row, weight[column], n * longest).reshape(n, longest)
        main, pairs = _marginals(score, moves[same], first[0], real)
        error = (truth - main) * real
        slopes = (
            np.bincount(column, error.ravel()[row], len(index)) - decay * weight,
            steps - np.stack([pairs[(same == s) & real].sum(0) for s in (0, 1)]) - decay * moves,
            error[:, 0].sum(keepdims=True) - decay * first,
        )
        for value, slope, (mean, square) in zip((weight, moves, first), slopes, state, strict=True):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            step = mean / (1 - 0.9**turn) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
            value += 0.15 * step
    return Model({f: float(weight[i]) for f, i in index.items()}, moves.tolist(), float(first[0]))


def _marginals(score: np.ndarray, move: np.ndarray, first: float, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of main text for each block, and of each pair (block before, block), by forward and backward sums."""
    n, longest = score.shape
    upto = np.zeros((n, longest, 2))
    upto[:, 0, 1] = score[:, 0] + first
    for t in range(1, longest):
        ways = upto[:, t - 1, :, None] + move[:, t]
        into = np.logaddexp(ways[:, 0], ways[:, 1])
        into[:, 1] += score[:, t]
        upto[:, t] = np.where(real[:, t, None], into, upto[:, t - 1])
    total = np.logaddexp(upto[:, -1, 0], upto[:, -1, 1])
    after, pairs = np.zeros((n, longest, 2)), np.zeros((n, longest, 2, 2))
    for t in range(longest - 1, 0, -1):
        ahead = after[:, t].copy()
        ahead[:, 1] += score[:, t]
        both = move[:, t] + ahead[:, None, :]
        pairs[:, t] = np.exp(upto[:, t - 1, :, None] + both - total[:, None, None]) * real[:, t, None, None]
        after[:, t - 1] = np.where(real[:, t, None], np.logaddexp(both[..., 0], both[..., 1]), 0.0)
    main = np.exp(upto[..., 1] + after[..., 1] - total[:, None])
    return np.where(real, main, 0.0), pairs


# --- labelled pages --------------------------------------------------------------

_MAIN_NAMES = (
    "content main-content post post-body post-content entry-content entry article article-body articleBody story story-body text "
    "body-text maincontent page-content single hentry blog-post news-article richtext prose copy primary detail body"
).split()
_AROUND_NAMES = "wrapper container page site layout row col inner wrap grid outer center box section block app root".split()
#: Kind of matter that is no main text -> tags and names it comes with.
_OTHER = {
    "menu": ("nav nav div ul table", "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs toc pagination pager links tabs"),
    "header": ("header header div", "header site-header masthead topbar branding logo hero-bar page-header top"),
    "footer": ("footer footer div", "footer site-footer colophon copyright bottom page-footer legal credits footnote-bar"),
    "sidebar": ("aside aside div section td", "sidebar side widget rail secondary related trending recommended popular more-stories right-col left-col see-also"),
    "notice": ("div div section aside p dialog", "notice cookie cookies cookie-banner consent gdpr alert warning message popup modal overlay infobar paywall announcement privacy toast"),
    "advert": ("div div aside section ins p", "ad ads advert advertisement adbox banner sponsor sponsored promo promotion ad-slot partner commercial dfp"),
    "form": ("form form div", "form search login signup newsletter subscribe contact-form register searchbox poll feedback"),
    "share": ("div div ul", "share social sharing share-bar follow social-links tags tag-list meta-links"),
    "comments": ("section section div ol ul article", "comments comment comment-list reader-comments responses replies discussion disqus respond thread user-comments feedback-list reviews commentlist"),
}
_BEFORE = ("notice", "header", "menu", "advert", "form", "sidebar", "menu")
_WITHIN = ("advert", "share", "sidebar", "form", "notice", "menu")
_AFTER = ("share", "comments", "sidebar", "footer", "advert", "form", "notice", "menu", "footer")
_CUE_TEXT = {
    "notice": ("We use cookies.", "This site uses cookies to improve the service.", "Aviso", "Privacy"),
    "footer": ("© 2020", "All rights reserved.", "Copyright", "Terms | Privacy", "Impressum"),
    "comments": ("Comments", "3 comments", "Reply", "Kommentare", "Commentaires"),
    "advert": ("Advertisement", "Sponsored", "Anzeige"),
    "menu": ("Home", "Menu", "Contact"),
    "sidebar": ("Related", "Popular", "More"),
}


class _Painter:
    """Draws one labelled page after another."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def some(self, chance: float) -> bool:
        return self.draw.random() < chance

    def word(self) -> str:
        return "".join(self.draw.choice("an er in st le re qu ma vo di ka su ont eau sch tion".split()) for _ in range(self.draw.randint(1, 4)))

    def sentence(self, least: int, most: int) -> str:
        text = " ".join(self.word() for _ in range(self.draw.randint(least, most))).capitalize()
        return text + self.draw.choice(("", ".", ".", ".", ".", "!", "?"))

    def passage(self) -> str:
        kind = self.draw.random()
        if kind < 0.25:
            return self.sentence(1, 4)
        return " ".join(self.sentence(3, 18) for _ in range(self.draw.randint(1, 9 if kind > 0.6 else 3)))

    def attributes(self, names: list[str], chance: float = 0.9) -> str:
        if not self.some(chance):
            return ""
        own = self.draw.sample(names, self.draw.choice((1, 1, 2)))
        if self.some(0.2):
            own.append(self.draw.choice(("clearfix", "mt-4", "x1", "js-hook", "large")))
        key = self.draw.choice(("class", "class", "class", "id"))
        return f' {key}="{" ".join(own)}"'

    def element(self, tag: str, inside: str, attributes: str = "", closed: float = 0.9) -> str:
        return f"<{tag}{attributes}>{inside}" + (f"</{tag}>" if tag not in ("p", "li", "td") or self.some(closed) else "")

    def decorated(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 3 and self.some(0.3):
            i = self.draw.randrange(len(words))
            words[i] = self.draw.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>")).format(words[i])
        return " ".join(words)

    def main(self, titled: bool) -> Iterator[tuple[str, list[str]]]:
        """Pieces of the article and the texts of their blocks."""
        if titled:
            title = self.sentence(2, 12)
            made = self.element("h1", title)
            yield (f"<header>{made}</header>" if self.some(0.15) else made), [title]
        for _ in range(self.draw.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = self.draw.random()
            if kind < 0.75:
                text = self.passage()
                yield self.element("p", self.decorated(text), closed=0.8), [text]
            elif kind < 0.85:
                text = self.sentence(1, 7)
                yield self.element(self.draw.choice(("h2", "h3", "h4")), text), [text]
            elif kind < 0.92:
                texts = [self.sentence(1, 12) for _ in range(self.draw.randint(1, 5))]
                yield self.element(self.draw.choice(("ul", "ol")), "".join(self.element("li", self.decorated(t)) for t in texts)), texts
            elif kind < 0.96:
                text = self.passage()
                yield self.element("blockquote", self.element("p", text)), [text]
            elif kind < 0.98:
                texts = [self.sentence(1, 4) for _ in range(4)]
                cells = [self.element("td", t) for t in texts]
                yield f"<table><tr>{cells[0]}{cells[1]}<tr>{cells[2]}{cells[3]}</table>", texts
            else:
                text = self.sentence(2, 9)
                yield self.element("figure", "<img src=x>" + self.element("figcaption", text)), [text]

    def other(self, kind: str) -> str:
        tags, names = _OTHER[kind]
        tag = self.draw.choice(tags.split())
        link = lambda: f'<a href="/{self.draw.randrange(99)}">{self.sentence(1, 6 if kind == "sidebar" else 3).rstrip(".!?")}</a>'
        links = lambda: self.element("ul", "".join(self.element("li", link()) for _ in range(self.draw.randint(2, 8))))
        heading = self.element(self.draw.choice(("h2", "h3", "h4", "div", "p")), self.sentence(1, 3))
        text = lambda: self.element(self.draw.choice(("p", "p", "div")), self.passage())
        cue = self.draw.choice(_CUE_TEXT[kind]) + " " if kind in _CUE_TEXT and self.some(0.4) else ""
        if kind in ("menu", "share"):
            inside = links() if tag not in ("ul", "table") else "".join(f"<{'li' if tag == 'ul' else 'td'}>{link()}" for _ in range(5))
        elif kind == "header":
            inside = self.element(self.draw.choice(("h1", "div", "p", "span")), self.sentence(1, 4)) + (self.sentence(2, 8) if self.some(0.4) else "")
            inside += links() if self.some(0.3) else ""
        elif kind == "sidebar":
            inside = heading * self.some(0.6) + self.draw.choice((links, text, lambda: text() + links(), lambda: text() + text()))()
        elif kind == "form":
            inside = heading * self.some(0.5) + f"<label>{self.sentence(1, 3)}</label><input name=q>" + (text() if self.some(0.4) else "") + "<button>Go</button>"
        elif kind == "comments":
            each = lambda: self.element(
                self.draw.choice(("div", "li", "article")), self.element("p", self.sentence(1, 3), ' class="author"') * self.some(0.6) + text() * self.draw.choice((1, 1, 2)),
                self.attributes(["comment", "reply", "response", "review", "comment-body", "message"], 0.6),
            )
            inside = cue + heading * self.some(0.5) + "".join(each() for _ in range(self.draw.randint(1, 5)))
            return self.element(tag, inside, self.attributes(names.split(), 1.0))
        elif kind == "footer":
            inside = cue + (links() if self.some(0.4) else "") + self.draw.choice((self.passage, lambda: text()))()
        else:
            inside = cue + self.draw.choice((self.passage, self.passage, text, lambda: heading + text()))()
        plain = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        return self.element(tag, inside, self.attributes(names.split(), 0.5 if plain else 1.0))

    def page(self) -> tuple[str, list[str]]:
        pieces, texts = [], []
        within = self.draw.choice((0, 0, 0, 1, 2))
        for piece, own in self.main(self.some(0.85)):
            pieces.append(piece)
            texts += own
        for _ in range(within):
            pieces.insert(self.draw.randint(0, len(pieces)), self.other(self.draw.choice(_WITHIN)))
        if self.some(0.1):
            pieces.append(self.element("footer", self.passage()))
        if self.some(0.1):
            pieces.append(self.other("comments"))
        body = "".join(pieces)
        kind = self.draw.random()
        if kind < 0.4:
            body = self.element("article", body, self.attributes(_MAIN_NAMES, 0.4))
        elif kind < 0.85:
            body = self.element(self.draw.choice(("div", "div", "section")), body, self.attributes(_MAIN_NAMES, 1.0))
        if kind >= 0.95 or self.some(0.25):
            tail = self.other("comments") if self.some(0.3) else ""
            body = self.element("main", body + tail, self.attributes(_MAIN_NAMES, 0.3))
        before = [self.other(k) for k in _BEFORE if self.some(0.35)]
        after = [self.other(k) for k in _AFTER if self.some(0.35)]
        whole = "".join(before) + body + "".join(after)
        for _ in range(self.draw.choice((0, 0, 1, 2))):
            whole = self.element("div", whole, self.attributes(_AROUND_NAMES, 0.8))
        head = f"<head><title>{self.sentence(2, 6)}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{whole}</body></html>", texts


def sample_pages(n: int, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Labelled pages of many layouts: html and the texts of the main blocks, by seed."""
    painter = _Painter(seed)
    return [painter.page() for _ in range(n)]


@lru_cache(1)
def default_model() -> Model:
    return train(sample_pages(TRAIN_PAGES))


# --- pages of a table --------------------------------------------------------------


def main_text(page: str | None, model: Model) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, kept in zip(blocks, model.label(blocks), strict=True) if kept)


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("html"), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                texts = [main_text(page, model) for page in part.column("html").to_pylist()]
                yield pa.record_batch(
                    {
                        "page_id": part.column("page_id"),
                        "url": part.column("url"),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    }
                )

    return run


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pick(pages, page_id=("page_id", "bigint"), url=("url", "string"), html=("html", "string"))
    return rows.mapInArrow(_extract(model or default_model()), "page_id long, url string, text string, n_chars long")
