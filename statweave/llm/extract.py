"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text between block-level tags, character references
decoded, white space folded. Scripts, styles and other unseen elements give no text. Each block
is described by the tags, classes and roles of its ancestors and by its text (length, links,
punctuation, ...). The chain labels every block as main text or not; the Viterbi path decides,
and its main blocks are joined in page order.

*Training.* Two sets of labelled pages: a handful of layouts written for this purpose
(``labelled_pages``), whose main elements are marked, and at most ``max_pages`` pages of the
table itself, those with the smallest url hashes. The latter carry the labels of their own
markup: a block is main when it stands in ``article`` or ``main`` and in none of the elements
for menus, headers, footers, sidebars, notices, adverts, forms or comments. A second copy of
every training page hides the ``article`` and ``main`` ancestors, so that the text and the other
ancestors learn to tell as well. Fitting is batched gradient ascent on the exact likelihood
(forward-backward in the log domain), in the driver, on these bounded pages only.

Pages are decoded one by one inside Arrow batches; nothing of a page is dropped or capped.

Defined cases: NULL and empty pages give empty text; so do pages without any main block; broken
markup is read as far as it goes, unclosed elements end with their parent; a head without an end
tag ends where HTML ends it, at the body or the first element or text of it; a button, select or
the like without any end tag to come hides nothing; repeated rows stay repeated; a table without usable pages is decoded with the written layouts alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from statweave.llm.labelled_pages import LAYOUTS

MAX_PAGES = 200
MAX_FEATURES = 2000
#: Blocks of a page to learn from, in this many runs from its start to its end.
MAX_BLOCKS = 200
RUNS = 8
#: Marks main elements in the written layouts; never a feature.
MARK = "data-main"

# HTML element names.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title head svg select datalist textarea button iframe object "
                   "canvas audio video map annotation annotation-xml".split())
#: Of these, one that is never closed hides nothing.
CLOSED = frozenset("noscript svg select datalist button object canvas audio video map".split())
_CLOSING = re.compile(rf"(?i)</({'|'.join(sorted(CLOSED))})\b")
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
CLOSES = {  # an opening tag ends these open elements, up to the nearest container
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
MAIN = frozenset(["article", "main"])
ASIDE = frozenset(["nav", "header", "footer", "aside", "form", "dialog", "menu"])
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo comment comments reply replies sidebar menu nav "
    "navigation breadcrumb breadcrumbs footer header cookie cookies consent notice popup modal newsletter subscribe share "
    "sharing social related recommended widget login signup search".split())
_SPLIT = re.compile(r"[a-z]+|\d+")


class Blocks(HTMLParser):
    """Collects leaf blocks with the names of their ancestors."""

    def __init__(self, closing: Iterable[str] = ()):
        super().__init__(convert_charrefs=True)
        #: End tags still to come.
        self.closing = Counter(closing)
        self.stack: list[tuple[str, frozenset[str], bool, bool]] = []
        self.blocks: list[tuple[str, frozenset[str], int, bool, str]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.unseen = 0
        self.links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            names = frozenset().union(*(x[1] for x in self.stack)) if self.stack else frozenset()
            nearest = next((x[0] for x in reversed(self.stack) if x[0] not in INLINE), "")
            self.blocks.append((text, names, self.linked, any(x[2] for x in self.stack), nearest))
        self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        for tag, _, _, hides in self.stack[at:]:
            self.unseen -= hides
            self.links -= tag == "a"
        del self.stack[at:]

    def _ends(self, tag: str) -> bool:
        """Ends what HTML ends before this tag, beyond ``CLOSES``; whether the tag says no more than that."""
        tops = [x[0] for x in self.stack]
        if "head" in tops and "template" not in tops and (tag == "body" or tops[-1] == "head" and tag not in HEAD):
            self._pop(tops.index("head"))
        elif tag == "head" and set(tops) - {"html"}:
            return True
        elif tag in ("select", "input", "textarea") and "select" in tops:
            self._pop(tops.index("select"))
            return tag == "select"
        elif tag == "button" and "button" in tops:
            self._pop(tops.index("button"))
        return False

    def handle_starttag(self, tag, attrs):
        if self._ends(tag):
            return
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")
        ends = CLOSES.get(tag) or ({"p"} if tag not in INLINE and tag not in UNSEEN else ())
        if ends:
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] in ends:
                    self._pop(at)
                    break
                if self.stack[at][0] not in INLINE:
                    break
        if tag in VOID:
            return
        names = {f"<{tag}>"}
        marked = False
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names.update(f".{w}" for w in _SPLIT.findall(value.lower()) if not w.isdigit())
            marked |= key == MARK
        hides = tag in UNSEEN and (tag not in CLOSED or self.closing[tag] > 0)
        self.stack.append((tag, frozenset(names), marked, hides))
        self.unseen += hides
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.closing[tag] += 1
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.closing[tag] -= 1
        if tag not in INLINE:
            self._flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._pop(at)
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._pop(len(self.stack) - 1)
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def unknown_decl(self, data):
        pass  # CDATA and the like show nothing


def blocks_of(html: str | None) -> list[tuple[str, frozenset[str], int, bool, str]]:
    """(text, ancestor names, linked characters, marked, nearest block element) of each leaf block."""
    parser = Blocks(m.lower() for m in _CLOSING.findall(html or ""))
    if html:
        parser.feed(html)
        parser.close()
        parser._flush()
    return parser.blocks


def _main_by_markup(names: frozenset[str]) -> bool:
    tags, said = {n[1:-1] for n in names if n[0] == "<"}, {n[1:] for n in names if n[0] == "."}
    return bool(tags & MAIN) and not tags & (ASIDE - {"header"}) and not said & ASIDE_WORDS


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(blocks: list, hide_main: bool = False) -> Iterator[list[str]]:
    """Names of the features that hold, block by block."""
    count = len(blocks)
    for k, (text, names, linked, _, nearest) in enumerate(blocks):
        size, n = len(text), text.count(" ") + 1
        out = ["always", f"words{_bucket(n, (2, 4, 8, 16, 32, 64))}", f"in<{nearest}>",
               f"linked{_bucket(linked / size, (0.01, 0.34, 0.67, 0.95))}",
               f"ends{text[-1] if text[-1] in '.!?:;,' else 'a' if text[-1].isalnum() else 'x'}",
               f"stops{_bucket(sum(map(text.count, '.!?,')) / n, (0.01, 0.06, 0.15))}",
               f"digits{_bucket(sum(map(str.isdigit, text)) / size, (0.01, 0.1, 0.3))}"]
        out += [x for x in names if not (hide_main and x in ("<article>", "<main>"))]
        out += ["aside"] if any(x[1:] in ASIDE_WORDS for x in names if x[0] == ".") else []
        out += ["first"] if k == 0 else ["last"] if k == count - 1 else []
        out += ["copyright"] if "©" in text or "copyright" in text.lower() else []
        yield out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # score of "main" against "other"
    start: float
    moves: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, blocks: list) -> list[bool]:
        """The Viterbi path. Scores are differences to "other", so that only "main" emits."""
        if not blocks:
            return []
        moves, back, best = self.moves, [], (0.0, self.start)
        for k, names in enumerate(features(blocks)):
            emit = sum(self.weights.get(x, 0.0) for x in names)
            if k:
                into = [(best[0] + moves[0][s], best[1] + moves[1][s]) for s in (0, 1)]
                back.append([a < b for a, b in into])
                best = (max(into[0]), max(into[1]))
            best = (best[0], best[1] + emit)
        path = [best[1] > best[0]]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def fit(pages: Iterable[tuple[list[list[str]], list[bool]]], steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Maximum likelihood with weight decay, all pages at once (Adam)."""
    pages = [(f, y) for f, y in pages if f]
    seen = Counter(x for f, _ in pages for block in f for x in set(block))
    names = sorted(seen, key=lambda x: (-seen[x], x))[:MAX_FEATURES]
    at = {x: i for i, x in enumerate(names)}
    longest = max(len(f) for f, _ in pages)
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y, live = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for p, (f, labels) in enumerate(pages):
        for k, block in enumerate(f):
            x[p, k, [at[n] for n in block if n in at]] = 1
        y[p, :len(f)], live[p, :len(f)] = labels, True
    flat = x[live]
    theta = np.zeros(len(names) + 5)  # weights, start, moves
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    both = live[:, 1:] & live[:, :-1]
    for step in range(1, steps + 1):
        w, start, moves = theta[:len(names)], theta[len(names)], theta[len(names) + 1:].reshape(2, 2)
        emit = np.zeros((*live.shape, 2))
        emit[live, 1] = flat @ w
        emit[:, 0, 1] += start
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for k in range(1, longest):
            into = np.logaddexp(alpha[:, k - 1, 0, None] + moves[0], alpha[:, k - 1, 1, None] + moves[1]) + emit[:, k]
            alpha[:, k] = np.where(live[:, k, None], into, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            onto = emit[:, k + 1] + beta[:, k + 1]
            out = np.logaddexp(moves[:, 0] + onto[:, 0, None], moves[:, 1] + onto[:, 1, None])
            beta[:, k] = np.where(live[:, k + 1, None], out, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        main = np.where(live, np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]), 0)
        pair = np.exp(alpha[:, :-1, :, None] + moves + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        gap = (y - main) * live
        told = np.zeros((2, 2))
        np.add.at(told, (y[:, :-1][both], y[:, 1:][both]), 1)
        grad = np.concatenate([flat.T @ gap[live], [gap[:, 0].sum()], (told - pair.sum((0, 1))).ravel()]) / len(pages) - l2 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    moves = theta[len(names) + 1:].reshape(2, 2).tolist()
    return Model(dict(zip(names, theta.tolist(), strict=False)), float(theta[len(names)]), (tuple(moves[0]), tuple(moves[1])))


def spread(count: int, most: int = MAX_BLOCKS, runs: int = RUNS) -> list[int]:
    """At most ``most`` of ``count`` places, in equally spaced runs; the first and the last place are among them."""
    if count <= most:
        return list(range(count))
    each = most // runs
    return [(count - each) * r // (runs - 1) + k for r in range(runs) for k in range(each)]


def train(pages: DataFrame, html: str = "html", url: str = "url", max_pages: int = MAX_PAGES, longest: int = 200_000) -> Model:
    """Fit on the written layouts and at most ``max_pages`` pages, of at most ``longest`` characters each."""
    usable = pages.where(F.length(html).between(1, longest)).select(F.col(html).alias("html"), F.xxhash64(url, html).alias("turn"))
    n = usable.count()
    least = int(-(2**63) + 2**64 * min(1.0, 1.2 * max_pages / max(n, 1)))
    sample = usable.where(F.col("turn") <= F.lit(min(least, 2**63 - 1))).orderBy("turn", "html").limit(max_pages).collect()
    labelled = [(b, [x[3] for x in b], range(len(b))) for b in map(blocks_of, LAYOUTS)] * max(1, len(sample) // (10 * len(LAYOUTS)))
    for row in sample:
        blocks = blocks_of(row["html"])
        labels = [_main_by_markup(x[1]) for x in blocks]
        if any(labels):
            labelled.append((blocks, labels, spread(len(blocks))))

    def taken(blocks: list, labels: list[bool], at: Iterable[int], hide: bool) -> tuple[list[list[str]], list[bool]]:
        known = list(features(blocks, hide))
        return [known[k] for k in at], [labels[k] for k in at]

    return fit(taken(b, y, at, hide) for b, y, at in labelled for hide in (False, True))


def main_text(html: str | None, model: Model) -> str:
    blocks = blocks_of(html)
    return "\n\n".join(b[0] for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep)


def extracted(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and ``n_chars``."""

    @F.arrow_udf(T.StringType())
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raw in batches:
            yield pa.array([main_text(x.as_py(), model) for x in raw], pa.string())

    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), extract(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
