"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into its leaf blocks (runs of text between block-level tags). Each block has features of
its ancestors (tags, words of class, id and role) and of its text (length, share of links, ending, cue words).
The field scores the sequence of labels main / other; it is trained on labelled pages by
gradient steps on the exact likelihood and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, extended, texts_of
from .labelled_pages import MARK, labelled_pages

BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td
tfoot th thead tr ul""".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("applet audio canvas datalist head map noframes noscript object option select svg template video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes these open elements first, if no element of the second set lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"})}
CLOSES_P = BLOCKS - {"body", "html", "button", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: Page parts that their own end tags alone close: a stray end tag inside can't reach beyond them.
WALLS = frozenset("article aside footer form header main nav section table".split())

TOKEN = re.compile(
    r"""<!--(?:>|.*?(?:--!?>|\Z))|<(script|style|textarea|title|iframe|xmp)\b(?:[^'">]++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
XMP = re.compile(r"""<xmp\b((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>(.*?)(?:</xmp\s*>|\Z)""", re.DOTALL | re.IGNORECASE)
SILENT_TAG = re.compile(rf"<(?:{'|'.join(sorted(SILENT))})\b", re.IGNORECASE)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""\shidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
#: Words in a block that tell of its part in the page.
CUES = re.compile(r"\b(cookies?|subscribe|newsletter|sign up|log ?in|copyright|all rights reserved|privacy|comments?|replies|reply|says|share|tweet|advertisement|sponsored|related|home|contact|search|accept)\b|©", re.IGNORECASE)

#: Parts of names that tell of a part of the page, within longer names too.
STEMS = """comment repl respon discuss thread feedback reaction navig navbar menu sidebar rail footer header banner advert sponsor promo
cookie consent gdpr notice alert warning popup modal newsletter subscri share social relat recommend breadcrumb search login widget
content article story""".split()


#: Tags and parts of names of elements that hold a story.
HOLDS = re.compile(r"^(?:article|main)\b| .*(?:content|article|story|post|entry|main|body|text)")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # the open elements as ``tag attributes``
    links: int  # characters inside links
    main: bool = False
    bare: bool = False  # no block of the page lies in an element that by tag or name holds a story


def element(tag: str, attributes: str) -> str:
    """An open element as a key: its tag and the words of its class, id and role."""
    names = " ".join(w for m in NAMES.finditer(attributes) for w in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower())) if attributes else ""
    return f"{tag} {names}{' -hidden' if attributes and HIDDEN.search(attributes) else ''}".rstrip()


def silences(page: str) -> dict[int, int]:
    """For the start tags of silent elements (by number of token): the token at which text counts again.

    That is the end tag, for an option the next option too. An element that its block leaves unclosed ends at the next
    tag of a block, so that no later block is lost.
    """
    ends: dict[int, int] = {}
    bounds: dict[int, int] = {}
    open_now: list[tuple[str, int]] = []  # blocks and silent elements
    waiting: list[int] = []  # silent elements since the last tag of a block
    for i, m in enumerate(TOKEN.finditer(page)):
        if (m[1] or "").lower() == "xmp":
            bounds.update((at, i) for at in waiting)
            waiting.clear()
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in SILENT:
            if closing:
                k = next((k for k in range(len(open_now) - 1, -1, -1) if open_now[k][0] == tag), -1)
                if k >= 0:
                    ends[open_now[k][1]] = i
                    del open_now[k:]
            elif not m[4].endswith("/"):
                if tag == "option" and open_now and open_now[-1][0] == tag:
                    ends[open_now.pop()[1]] = i
                open_now.append((tag, i))
                waiting.append(i)
        elif tag in BLOCKS:
            bounds.update((at, i) for at in waiting)
            waiting.clear()
            if tag in ("body", "html"):
                open_now.clear()
            elif closing:
                for k in range(len(open_now) - 1, -1, -1):
                    if open_now[k][0] == tag:
                        del open_now[k:]
                        break
                    if open_now[k][0] in WALLS and tag not in WALLS:
                        break
            elif tag not in VOID:
                if open_now and (open_now[-1][0] == "p" and tag in CLOSES_P or open_now[-1][0] in CLOSES.get(tag, ((),))[0]):
                    open_now.pop()
                open_now.append((tag, i))
    bounds.update((at, sys.maxsize) for at in waiting)
    return bounds | ends


def blocks(page: str, labelled: bool = False) -> list[Block]:
    """The leaf blocks of a page in order; their texts are decoded, with single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, key, marked as main
    parts: list[str] = []
    linked, in_link, silent = 0, False, -1  # silent: the token up to which no text counts
    silence = silences(page) if SILENT_TAG.search(page) else {}
    keep = functools.partial(flush, out, stack, parts)
    at = 0
    for i, m in enumerate(TOKEN.finditer(page)):
        if m.start() > at and i > silent:
            part = page[at : m.start()]
            parts.append(part)
            linked += len(part) if in_link else 0
        at = m.end()
        if i < silent:
            continue
        if (m[1] or "").lower() == "xmp":  # preformatted text without markup
            attributes, raw = XMP.fullmatch(m[0]).groups()
            keep(linked)
            open_(stack, "pre", attributes, labelled)
            parts.append(html.escape(raw))
            keep(0)
            close(stack, "pre", "", labelled)
            linked, in_link = 0, False
            continue
        tag = m[3]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag in SILENT:
            silent = silence.get(i, silent)
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            keep(linked)
            linked, in_link = 0, False
            (close if closing else open_)(stack, tag, m[4], labelled)
    if at < len(page) and silent < sys.maxsize:
        parts.append(page[at:])
        linked += len(page) - at if in_link else 0
    keep(linked)
    return whole(out)


def whole(found: list[Block]) -> list[Block]:
    """The blocks, with what only the page as a whole tells."""
    if not any(held(b.path) for b in found):
        for b in found:
            b.bare = True
    return found


@functools.lru_cache(maxsize=100_000)
def held(path: tuple[str, ...]) -> bool:
    return any(HOLDS.search(key) for key in path)


def flush(out: list[Block], stack: list, parts: list[str], linked: int) -> None:
    """End the block that is being read."""
    text = " ".join("".join(map(html.unescape, parts)).split())  # a reference ends with its run of text
    parts.clear()
    if text:
        out.append(Block(text, tuple(key for _, key, _ in stack), linked, any(main for *_, main in stack)))


def open_(stack: list, tag: str, attributes: str, labelled: bool) -> None:
    if tag in CLOSES_P:
        close(stack, "p", "", False)
    if tag in CLOSES:
        ends, walls = CLOSES[tag]
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                del stack[k:]
                break
            if stack[k][0] in walls:
                break
    if tag not in VOID:
        stack.append((tag, element(tag, attributes), labelled and "data-main" in attributes))


def close(stack: list, tag: str, attributes: str, labelled: bool) -> None:
    """Close the innermost open element of that name, and what is open inside."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == tag:
            del stack[k:]
            return
        if stack[k][0] in WALLS and tag not in WALLS and tag not in ("body", "html"):
            return


def path_features(path: tuple[str, ...]) -> set[str]:
    """Features of the ancestors: their tags, their names, and the innermost of them."""
    found = set()
    for key in path:
        tag, *names = key.split(" ")
        found.add(f"in {tag}")
        found.update(f"named {n}" for n in names)
        found.update(f"like {s}" for n in names for s in STEMS if s in n)
    if path:
        found.add(f"at {path[-1].split(' ')[0]}")
    return found


def text_features(block: Block) -> list[str]:
    words, text = block.text.count(" ") + 1, block.text
    share = min(1.0, block.links / len(text))
    size = 0 if words < 4 else 1 if words < 10 else 2 if words < 30 else 3
    place = ("bare" if block.bare else "held" if held(block.path) else "outside") + (" named" if any(" " in key for key in block.path) else "")
    found = [place, f"{place} words {size}", f"{place} at {block.path[-1].split(' ')[0] if block.path else 'page'}", f"words {size}", f"links {0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}", "sentence" if text[-1] in ".!?…:\"”»" else "no sentence"]
    if size < 3:
        found += {f"cue {(m[1] or 'sign').lower()}" for m in CUES.finditer(text)}
    return found


class Field:
    """The trained field: a weight per feature for label main, transitions between labels, and ends."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, begin: np.ndarray):
        self.weights, self.moves, self.begin = weights, moves.tolist(), begin.tolist()
        self.paths: dict[tuple[str, ...], float] = {}

    def emission(self, block: Block) -> float:
        base = self.paths.get(block.path)
        if base is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            base = self.paths[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        return base + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi: the likeliest sequence of labels."""
        if not found:
            return []
        (stay0, to1), (to0, stay1) = self.moves
        back: list[tuple[int, int]] = []
        other, main = self.begin[0], self.begin[1] + self.emission(found[0])
        for block in found[1:]:
            from0, from1 = (0, other + stay0) if other + stay0 >= main + to0 else (1, main + to0), (0, other + to1) if other + to1 > main + stay1 else (1, main + stay1)
            back.append((from0[0], from1[0]))
            other, main = from0[1], from1[1] + self.emission(block)
        label = int(main > other)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return [x == 1 for x in reversed(labels)]

    def text(self, page: str) -> str:
        found = blocks(page)
        return " ".join(b.text for b, main in zip(found, self.decode(found)) if main)


def marked(found: list[Block]) -> list[Block]:
    """Main text outside of any element begins with MARK."""
    for b in found:
        if MARK in b.text:
            b.main, b.text = True, b.text.replace(MARK, "")
    return found


def train(pages: list[str], rounds: int = 150, rate: float = 0.2, ridge: float = 0.02) -> Field:
    """Fit by Adam steps on the penalised log-likelihood of all pages at once (forward and backward in numpy)."""
    sequences = [s for s in (marked(blocks(p, labelled=True)) for p in pages) if s]
    names = sorted({f for s in sequences for b in s for f in (*path_features(b.path), *text_features(b))})
    number = {f: i for i, f in enumerate(names)}
    n, longest = len(sequences), max(map(len, sequences))
    x = np.zeros((n, longest, len(names)), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, s in enumerate(sequences):
        for t, b in enumerate(s):
            x[i, t, [number[f] for f in (*path_features(b.path), *text_features(b))]] = 1
            y[i, t], mask[i, t] = b.main, True
    theta = np.zeros(len(names) + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, moves, begin = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        emit = np.zeros((n, longest, 2))
        emit[..., 1] = x @ w
        gradient = likelihood_gradient(x, y, mask, emit, moves, begin) - ridge * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(dict(zip(names, theta[:-6].tolist())), theta[-6:-2].reshape(2, 2), theta[-2:])


def likelihood_gradient(x, y, mask, emit, moves, begin) -> np.ndarray:
    """Observed minus expected counts of features, moves and first labels, over padded sequences."""
    n, longest, _ = emit.shape
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[:, 0] = begin + emit[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
    total = np.logaddexp.reduce(alpha[:, -1], axis=1)
    marginal = np.exp(alpha + beta - total[:, None, None])[..., 1] * mask
    gap = np.where(mask, y - marginal, 0)
    moved = np.zeros((2, 2))
    for t in range(1, longest):
        on = mask[:, t]
        expected = np.exp(alpha[:, t - 1, :, None] + moves + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
        np.add.at(moved, (y[on, t - 1], y[on, t]), 1)
        moved -= expected[on].sum(axis=0)
    start = np.array([(y[:, 0] == k).sum() for k in (0, 1)]) - np.exp(alpha[:, 0] + beta[:, 0] - total[:, None]).sum(axis=0)
    return np.concatenate([gap.ravel().astype(x.dtype) @ x.reshape(-1, x.shape[-1]), moved.ravel(), start])


@functools.lru_cache(maxsize=1)
def standard_field() -> Field:
    """The field trained on the labelled pages of this package."""
    return train(labelled_pages())


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None, field: Field | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id (the page's id), the columns ``keep``, text (empty if none), n_chars (its code points).

    NULL pages are empty; NULL ids and repeated rows are kept; an empty table gives no rows. The field
    (a few hundred weights) is fitted once on the driver and shipped with the task. Nothing is shuffled.
    """
    model = field or standard_field()
    model.paths.clear()
    kept = keep or []
    narrow = df.select(col(id_col).cast("long").alias("doc_id"), *map(col, kept), col(html_col).cast("string").alias("weft_html"))
    last = len(kept) + 1

    def run(batch: pa.RecordBatch) -> dict:
        found = [model.text(t) for t in texts_of(batch.column(last))]
        return {"text": found, "n_chars": [len(t) for t in found]}

    return extended(narrow, "weft_html", run, {"text": "string", "n_chars": "long"}).select("doc_id", *map(col, kept), "text", "n_chars")
