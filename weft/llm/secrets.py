"""Secret scans: fixed patterns, and strings that zstandard finds new in a sensitive place.

Base spans come from three patterns. The novelty method looks at the strings that follow a sensitive
word, on its line or the next ones, or stand before it, and measures, with a compressor primed
with an identifier dictionary, how many bytes the string adds to its surroundings. Both are measured behind one fixed frame, whose signs
are as frequent as those of names, so that the compressor codes signs the same way in a text of one line and in a long one. Names, paths,
dates and prose compress well against the dictionary, the frame and the text around them; random key material does not and is reported.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, keyed, per_batch

KINDS = ("assign", "access", "hex", "novel")

#: Base patterns (fixed by the contract); each with the least length of what must be long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Words that make a place sensitive, and how far behind one a candidate may begin, or before one end.
SENSITIVE_WORDS = (b"passw", b"passphrase", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth", b"private", b"signature")
SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|pwd|secret|token|key|credential|bearer|auth|private|signature", re.IGNORECASE | re.ASCII)
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.~-]{16,}={0,2}")
#: A candidate as a whole, and what may lie between the lines of one key (quotes, and a line end or the backslash of a written one).
WHOLE = re.compile(rf"(?<![A-Za-z0-9+/_.~-]){CANDIDATE.pattern}")
GAP = re.compile(r"""(?=[^\r\n\\]*+[\r\n\\])[\s"'+,\\]{1,64}""")
#: Code points of the text on each side that a candidate is measured against.
AROUND = 256
#: Least added bytes: this many per character, and half a byte. Random strings of both cases, with digits, base64 and upper-case
#: hexadecimal add 0.78 and more per character from 24 characters on; names, dates and numbers up to 0.75, random lower case 0.72.
NOVELTY, MORE = 0.76, 0.5
#: Characters measured at a time, against those before them.
PIECE = 64
#: The frame's length in signs, and its shares of capitals, digits and joining signs; the other signs are those of LANGUAGE_WORDS.
FRAME, CAPITALS, DIGITS, JOINTS = 2048, 0.02, 0.25, 0.05
LEVEL = 3

#: Identifiers in the dictionary: those that are at least one in so many of all in the corpus (so there are no more than that), and
#: these words of common languages.
ONE_IN = 16_384
LANGUAGE_WORDS = """and array as async await bool boolean break byte case catch char class config const continue
def default delete dict double else enum except export extends false final finally float for from func
function if implements import in include int interface is lambda let list long map namespace new nil none
not null object or package pass print private protected public raise return self short static string
struct super switch template this throw true try type typedef union unsigned using value var virtual void while with yield""".split()


def identifiers(docs: DataFrame, one_in: int = ONE_IN) -> list[str]:
    """The identifiers of all texts (names before one of ``:=(``, at most 64 characters each) that are at least one in ``one_in``, frequent ones first."""
    found = docs.where("text rlike '[:=(]'").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]{2,63})[\"']? ?[:=(]"), F.lit(1))).alias("name"))
    counted = cut(found.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).scalar()
    return [r["name"] for r in counted.where(F.col("n") * one_in >= total).orderBy(F.desc("n"), "name").collect()]  # at most ``one_in``


def frame() -> str:
    """Signs drawn at random with the shares of names, the same in every process; then words of the dictionary.

    The compressor looks less closely for matches the longer it has found none; the words make it look at every place of the text that follows.
    """
    draw, letters = random.Random(0), "".join(LANGUAGE_WORDS)
    signs = draw.choices((letters, string.ascii_uppercase, string.digits, "_-/."), (1 - CAPITALS - DIGITS - JOINTS, CAPITALS, DIGITS, JOINTS), k=FRAME)
    return "".join(draw.choice(x) for x in signs) + "\n".join(LANGUAGE_WORDS)


def dictionary(names: list[str]) -> bytes:
    """Raw dictionary content; the most frequent names come last, where matches are cheapest."""
    return "\n".join([*LANGUAGE_WORDS, *reversed(names)]).encode()


class Scanner:
    """Spans of one text. ``words`` is the raw content of the identifier dictionary."""

    def __init__(self, words: bytes):
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.frame = frame().encode()

    def added(self, around: str, candidate: str) -> int:
        """Marginal compressed bytes of the candidate, piece by piece behind the frame, the text around and the piece before."""
        near, whole, sizes = self.frame + around.encode("utf-8", "surrogatepass"), candidate.encode(), 0
        for at in range(0, len(whole), PIECE):
            known = near + whole[max(0, at - PIECE) : at]
            sizes += len(self.compress(known + whole[at : at + PIECE])) - len(self.compress(known))
        return sizes

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
        low = text.encode("utf-8", "surrogatepass").lower()
        spans = []
        if any(w in low for w in ASSIGN_WORDS):
            spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
        if "AKIA" in text:
            spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        if any(w in low for w in SENSITIVE_WORDS):
            spans += self.novel(text, sorted(spans))
        return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))

    def novel(self, text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
        """Candidates near a sensitive word that add too many bytes and overlap no base span."""
        words = [w.span() for w in SENSITIVE.finditer(text)]
        begins, ends = [w[0] for w in words], [w[1] for w in words]
        wholes = [m.span() for m in WHOLE.finditer(text)]
        base, measured, done, lasts = Spans([x[:2] for x in taken]), [], 0, self.lasts(text, wholes)
        for _, after in words:
            at = max(done, after)
            while (m := CANDIDATE.search(text, at, min(len(text), after + REACH + 16))) and m.start() <= after + REACH:
                i = bisect_right(wholes, (m.start(), len(text))) - 1  # the string that the candidate is, or ends
                first, last, new = m.start(), lasts[i], True
                if text[first - 1].isalnum() and text[first].isalnum() and wholes[i][0] >= done:  # inside a longer word
                    first = wholes[i][0]
                for k in range(i, len(wholes)):
                    start, end = max(first, wholes[k][0]), wholes[k][1]
                    if start >= last or k > i and not new:
                        break
                    at = done = end
                    new = base.meet(start, end)
                    if not new:
                        measured.append((start, end))
                        if new := self.is_new(text, start, end, first, last, ends):
                            yield start, end, "novel"
        behind = Spans(measured)
        for start, end in wholes:
            k = bisect_left(begins, end)
            if k < len(begins) and begins[k] <= end + REACH and not base.meet(start, end) and not behind.meet(start, end) and self.is_new(text, start, end, start, end, []):
                yield start, end, "novel"

    @staticmethod
    def lasts(text: str, wholes: list[tuple[int, int]]) -> list[int]:
        """For each string the end of the last one that follows it like the lines of one key."""
        out = [end for _, end in wholes]
        for k in range(len(wholes) - 2, -1, -1):
            if wholes[k + 1][0] - wholes[k][1] <= 64 and GAP.fullmatch(text, wholes[k][1], wholes[k + 1][0]):
                out[k] = out[k + 1]
        return out

    def is_new(self, text: str, start: int, end: int, first: int, last: int, ends: list[int]) -> bool:
        """Measured against the text around ``first`` to ``last``, without copies in reach behind a word that ends at one of ``ends``."""
        string = text[start:end]
        around = without(text, max(0, first - AROUND), first, string, ends) + without(text, last, min(len(text), last + AROUND), string, ends)
        return self.added(around, string) >= NOVELTY * len(string) + MORE


class Spans:
    """Spans in order of their starts, asked for overlaps."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def meet(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def without(text: str, low: int, high: int, string: str, ends: list[int]) -> str:
    """``text[low:high]`` less the copies of ``string`` that begin in reach behind a word."""
    parts, at, p = [], low, text.find(string, max(0, low - len(string) + 1), high + len(string)) if ends else -1
    while -1 < p < high:
        k = bisect_right(ends, p)
        if k and ends[k - 1] >= p - REACH:
            parts.append(text[at : max(at, p)])
            at = min(high, p + len(string))
        p = text.find(string, p + len(string), high + len(string))
    return " ".join([*parts, text[at:high]])


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_assign, n_access, n_hex, n_novel, base_spans, spans.

    Spans are ``kind:start:end`` in code points. NULL or empty texts have none (empty strings); NULL ids and
    repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    docs = keyed(df, id_col, text_col)
    words = dictionary(identifiers(docs))
    holder: list[Scanner] = []

    def run(ids: list, texts: list[str]) -> dict:
        scanner = holder[0] if holder else holder.append(Scanner(words)) or holder[0]
        found = [scanner.scan(t) for t in texts]
        counts = {f"n_{k}": [sum(s[2] == k for s in spans) for spans in found] for k in KINDS}
        return {"doc_id": ids, **counts, "base_spans": [written([s for s in x if s[2] != "novel"]) for x in found], "spans": [written(x) for x in found]}

    return per_batch(docs, run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<secret:{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with the secrets of its texts masked and ``length_col`` (if there) counted again for those texts.

    Every row stays, in its columns' order. NULL and empty texts, NULL ids and the lengths of texts without secrets stay as they are; repeated
    rows are masked alike; an empty table gives no rows; other columns are passed on untouched.
    """
    words = dictionary(identifiers(keyed(df, id_col, text_col)))
    at, holder = df.columns.index(text_col), []
    counted = length_col in df.columns
    place = df.columns.index(length_col) if counted else -1

    def run(batch: pa.RecordBatch) -> dict:
        scanner = holder[0] if holder else holder.append(Scanner(words)) or holder[0]
        before = batch.column(at).to_pylist()
        after = [masked(t, s) if t and (s := scanner.scan(t)) else t for t in before]
        lengths = batch.column(place).to_pylist() if counted else []
        return {text_col: after, length_col: [len(b) if b is not a else n for a, b, n in zip(before, after, lengths)]}

    return extended(df, text_col, run, {}, (text_col, length_col) if counted else (text_col,))
