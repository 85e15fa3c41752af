"""Column → Column text functions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Token patterns.
WORD = r"[\p{L}\p{N}_]{2,}"
ALPHA = r"[\p{L}]{2,}"

# Signs that do not survive the cleaning of keywords and of texts; what is dropped before.
KEYWORD_SIGNS = r"[^a-zA-Z0-9. ]+"
TEXT_SIGNS = r"[^a-zA-Z0-9.!? ]+"
ADDRESSES = r"(https?://[^ \n]+|[^ \n@]+@[^ \n@]+)"

# Default stop words of the four corpus languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "as", "are", "by", "with", "from",
    "le", "la", "les", "de", "des", "un", "une", "et", "dans", "du", "que", "elle", "qui", "au", "pour",
    "der", "die", "das", "und", "ist", "nicht", "sich", "ein", "eine", "auf", "mit", "den", "zu", "von",
    "el", "los", "las", "una", "con", "por", "para", "no", "se", "es", "del", "al", "lo", "su", "en",
]


def words(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def space_words(text: Column) -> Column:
    """Split on single spaces, nothing else."""
    return F.split(text, " ", -1)


def folded_space_words(text: Column) -> Column:
    """Lower-cased text split on single spaces: case is folded before a caller's tokenizer sees a text."""
    return space_words(F.lower(text))


def alpha_words(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Alphabetic lower-case tokens of two or more letters without stop words."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(ALPHA), F.lit(0))
    return drop_stop_words(toks, stop)


def drop_stop_words(toks: Column, stop: list[str]) -> Column:
    return F.filter(toks, lambda w: ~w.isin(stop)) if stop else toks


def split_list(text: Column, sep: str) -> Column:
    """A delimited field as an array, without empty parts."""
    return F.filter(F.split(text, "\\Q" + sep + "\\E", -1), lambda x: x != "")


def remove_value(text: Column, value: str, sep: str = ";") -> Column:
    """Drop one value from a delimited list; no stray separators remain."""
    return F.concat_ws(sep, F.array_remove(split_list(text, sep), value))


def same(word: Column) -> Column:
    return word


def clean_keywords(text: Column, sep: str = ";", merge: str = ";", lemma: Callable[[Column], Column] = same) -> Column:
    """Separators end a keyword; other signs become spaces; one-letter words go; lower, each word's
    ``lemma``, unique, sorted."""
    raw = F.regexp_replace(F.replace(text, F.lit(sep), F.lit(".")), KEYWORD_SIGNS, " ")

    def one(k: Column) -> Column:
        return F.concat_ws(" ", F.transform(F.filter(F.split(F.lower(k), " +", -1), lambda w: F.length(w) > 1), lemma))

    keys = F.transform(F.split(raw, r"\.", -1), one)
    return F.concat_ws(merge, F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != ""))))


def sentences(text: Column) -> Column:
    """Parts between ``.``, ``!`` and ``?``, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[.!?]", -1), lambda s: F.trim(s)), lambda s: s != "")


def clean_text(text: Column, stop: list[str] = STOP_WORDS, remove_num: bool = True, merge: str = " ", lemma: Callable[[Column], Column] = same) -> Column:
    """Keep letters, digits and sentence ends; per sentence drop stop words, one-letter words and
    (optionally) numbers, and put each word's ``lemma``; URLs and e-mail addresses are dropped before signs
    are removed."""
    no_url = F.regexp_replace(text, ADDRESSES, " ")
    kept = F.regexp_replace(no_url, TEXT_SIGNS, " ")

    def keep(w: Column) -> Column:
        ok = (F.length(w) > 1) & ~F.lower(w).isin(stop)
        return ok & ~w.rlike("^[0-9]+$") if remove_num else ok

    sent = F.transform(F.split(kept, "[.!?]", -1), lambda s: F.concat_ws(" ", F.transform(F.filter(F.split(s, " +", -1), keep), lemma)))
    return F.concat_ws(merge, F.filter(sent, lambda s: s != ""))


def placeholder(word: Column) -> Column:
    """E-mail addresses and numbers become fixed marks."""
    return (
        F.when(word.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit("-EMAIL-"))
        .when(word.rlike(r"^[0-9]+([.,][0-9]+)?$"), F.lit("-NUMBER-"))
        .otherwise(word)
    )


def placeholder_tokens(toks: Column) -> Column:
    return F.transform(toks, placeholder)


def sentences_with_context(text: Column, contexts: list[str]) -> Column:
    """Only the sentences that contain one of the context words."""
    ctx = F.array(*[F.lit(c) for c in contexts])
    return F.filter(sentences(text), lambda s: F.exists(ctx, lambda c: F.contains(F.lower(s), c)))


def clean_tag_doc(text: Column) -> Column:
    """Lower, signs other than point and space to a space, collapsed, trimmed."""
    low = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_ .]", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def normalise_label(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))


def normalise_mapping_field(text: Column, separators: str = ";,/") -> Column:
    """Label separators removed, spaces collapsed, lower."""
    out = F.translate(text, separators, " " * len(separators))
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def singular(word: Column) -> Column:
    """Plain plural rules: ``ies`` → ``y``; ``sses`` → ``ss``; a final ``s`` goes unless ``ss``/``us``/``is``."""
    return (
        F.when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("sses$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("(ss|us|is)$") | ~word.rlike("..s$"), word)
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def xy_string(x: Column, y: Column) -> Column:
    return F.concat_ws(",", x.cast("string"), y.cast("string"))


def strip_tags(html: Column) -> Column:
    """Text of a piece of HTML: tags out, the common entities resolved, spaces collapsed."""
    txt = F.regexp_replace(html, "<[^>]*>", " ")
    # Entities and their signs; the ampersand comes last.
    for ent, sign in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")]:
        txt = F.replace(txt, F.lit(ent), F.lit(sign))
    return F.trim(F.regexp_replace(txt, r"[ \t\r\n]+", " "))
