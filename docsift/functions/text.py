"""Text column functions: tokens, clean-up, boundary candidates. All JVM-side and row-local."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from docsift.functions.stopwords import ENGLISH

# Token and boundary patterns.
TOKEN = "([A-Za-z]+[']*[A-Za-z]*)"
BLANK = r"[ \t\n\x0B\f\r]"
CANDIDATE = r"\.[\"')\]]*(?:<A>)?(?:<E>)?(?:<S>)?"
MARKS = "<[AES]>"
NUMBER = r"[.,\d]*\d"
ODD = r"[^a-zA-Z0-9,.;:<>\-'/?!$% ]"

# The ordered rewrites of the treebank-like tokenizer, as (pattern, replacement).
TREEBANK = [
    (r"''", '"'),
    (r"``", '"'),
    (r"(^|\s)(')", r"$1$2 "),
    (r'(?=[\("`{\[:;&#\*@])(.)', r"$1 "),
    (r"""(.)(?=[?!)";}\]\*:@'])""", r"$1 "),
    (r"(?=[\)}\]])(.)", r"$1 "),
    (r"(.)(?=[({\[])", r"$1 "),
    (r"((^|\s)-)(?=[^-])", r"$1 "),
    (r"([^-])(--+)([^-])", r"$1 $2 $3"),
    (r"(\s|^)(,)(?=(\S))", r"$1$2 "),
    (r"(.)(,)(\s|$)", r"$1 $2$3"),
    (r"\.\s\.\s\.", r"..."),
    (r"([A-Za-z]\.)(\d+)", r"$1 $2"),
    (r"([^.]|^)(\.{2,})(.?)", r"$1 $2 $3"),
    (r"(^|\s)(\.{2,})([^.\s])", r"$1$2 $3"),
    (r"([^.\s])(\.{2,})($|\s)", r"$1 $2$3"),
    (r"(\d)%", r"$1 %"),
    (r"\$(\.?\d)", r"\$ $1"),
    (r"(\w)& (\w)", r"$1&$2"),
    (r"(\w\w+)&(\w\w+)", r"$1 & $2"),
    (r"n 't( |$)", r" n't$1"),
    (r"N 'T( |$)", r" N'T$1"),
    (r"([Cc])annot", r"$1an not"),
    (r"\s+", r" "),
]


def tokens(text: Column, lowercase: bool = False) -> Column:
    """Array of ASCII word tokens, in order, case kept unless asked otherwise."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(TOKEN), F.lit(1))


def is_stopword(word: Column, stopwords=ENGLISH) -> Column:
    return F.lower(word).isin(list(stopwords))


def content_tokens(text: Column, stopwords=ENGLISH, lowercase: bool = False) -> Column:
    """Tokens without stopwords, filtered inside the row, before anything is exploded."""
    return F.filter(tokens(text, lowercase), lambda w: ~is_stopword(w, stopwords))


def once(value: Column, then) -> Column:
    """then(value), with value evaluated once however often `then` uses it: array functions share nothing by themselves."""
    return F.transform(F.array(value), then)[0]


def squeeze(text: Column) -> Column:
    """Words joined with single spaces."""
    return F.btrim(F.regexp_replace(text, BLANK + "+", " "), F.lit(" "))


def joined_lines(text: Column) -> Column:
    """Lines joined with spaces, so that a wrapped or blank line does not end a sentence."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def clean_lines(text: Column, separator: str = "\n") -> Column:
    """Lines stripped, empty ones dropped, joined again."""
    stripped = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", ""))
    return F.array_join(F.filter(stripped, lambda x: x != ""), separator)


def treebank(text: Column) -> Column:
    for pattern, replacement in TREEBANK:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def unmarked(text: Column) -> Column:
    """Without the annotation marks."""
    return F.regexp_replace(text, MARKS, "")


def boundary_clean(text: Column) -> Column:
    """Numbers become <NUM>; characters outside the kept set go; a double dash is a space."""
    text = F.regexp_replace(text, NUMBER, "<NUM>")
    return F.replace(F.regexp_replace(text, ODD, ""), F.lit("--"), F.lit(" "))


def is_candidate(word: Column) -> Column:
    """Could a sentence end with this word?"""
    return word.rlike(CANDIDATE + "$")


def fragments(text: Column) -> Column:
    """Array of (orig, ends_seg): text cut after each candidate word and at blank lines.

    Works inside the row, so a corpus is split without any shuffle: one control character
    marks a cut, another a segment end. Blank lines before the first candidate do not cut.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0001\u0002\u0003]", " ")
    side = r"[ \t\x0B\f\r]*"
    text = F.regexp_replace(text, f"{BLANK}+$", "")
    text = F.regexp_replace(text, f"{side}\n{side}\n{BLANK}*", "\u0002")
    text = F.regexp_replace(text, f"({CANDIDATE})\u0002", "$1\u0003\u0001")
    text = F.regexp_replace(text, f"({CANDIDATE}){BLANK}+", "$1\u0001")
    pieces = once(text, _pieces)
    cut = F.transform(
        pieces,
        lambda p: F.struct(
            squeeze(F.replace(p, F.lit("\u0003"), F.lit(" "))).alias("orig"), p.endswith("\u0003").alias("ends_seg")
        ),
    )
    return F.filter(cut, lambda f: f["orig"] != "")


def _pieces(text: Column) -> Column:
    """The marked text cut at its marks; segment ends before the first cut are blanks."""
    head = F.substring_index(text, "\u0001", 1)
    tail = F.replace(F.substr(text, F.length(head) + 1), F.lit("\u0002"), F.lit("\u0003\u0001"))
    return F.split(F.concat(F.replace(head, F.lit("\u0002"), F.lit(" ")), tail, F.lit("\u0003")), "\u0001")


def edge_word(text: Column, last: bool = False) -> Column:
    """First or last word of a cleaned fragment whose words are separated by single spaces.

    Cleaning never crosses a space, so only the word at the edge is cleaned, and all of them if nothing is left of it.
    """
    end = -1 if last else 1
    word = squeeze(boundary_clean(F.substring_index(text, " ", end)))
    found = once(word, lambda w: F.when(w == "", squeeze(boundary_clean(text))).otherwise(w))
    return F.substring_index(found, " ", end)


def rule_sentences(text: Column) -> Column:
    """Sentences when every candidate is a boundary: the fragments themselves."""
    return F.transform(fragments(text), lambda f: f["orig"])
