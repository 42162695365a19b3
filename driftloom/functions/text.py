"""Text columns: tokens, n-grams, cleaning and filters. Built-in functions but for nested templates, entities and NFKC."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's str.split() knows; Java's \s alone lacks some.
BLANKS = r"\s\x1c-\x1f\x85   -     　"
#: Patterns of the cleaning steps.
TAG = "<[^>]+>"
LINK = r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]"
URL_WITH_WORDS = rf"\[https?://[^{BLANKS}]+[{BLANKS}]+([^\]]+)\]"
URL_ALONE = rf"\[https?://[^{BLANKS}]+\]"
HEADING = "={2,}([^=]+)={2,}"
FILE_LINK = r"(?i)\[\[(?:File|Image|Media):[^\]]+\]\]"
BLANK_RUN, LINE_RUN = "[ \t]+", "\n{3,}"
CLOSED_ENTITY = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[^\t\n\f <&#;]{1,32};)")
#: Fixed values of the reference semantics.
MIN_TOKENS, CONTROL_SHARE, NON_ASCII_SHARE = 50, 0.01, 0.30


def tokens(text: Column) -> Column:
    """Whitespace tokens, case and punctuation kept. Null text: no tokens."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def strip_blank(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def ngrams(toks: Column, n: int) -> Column:
    """n-grams joined by a blank (tokens hold none, so no two collide); shorter documents have none."""
    if n == 1:
        return toks
    last = F.size(toks) - n
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(toks, i + 1, n)))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the lower-cased text; none for shorter texts. For capped texts."""
    low = F.lower(text)
    last = F.length(low) - n
    cut = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(low, i + 1, F.lit(n))))
    return F.when(last >= 0, cut).otherwise(F.array().cast("array<string>"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def resolve_links(text: Column) -> Column:
    """[[target|shown]] and [[shown]] become shown; [http... shown] becomes shown; a bare [http...] goes."""
    text = F.regexp_replace(text, LINK, "$1")
    text = F.regexp_replace(text, URL_WITH_WORDS, "$1")
    return F.regexp_replace(text, URL_ALONE, "")


def strip_headings(text: Column) -> Column:
    """==heading== keeps its words; file links that still stand go (after resolve_links none do)."""
    text = F.regexp_replace(text, HEADING, "$1")
    return F.regexp_replace(text, FILE_LINK, "")


def squeeze(text: Column) -> Column:
    """Runs of blanks and tabs to one blank, three and more line feeds to two, ends stripped."""
    text = F.regexp_replace(text, BLANK_RUN, " ")
    return strip_blank(F.regexp_replace(text, LINE_RUN, "\n\n"))


def is_redirect(text: Column) -> Column:
    return F.startswith(F.lower(strip_blank(text)), F.lit("#redirect"))


def _without_templates(text: str) -> str:
    """Text outside {{...}}, which nest: an unclosed one runs to the end, a closing mark without opening goes."""
    if "{{" not in text and "}}" not in text:
        return text
    out, depth, at = [], 0, 0
    while at < len(text):
        opened, closed = text.find("{{", at), text.find("}}", at)
        marks = [x for x in (opened, closed) if x >= 0]
        nearest = min(marks, default=len(text))
        if depth == 0:
            out.append(text[at:nearest])
        if marks:
            depth = depth + 1 if nearest == opened else max(0, depth - 1)
        at = nearest + 2
    return "".join(out)


def strip_templates(text: Column) -> Column:
    def strip(text: pd.Series) -> pd.Series:
        return text.map(_without_templates, na_action="ignore")

    return F.pandas_udf(strip, "string")(text)


def _closed_entity(m: re.Match) -> str:
    name = m.group(1)
    return html.unescape(m.group()) if name[0] == "#" else html5.get(name, m.group())


def _unescape_closed(text: str) -> str:
    return CLOSED_ENTITY.sub(_closed_entity, text) if "&" in text else text


def decode_normalise(text: Column, closed: bool = False) -> Column:
    """HTML entities decoded, then NFKC. closed: only those that end in a semicolon; the library's rule decodes &amp without one, too."""
    unescape = _unescape_closed if closed else html.unescape

    def decode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.normalize("NFKC", unescape(t)), na_action="ignore")

    return F.pandas_udf(decode, "string")(text)


def clean_wiki(text: Column, closed: bool = False) -> Column:
    """Full cleaner; the order of the steps is part of the result. closed: see decode_normalise."""
    out = squeeze(strip_headings(resolve_links(decode_normalise(strip_tags(strip_templates(text)), closed))))
    return F.when(is_redirect(text), "").otherwise(out)


def clean_light(text: Column, closed: bool = False) -> Column:
    """Cleaner of texts without markup. closed: see decode_normalise."""
    return F.when(is_redirect(text), "").otherwise(squeeze(decode_normalise(text, closed)))


def encoding_ok(text: Column) -> Column:
    """No U+FFFD, at most 1 % control and format characters (but line feed and tab), at most 30 % outside ASCII."""
    n = F.length(text)
    control = F.length(F.regexp_replace(text, r"[^\p{Cc}\p{Cf}]|[\n\t]", ""))
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return ~F.contains(text, F.lit("�")) & ~(control > n * CONTROL_SHARE) & ~(wide > n * NON_ASCII_SHARE)


def truncate(text: Column, toks: Column, cap: int) -> Column:
    """The first cap tokens joined by blanks; a text within the cap stays as it is."""
    return F.when(F.size(toks) > cap, F.concat_ws(" ", F.slice(toks, 1, cap))).otherwise(text)


def reject_reason(text: Column, toks: Column, min_tokens: int = MIN_TOKENS) -> Column:
    """The first filter that rejects: empty, encoding, too_short; kept otherwise."""
    return F.when(F.length(text) == 0, "empty").when(~encoding_ok(text), "encoding").when(F.size(toks) < min_tokens, "too_short").otherwise("kept")


def word_piece_proxy(text: Column) -> Column:
    """Stand-in for a subword counter: words in pieces of at most 4 letters or digits, other marks singly. Not a tokenizer."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]{1,4}|[^A-Za-z0-9\s]"))
