"""Personal data: expressions propose spans, checksums confirm them, nearby words move the score. Column functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Score of a match that passes its check, before context; at least `LEAST` keeps the span.
    score: float
    context: str = ""
    #: Neither side of the match may touch an ASCII letter or digit.
    alone: bool = False


LEAST = 0.5
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 48
#: Code points of the chunks in which a text is looked up, and values of a block of running totals.
CHUNK, BLOCK = 256, 128

#: The contract's four kinds in its order. The patterns match what the contract's match, or leave out
#: matches that their check drops: atomic runs and a look behind keep the search linear on long runs.
BASE_KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|write|contact|kontakt|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){12}[0-9])[0-9]++(?:[ -][0-9]++)*+", 0.8, "card|visa|credit|pay|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
)
MORE_KINDS = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 0.8, "iban|account|konto|compte|cuenta|bank", True),
    Kind("ssn", r"(?<![0-9])[0-9]++(?:-[0-9]++)++", 0.3, "ssn|social security", True),  # kept only near such words
)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check of a string of digits, the last of which is the check digit."""
    return F.luhn_check(number) if hasattr(F, "luhn_check") else F.call_function("luhn_check", number)


def mod97(compact: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number: first four characters last, letters as 10 to 35; 1 is valid."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(step(a, ch)))


def passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = digits(found)
        return F.length(n).between(13, 19) & luhn(n)
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    if kind == "iban":
        compact = F.replace(found, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & (mod97(compact) == 1)
    if kind == "ssn":
        return found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return F.lit(True)


_SPAN = "array<struct<kind:string,rank:int,start:int,end:int,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: inside a lambda an expression would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the longs, op over all before it, from 0. Block by block: appending to one long array would copy it each time."""

    def along(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda acc, v: F.array_append(acc, op(F.element_at(acc, -1), v)))

    def of(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        return _let(F.transform(starts, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))), carried)

    def carried(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), op))
        inside = lambda carry: F.flatten(F.transform(blocks, lambda block, b: F.slice(along(block, F.get(carry, b)), F.lit(1), F.size(block))))
        return _let(along(totals, F.lit(0).cast("long")), inside)

    return F.when(F.size(values) > 0, _let(values, of)).otherwise(F.array().cast("array<long>"))


def _chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, so that a place is found without walking there."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start .. end - 1 of the text, where they exist."""
    first = F.floor(start / CHUNK)
    some = F.array_join(F.slice(chunks, (first + 1).cast("int"), (F.floor(end / CHUNK) - first + 1).cast("int")), "")
    return F.substring(some, (start - first * CHUNK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def _located(kind: Kind, rank: int, text: Column) -> Column:
    """Spans of the kind's matches: what stands between matches gives their places."""

    def span(chunks: Column, x: Column) -> Column:
        start, end = x["before"] + F.length(x["piece"]), x["before"] + F.length(x["piece"]) + F.length(x["hit"])
        ok = passes(kind.name, x["hit"])
        if kind.alone:
            ok &= ~F.concat(_cut(chunks, F.greatest(start - 1, F.lit(0)), start), F.lit(" "), _cut(chunks, end, end + 1)).rlike("[A-Za-z0-9]")
        near = F.lower(F.concat(_cut(chunks, F.greatest(start - CONTEXT_CHARS, F.lit(0)), start), F.lit(" "), _cut(chunks, end, end + CONTEXT_CHARS)))
        score = F.lit(kind.score) + (F.when(near.rlike(rf"(?<![a-z])(?:{kind.context})"), CONTEXT_GAIN).otherwise(0.0) if kind.context else 0.0)
        score = F.when(ok, F.least(score, F.lit(1.0))).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"))

    def spans(hits: Column) -> Column:
        # the places of what is left of the text: the split has one piece more than there are matches
        pairs = F.zip_with(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
        return _let(pairs, placed)

    def placed(pairs: Column) -> Column:
        before = _running(F.transform(pairs, lambda x: (F.length(x["piece"]) + F.length(x["hit"])).cast("long")), lambda a, b: a + b)
        whole = F.zip_with(pairs, before, lambda x, b: F.struct(x["piece"].alias("piece"), x["hit"].alias("hit"), b.alias("before")))
        found = _let(_chunks(text), lambda chunks: F.transform(whole, lambda x: span(chunks, x)))
        return F.filter(found, lambda s: s["score"] >= LEAST)

    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return _let(hits, lambda h: F.when(F.size(h) > 0, spans(h)).otherwise(F.array().cast(_SPAN)))


def _spans(text: Column, kinds: tuple[Kind, ...]) -> Column:
    return F.concat(*[_located(k, n, text) for n, k in enumerate(kinds)])


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = BASE_KINDS + MORE_KINDS, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with spans_col: array of (kind, rank, start, end, score), by kind and start; code points, end exclusive.

    Per kind, matches are leftmost and don't overlap; those that fail their check are
    dropped without another try. Kinds may overlap each other. Null and empty texts have
    no spans. All rows and columns stay; a column named spans_col is replaced. The work
    grows with the length of a text, also where it is full of matches.
    """
    return docs.withColumn(spans_col, _spans(F.coalesce(F.col(text_col), F.lit("")), kinds))


def pii_report(docs: DataFrame, kinds: tuple[Kind, ...] = BASE_KINDS + MORE_KINDS, base: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of the first `base` kinds, the digest of their spans, all spans and their scores."""
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_pii(lean, kinds, spans_col="_spans")
    show = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    basic = F.filter("_spans", lambda s: s["rank"] < base)

    def count(n: int) -> Column:  # a default argument would make the lambda take the index
        return F.size(F.filter("_spans", lambda s: s["rank"] == n)).cast("long")

    counts = [count(n).alias(f"n_{k.name}") for n, k in enumerate(kinds[:base])]
    return found.select("doc_id", *counts, F.sha2(show(basic).cast("binary"), 256).alias("base_sha256"), show(F.col("_spans")).alias("spans"), F.array_join(F.transform("_spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = BASE_KINDS + MORE_KINDS, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """docs with every span replaced by [KIND]; overlapping spans become one, named by the first. Null texts stay null.

    chars_col, if given, gets the new length in code points where a text was changed. All
    other columns stay as they are, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def clean(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return _let(ordered, lambda xs: _let(_running(F.transform(xs, lambda s: s["end"].cast("long")), lambda a, b: F.greatest(a, b)), lambda done: _let(_chunks(text), lambda chunks: joined(xs, done, chunks))))

    def joined(spans: Column, done: Column, chunks: Column) -> Column:
        both = F.zip_with(spans, done, lambda s, d: F.struct(s["start"].alias("start"), d.alias("done"), s["kind"].alias("kind")))
        fresh = F.filter(both, lambda x: x["start"] >= x["done"])
        parts = F.transform(fresh, lambda x: F.concat(_cut(chunks, x["done"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), _cut(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    chars = F.col(chars_col) if chars_col else F.lit(None).cast("int")
    as_was = F.struct(F.col(text_col).alias("text"), chars.alias("chars"))
    anew = lambda t: F.struct(t.alias("text"), F.length(t).cast(docs.schema[chars_col].dataType if chars_col else "int").alias("chars"))
    out = _let(_spans(text, kinds), lambda s: F.when(F.size(s) > 0, _let(clean(s), anew)).otherwise(as_was))
    name = free_name(docs, "_redacted")
    fields = {text_col: F.col(name)["text"]} | ({chars_col: F.col(name)["chars"]} if chars_col else {})
    return docs.withColumn(name, out).select(*[fields[c].alias(c) if c in fields else F.col(f"`{c}`") for c in docs.columns])
