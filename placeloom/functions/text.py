"""Text functions on columns: n-grams, tokens with offsets, span location, normal form of names.

All but ``name_norm`` and ``parts_norm`` are expressions of the JVM. Null input gives null (counts and arrays: empty), unless said otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blocks of Han characters that are a token each.
HAN_BLOCKS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}"
TOKEN_PATTERN = rf"(?U)([{HAN_BLOCKS}]|\w+(?:[-_]\w+)*|\S)"
#: White space of any kind.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
GRAM = 3


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(**fields: Column) -> Column:
    """A struct whose names survive inside higher-order functions, where aliases are dropped."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def spans_of(entities: Column) -> Column:
    """Entities as (text, label, start, end) whatever the order of the input's fields; null gives an empty array."""
    each = F.transform(entities, lambda e: named(text=e["text"], label=e["label"], start=e["start"].cast("bigint"), end=e["end"].cast("bigint")))
    return F.coalesce(each, F.array().cast("array<struct<text:string,label:string,start:bigint,end:bigint>>"))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(col(c), F.lit(BLANKS))


def casefold(c: Column | str) -> Column:
    """Lower case in which also the final sigma is a sigma and the sharp s is two."""
    return F.replace(F.translate(F.lower(col(c)), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def quoted_list(texts: Column) -> Column:
    """Texts in quotes between brackets; an apostrophe inside asks for double quotes, or is escaped if both kinds occur."""
    plain = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    each = lambda t: F.when(t.contains("'") & ~t.contains('"'), F.concat(F.lit('"'), plain(t), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain(t), F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(texts, each), ", "), F.lit("]"))


def char_ngrams(c: Column | str, n: int = GRAM) -> Column:
    """Character n-grams of each lower-case word, repeats kept; a word shorter than n is one gram."""
    words = F.filter(F.split(F.lower(strip(c)), r"[\s\x{85}\p{Z}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.when(F.length(w) < n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, n))))
    return F.coalesce(F.flatten(grams), F.array().cast("array<string>"))


def gram_set(c: Column | str, n: int = GRAM) -> Column:
    """Distinct n-grams over the whole normal form, spaces included; up to n characters are one gram, an empty text none."""
    c = col(c)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, n)))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(F.length(c) <= n, F.array(c)).otherwise(many)


def containment(needle: Column, hay: Column) -> Column:
    """Part of the needle's grams that the hay has; 0 for an empty needle."""
    return F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, hay)) / F.size(needle)).otherwise(F.lit(0.0))


def norm(text: str) -> str:
    """Case folded, dotless i as i, decomposed without marks, everything but letters and digits as single blanks."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKD", text.casefold().replace("ı", "i").replace("İ", "i"))
        text = "".join([c for c in text if not unicodedata.combining(c)])
    return " ".join("".join([c if c.isalnum() else " " for c in text]).split())


@F.pandas_udf(T.StringType())
def _norm(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else norm(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parts_norm(lists: pd.Series) -> pd.Series:
    """The normal form of each text of a list."""
    return lists.map(lambda x: None if x is None else [norm(t) for t in x])


def name_norm(c: Column | str) -> Column:
    """``norm`` of a text. Texts of ASCII alone stay in the JVM; only the others are worked on in Python."""
    c = col(c)
    plain = c.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))).otherwise(_norm(F.when(~plain, c)))


def tokens(c: Column | str) -> Column:
    """Words (with inner hyphens and underscores), single Han characters, and other visible characters."""
    return F.coalesce(F.regexp_extract_all(col(c), F.lit(TOKEN_PATTERN), F.lit(1)), F.array().cast("array<string>"))


def tokens_at(c: Column | str) -> Column:
    """Array of (token, start, end) with code-point offsets, end exclusive: each token is looked up behind the one before."""
    text = col(c)
    zero = named(at=F.lit(0), out=F.array().cast("array<struct<token:string,start:int,end:int>>"))

    def step(acc: Column, token: Column) -> Column:
        start = F.call_function("locate", token, text, acc["at"] + 1) - 1
        end = start + F.length(token)
        return named(at=end, out=F.concat(acc["out"], F.array(named(token=token, start=start, end=end))))

    return F.aggregate(tokens(text), zero, step, lambda acc: acc["out"])


def align_span(toks: Column, start: Column, end: Column) -> Column:
    """Inclusive token positions (first, last) of a character span that falls on token boundaries, else null."""
    first = F.array_position(F.transform(toks, lambda t: t["start"]), start.cast("int")) - 1
    last = F.array_position(F.transform(toks, lambda t: t["end"]), end.cast("int")) - 1
    return F.when((first >= 0) & (last >= first), named(first=first.cast("int"), last=last.cast("int")))


def locate_spans(query: Column, texts: Column) -> Column:
    """Array of (start, end) of the texts in the query, each searched behind the one before, then anywhere; null if one is missing."""
    zero = named(at=F.lit(0), ok=F.lit(True), out=F.array().cast("array<struct<start:int,end:int>>"))

    def step(acc: Column, t: Column) -> Column:
        ahead = F.call_function("locate", t, query, acc["at"] + 1) - 1
        anywhere = F.call_function("locate", t, query, F.lit(1)) - 1
        start = F.when(ahead >= 0, ahead).otherwise(anywhere)
        end = start + F.length(t)
        return named(at=end, ok=acc["ok"] & (start >= 0), out=F.concat(acc["out"], F.array(named(start=start, end=end))))

    return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), zero, step, lambda acc: F.when(acc["ok"], acc["out"]))


def buckets(entities: Column) -> dict[str, Column]:
    """The texts of city, country and region spans, each joined by blanks in order of occurrence; other labels are ignored."""
    # Labels of the three kinds of entity.
    labels = {"city_entities": ["CITY"], "country_entities": ["COUNTRY"], "admin1_entities": ["REGION", "STATE"]}
    spans = spans_of(entities)

    def texts(of: list[str]) -> Column:
        return F.array_join(F.transform(F.filter(spans, lambda e: e["label"].isin(of)), lambda e: e["text"]), " ")

    return {name: texts(of) for name, of in labels.items()}


def query_text(entities: Column) -> Column:
    """All span texts joined by blanks: what is searched for."""
    return F.array_join(F.transform(spans_of(entities), lambda e: e["text"]), " ")


def highlight(text: Column, entities: Column) -> Column:
    """Array of (text, label): the whole text cut at the spans, those between spans with a null label."""
    kind = "array<struct<text:string,label:string>>"
    spans = F.array_sort(F.transform(spans_of(entities), lambda e: named(start=e["start"], end=e["end"], label=e["label"])))
    none = F.lit(None).cast("string")

    def piece(a: Column, b: Column, label: Column) -> Column:
        return F.array(named(text=F.substring(text, a.cast("int") + 1, (b - a).cast("int")), label=label)).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] > acc["at"], piece(acc["at"], s["start"], none)).otherwise(F.array().cast(kind))
        return named(at=s["end"], out=F.concat(acc["out"], before, piece(s["start"], s["end"], s["label"])))

    def end(acc: Column) -> Column:
        n = F.length(text).cast("bigint")
        out = F.concat(acc["out"], F.when(acc["at"] < n, piece(acc["at"], n, none)).otherwise(F.array().cast(kind)))
        return F.when(F.size(out) > 0, out).otherwise(F.array(named(text=text, label=none)).cast(kind))

    return F.aggregate(spans, named(at=F.lit(0).cast("bigint"), out=F.array().cast(kind)), step, end)


def log_population(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("double"))


def country_flag(code: Column) -> Column:
    """The two regional indicator symbols of a two-letter code; anything else gives an empty string."""
    up = F.upper(code)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    signs = "".join(chr(0x1F1E6 + i) for i in range(26))
    return F.when(up.rlike(r"\A[A-Z]{2}\z"), F.translate(up, letters, signs)).otherwise(F.lit(""))
