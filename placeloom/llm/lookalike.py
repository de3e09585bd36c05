"""One consistent form for names that look the same but differ in characters.

1. Plain form (per text): characters without a shape go, widths and compatibility variants become the ordinary
   character, accents are composed, the kinds of one hyphen and of blanks become one, runs of blanks become one. Texts of
   visible ASCII characters stay in the JVM.
2. Script repair (per token): a token that mixes scripts is rewritten in one of its scripts, tried in order of dominance,
   if every foreign letter has a look-alike there and the result is a word of the corpus: a token of one script that
   occurs in some name. The result is the column ``form``.
3. Key of what no vocabulary settles: tokens that stay mixed, and tokens of one script wholly made of look-alikes, which
   have no visible script, are written in prototypes. The column ``look`` is the form but for these tokens.

Look-alikes are letters of different scripts and one case. A short list is fixed here; ``public_table`` adds those of the
public confusables data, which the JVM's Unicode library holds.

Letters, accents, case, hyphens and gaps between words stay; `i` and `ı`, `е` and `ё` stay different.

Defined cases: null, empty and blank names have no form and no key; repeated names get equal forms; a text of any length
is handled whole; tables with further columns are read by name only.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.runtime import cut

# Letters of one look in Latin, Cyrillic and Greek (a dot where a script has none); accents are apart.
LOOKALIKES = """
A А Α, B В Β, C С ., E Е Ε, H Н Η, I І Ι, J Ј ., K К Κ, M М Μ, N . Ν, O О Ο, P Р Ρ, Q Ԛ ., S Ѕ ., T Т Τ, X Х Χ, Y У Υ, Z . Ζ,
a а ., c с ϲ, d ԁ ., e е ., h һ ., i і ., j ј ϳ, l ӏ ., o о ο, p р ., q ԛ ., s ѕ ., v ѵ ., w ԝ ., x х ., y у .
"""
#: Scripts by their names in the JVM's and the regex module's expressions; the first is that of the prototypes.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic")
# The scripts' everyday letters, which alone are written in place of others; and letters that the public data
# holds for look-alikes though a reader tells them apart: i without its dot, r with an open arm, o with a flag.
EVERYDAY = {"Latin": "A-Za-z", "Cyrillic": "\u0400-\u045f", "Greek": "\u0386-\u03ce", "Armenian": "\u0531-\u0587", "Cherokee": "\u13a0-\u13f5", "Coptic": "\u2c80-\u2cb1"}
UNLIKE = "ιɩгⲅσ"
#: Characters without a shape besides those of category Cf.
SHAPELESS = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
BLANKS = "".join(chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
HYPHENS = "‐‑﹣－"
WORD_JVM = r"[\p{L}\p{M}]+"


@lru_cache(1)
def _plain_table() -> dict[int, str]:
    """Code point -> plain characters, of those that aren't plain."""
    plain: dict[int, str] = {}
    for cp in (*range(0x80, 0x30000), *range(0xE0000, 0xE01F0)):
        c = chr(cp)
        if unicodedata.category(c) == "Cf" or c in SHAPELESS or cp >= 0xE0100:
            plain[cp] = ""
        elif c in BLANKS:
            plain[cp] = " "
        elif c in HYPHENS:
            plain[cp] = "-"
        elif (d := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>", "<compat>", "<font>")):
            n = unicodedata.normalize("NFKC", c)
            if not n.startswith(" "):
                plain[cp] = n
    for cp in range(0x20):
        plain[cp] = " " if chr(cp) in BLANKS else ""
    plain[0x7F] = ""
    return plain


#: (letter, script) -> the letter of that script that looks the same.
LookTable = dict[tuple[str, str], str]


@lru_cache(1)
def look_alikes() -> LookTable:
    """The fixed list."""
    swap: LookTable = {}
    for row in (x.split() for x in LOOKALIKES.split(",")):
        for a in row:
            for b, s in zip(row, SCRIPTS):
                if a != "." and b != "." and a != b:
                    swap[a, s] = b
    return swap


@lru_cache(100_000)
def _script(letter: str) -> str:
    for s in SCRIPTS:
        if regex.match(rf"\p{{Script={s}}}", letter):
            return s
    return ""


def public_table(spark: SparkSession) -> LookTable:
    """The fixed list and the public confusables of the scripts' letters: one skeleton, one case, different scripts.

    Of several letters of a script the skeleton itself stands for all, else the first. Some thousand letters, in one call.
    """
    letters = [c for c in map(chr, range(0x41, 0x1E000)) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c) and c not in UNLIKE and _script(c)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(letters)).split("\n")
    if len(skeletons) != len(letters):
        raise RuntimeError("the library's skeletons don't match the letters")
    groups: dict[tuple[str, str], dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for c, k in zip(letters, skeletons):
        groups[k, unicodedata.category(c)][_script(c)].append(c)
    swap = {}
    for (skeleton, _), of in groups.items():
        common = {s: [c for c in cs if regex.match(f"[{EVERYDAY[s]}]", c)] for s, cs in of.items()}
        best = {s: skeleton if skeleton in cs else cs[0] for s, cs in common.items() if cs}
        swap |= {(c, s): b for own, cs in of.items() for c in cs for s, b in best.items() if s != own}
    return swap | look_alikes()


def prototypes(swap: LookTable) -> dict[str, str]:
    """Letter -> its look-alike in the first of the scripts that has one before its own."""
    out: dict[str, str] = {}
    for s in reversed(SCRIPTS):
        out |= {c: b for (c, script), b in swap.items() if script == s and SCRIPTS.index(s) < SCRIPTS.index(_script(c))}
    return out


def plain_form(text: str) -> str:
    """Step 1 on one text."""
    if not text.isascii() or any(c < " " or c == "\x7f" for c in text):
        text = unicodedata.normalize("NFC", text).translate(_plain_table())
        text = unicodedata.normalize("NFC", text)
    return " ".join(text.split(" ")) if "  " not in text and text[:1] != " " and text[-1:] != " " else " ".join(text.split())


def rewritings(token: str, swap: LookTable | None = None) -> list[str]:
    """Step 2's candidates: the token in one script, the most frequent of its scripts first; empty if it isn't mixed."""
    swap = look_alikes() if swap is None else swap
    letters = unicodedata.normalize("NFD", token)
    of = [_script(c) for c in letters]
    present = sorted({s for s in of if s}, key=lambda s: (-of.count(s), of.index(s)))
    if len(present) < 2:
        return []
    out = []
    for target in present:
        new = [c if s in ("", target) else swap.get((c, target)) for c, s in zip(letters, of)]
        if None not in new:
            out.append(unicodedata.normalize("NFC", "".join(new)))
    return out


def look_key(form: str, proto: dict[str, str] | None = None) -> str:
    """Every look-alike letter of a text by its prototype."""
    if form.isascii():
        return form
    proto = prototypes(look_alikes()) if proto is None else proto
    return "".join([proto.get(c, c) for c in unicodedata.normalize("NFD", form)])


_TOKEN = regex.compile(r"[\p{L}\p{M}]+")


def unsettled_key(form: str, proto: dict[str, str]) -> str:
    """Step 3 on one form: tokens that are mixed, or wholly made of look-alikes, in prototypes."""

    def token(m: regex.Match) -> str:
        letters = unicodedata.normalize("NFD", m.group())
        scripts = {s for c in letters if (s := _script(c))}
        if len(scripts) > 1 or all(c in proto or unicodedata.combining(c) for c in letters):
            return unicodedata.normalize("NFC", "".join([proto.get(c, c) for c in letters]))
        return m.group()

    return _TOKEN.sub(token, form)


@F.pandas_udf(T.StringType())
def _plain(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else plain_form(t))


def _plain_column(c: Column) -> Column:
    """Visible ASCII needs no more than its blanks trimmed; other texts go to Python."""
    simple = c.rlike(r"\A[ -~]*\z")
    return F.when(simple, F.trim(F.regexp_replace(c, " +", " "))).otherwise(_plain(F.when(~simple, c)))


#: Two neighbouring letters of different scripts.
MIXED_JVM = "|".join(rf"\p{{Is{s}}}\p{{M}}*[{''.join(rf'\p{{Is{o}}}' for o in SCRIPTS if o != s)}]" for s in SCRIPTS)


def _foreign(c: Column) -> Column:
    """Whether a text has more than ASCII; asked before anything else, as most texts haven't."""
    return ~c.rlike(r"\A\p{ASCII}*\z")


def _mixed(c: Column) -> Column:
    """Whether a token mixes scripts."""
    return _foreign(c) & c.rlike(MIXED_JVM)


def consistent_names(names: DataFrame, text: str = "name", swap: LookTable | None = None) -> DataFrame:
    """The input's columns with ``form`` (steps 1 and 2) and ``look`` (step 3), both null where nothing can be seen.

    Only texts with a mixed token are joined to repairs; the vocabulary is every text's tokens, met by the candidates.
    """
    swap = public_table(names.sparkSession) if swap is None else swap
    proto = prototypes(swap)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def rewritten(x: pd.Series) -> pd.Series:
        return x.map(lambda t: rewritings(t, swap))

    @F.pandas_udf(T.StringType())
    def keyed(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unsettled_key(t, proto))

    own = names.columns
    base = names.withColumn("__plain", _plain_column(F.col(text)))
    base = cut(base.withColumn("__plain", F.when(F.col("__plain") != "", F.col("__plain"))).withColumn("__mixed", F.coalesce(_mixed(F.col("__plain")), F.lit(False))))
    tokens = F.explode(F.regexp_extract_all("__plain", F.lit(f"({WORD_JVM})"), F.lit(1))).alias("token")
    mixed = base.filter("__mixed")
    tried = mixed.select(tokens).filter(_mixed(F.col("token"))).distinct().select("token", F.posexplode(rewritten("token")).alias("pos", "clean"))
    tried = cut(tried)
    known = base.select(tokens).withColumnRenamed("token", "clean").join(tried.select("clean").distinct(), "clean", "left_semi").distinct()
    repairs = tried.join(known, "clean", "left_semi").groupBy("token").agg(F.min_by("clean", "pos").alias("clean"))
    texts = mixed.select("__plain").distinct()
    pieces = texts.select("__plain", F.posexplode(F.regexp_extract_all("__plain", F.lit(rf"({WORD_JVM}|[^\p{{L}}\p{{M}}]+)"), F.lit(1))).alias("pos", "token"))
    fixed = pieces.join(repairs, "token", "left").groupBy("__plain").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("clean", "token").alias("t")))).alias("parts"))
    fixed = fixed.select(F.col("__plain").alias("__of"), F.array_join(F.col("parts.t"), "").alias("form"))
    full = base.filter("not __mixed").select(*own, F.col("__plain").alias("form")).unionByName(mixed.join(fixed, F.col("__plain") == F.col("__of")).select(*own, "form"))
    # only texts with a token that is mixed or wholly of foreign look-alikes can have another key
    open_ = _foreign(F.col("form")) & F.col("form").rlike(rf"(?<![\p{{L}}\p{{M}}])[{_composed(proto)}\p{{M}}]+(?![\p{{L}}\p{{M}}])|{MIXED_JVM}")
    return full.select(*own, "form", F.when(open_, keyed(F.when(open_, F.col("form")))).otherwise(F.col("form")).alias("look"))


def _composed(proto: dict[str, str]) -> str:
    """The look-alike letters and their composed forms with accents."""
    out = set(proto)
    for cp in range(0xC0, 0x2000):
        letters = unicodedata.normalize("NFD", chr(cp))
        if len(letters) > 1 and letters[0] in proto:
            out.add(chr(cp))
    return "".join(sorted(out))


def place_names(geonames: DataFrame, alternates: DataFrame) -> DataFrame:
    """Distinct geonameid, name_id, name: the places' names under id 0 and their spellings; web addresses aren't names."""
    own = geonames.select("geonameid", F.lit(0).cast("bigint").alias("name_id"), "name")
    other = alternates.filter("coalesce(isolanguage, '') <> 'link'").select("geonameid", F.col("alternate_name_id").alias("name_id"), F.col("alternate_name").alias("name"))
    return own.unionByName(other).filter("geonameid is not null and name_id is not null and name is not null").distinct()


def same_looking(named: DataFrame) -> DataFrame:
    """Pairs of ids of one place's names of one look and different code points, the smaller id first."""
    rows = cut(named.filter("look is not null").select("geonameid", "look", "name_id", "name"))  # read three times
    several = rows.groupBy("geonameid", "look").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo <> hi").select("geonameid", "look")
    hits = rows.join(several, ["geonameid", "look"], "left_semi")
    a, b = hits.select("geonameid", "look", F.col("name_id").alias("name_id_a"), F.col("name").alias("na")), hits.select("geonameid", "look", F.col("name_id").alias("name_id_b"), F.col("name").alias("nb"))
    return a.join(b, ["geonameid", "look"]).filter("name_id_a < name_id_b and na <> nb").select("geonameid", "name_id_a", "name_id_b").distinct()


def look_classes(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): names of one place that look the same, as geonameid, look, names and spellings of the class, and as one row for each name.

    The form to use where pairs would be too many: a class of n names is n rows instead of n squared.
    """
    members = named.filter("look is not null").select("geonameid", "look", "name_id", "name")
    classes = members.groupBy("geonameid", "look").agg(F.count(F.lit(1)).alias("names"), F.count_distinct("name").alias("spellings"))
    return classes, members


def repair_report(named: DataFrame, text: str = "name") -> DataFrame:
    """How many names each step changed: as it was, in plain form only or repaired, or with a token that only the key settles."""
    step = F.when(F.col("form").isNull(), "blank").when(F.col("look") != F.col("form"), "keyed").when(F.col("form") != F.col(text), "rewritten").otherwise("kept")
    return named.select(step.alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("names"))
