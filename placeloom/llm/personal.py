"""Personal information in free text: found, and replaced by typed placeholders.

A text is first led through transducers that undo disguises and keep, for each character of the result, the span of
source characters it came from: characters without a shape go, widths, blanks and dashes become plain, digits of other
scripts and runs of spelled digits become 0-9, `(at)`, `[dot]`, `at ... dot` and the like become signs, look-alike letters
become ordinary ones on both sides of an at sign, and digits inside numbers. Detectors work on the result; their spans are
mapped back, so what is reported and replaced is the exact source text. Numbers are looked for around runs of seven and
more digits only, and addresses in texts that have a street word.

Names are recognised by a list of given and family names and by its word formation: beginnings and endings that recur in
the list also make names that the list lacks. A single name is no person; given and family name must stand together. Of
two words of which one is unknown, a title, a label with a colon or a line of their own must tell that they are a person.

Defined cases: null texts give no findings and stay null, empty and blank texts stay as they are; texts of any length are
scanned whole; overlapping findings go to the first of email, id_number, address, phone, person; repeated findings of a
text are reported once; an empty list of names finds persons nowhere.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.lookalike import look_alikes, look_key

KINDS = ("email", "id_number", "address", "phone", "person")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "phone": "[PHONE]", "person": "[PERSON]"}
#: Most names read to the driver from the list of names.
MAX_NAMES = 200_000
#: Names that a beginning or ending must recur in before it makes new names.
RECUR = 2

# ---------------------------------------------------------------- transducers


def _one_to_one() -> dict[int, str]:
    out: dict[int, str] = {}
    for cp in range(0x80, 0x30000):
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat == "Zs":
            out[cp] = " "
        elif cat == "Pd" and cp not in (0x2014, 0x2015):
            out[cp] = "-"
        elif cat == "Nd":
            out[cp] = str(unicodedata.digit(c))
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) and len(n := unicodedata.normalize("NFKC", c)) == 1:
            out[cp] = n
    out[0x2212] = "-"
    out[0xFF1A] = ":"
    return out


_PLAIN = _one_to_one()
#: Of each code point its plain one, and what a text with it needs: 1 a rewrite of characters, 2 a look at marks.
_POINTS = np.arange(0x110000, dtype=np.uint32)
_POINTS[list(_PLAIN)] = [ord(c) for c in _PLAIN.values()]
_NEEDS = (np.arange(0x110000) != _POINTS).astype(np.uint8)
_NEEDS[[cp for cp in range(0x80, 0xE0200) if unicodedata.category(chr(cp)) in ("Cf", "Mn")]] |= 2
_SHAPELESS = regex.compile(r"[\p{Cf}͏︀-️\U000E0100-\U000E01EF]+")
_COMPOSABLE = regex.compile(r"\P{M}\p{Mn}+")
#: What any of the disguises of signs has in it.
_DISGUISED = re.compile(r"[\[({<][ ]?(?:at|ат|собака|et|@|dot|точка|nokta|点|點|\.)[ ]?[\])}>]| (?:@|at|собака) ", re.I)
_LABEL = r"[A-Za-z0-9_](?:[A-Za-z0-9_+%\-]*[A-Za-z0-9_])?"
_SPOKEN = re.compile(rf"(?<![\w.@]){_LABEL}(?:(?: dot |\.){_LABEL})* at {_LABEL}(?:(?: dot |\.){_LABEL})* dot [A-Za-z]{{2,24}}(?![\w@])", re.I)
_SPOKEN_SIGN = re.compile(r" (at|dot) ", re.I)
#: Letters that look like some of an address.
_TWINS = {ord(a): b for (a, script), b in look_alikes().items() if script == "Latin" and b.isascii() and not a.isascii()}
_TWIN_LETTERS = "".join(map(chr, sorted(_TWINS)))
_TWIN = re.compile(f"[{_TWIN_LETTERS}]")
_SIDE = rf"[A-Za-z0-9._%+\-{_TWIN_LETTERS}]*"
_AT = re.compile(f"({_SIDE})@({_SIDE})")
_BETWEEN = rf"(?<=[A-Za-z0-9{_TWIN_LETTERS}]) %s (?=[A-Za-z0-9{_TWIN_LETTERS}-]+\.[A-Za-z{_TWIN_LETTERS}])"
_SIGNS = (
    (re.compile(r"[ ]?[\[({<][ ]?(?:at|ат|собака|et|@)[ ]?[\])}>][ ]?", re.I), "@"),
    (re.compile(r"[ ]?[\[({<][ ]?(?:dot|точка|nokta|点|點|\.)[ ]?[\])}>][ ]?", re.I), "."),
    (re.compile(_BETWEEN % "@"), "@"),
    (re.compile(_BETWEEN % "(?:at|собака)", re.I), "@"),
)
# Letters that look like digits.
_DIGIT_TWINS = {"O": "0", "o": "0", "О": "0", "о": "0", "Ο": "0", "ο": "0", "l": "1", "I": "1", "І": "1", "З": "3"}
_TWIN_DIGITS = "".join(_DIGIT_TWINS)
_DIGIT_NEAR = re.compile(rf"\d(?=[{_TWIN_DIGITS}])|(?<=[{_TWIN_DIGITS}])\d")
_DIGIT_RUN = re.compile(rf"(?<![^\W\d_])[\d{_TWIN_DIGITS}](?:[ .\-()]{{0,2}}[\d{_TWIN_DIGITS}])+(?![^\W\d_])")
# Digits in words.
_DIGIT_WORDS = {
    w: str(i)
    for row in (
        "zero one two three four five six seven eight nine",
        "ноль один два три четыре пять шесть семь восемь девять",
        "sıfır bir iki üç dört beş altı yedi sekiz dokuz",
    )
    for i, w in enumerate(row.split())
}
_HAN_DIGITS = {c: str(i) for i, c in enumerate("〇一二三四五六七八九")} | {"零": "0"}
_SPELLED = re.compile(r"(?<![^\W\d_])(?:%s)(?:[ -](?:%s)){6,}(?![^\W\d_])" % (("|".join(_DIGIT_WORDS),) * 2), re.I)
_SPELLED_SIGN = re.compile("[ -](?:%s)[ -](?:%s)[ -](?:%s)" % (("|".join(_DIGIT_WORDS),) * 3))
_SPELLED_WORD = re.compile("|".join(_DIGIT_WORDS), re.I)
_SPELLED_HAN = re.compile("[%s]{7,}" % "".join(_HAN_DIGITS))


class Tape:
    """A rewritten text and the source span of each of its characters; while nothing moved, spans are the positions."""

    def __init__(self, source: str):
        self.source, self.text, self.marked = source, source, False
        if not source.isascii():
            points = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
            needs = np.bitwise_or.reduce(_NEEDS[points])
            self.marked = bool(needs & 2)
            if needs & 1:
                self.text = _POINTS[points].tobytes().decode("utf-32-le", "surrogatepass")
        self.start: list[int] | None = None
        self.end: list[int] | None = None

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Each (from, to, new text), in order and apart; a new character stands for the whole replaced span."""
        if not edits:
            return
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a] + new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.start, self.end = start + self.start[at:], end + self.end[at:]
        self.text = "".join(text)

    def rewrite(self, pattern, new: str) -> None:
        self.replace([(m.start(), m.end(), new) for m in pattern.finditer(self.text)])

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def _signs(tape: Tape) -> None:
    """Words and brackets that stand for the signs of an address."""
    if not _DISGUISED.search(tape.text):
        return
    edits = []
    for m in _SPOKEN.finditer(tape.text):
        edits += [(x.start(), x.end(), "@" if x.group(1).lower() == "at" else ".") for x in _SPOKEN_SIGN.finditer(tape.text, m.start(), m.end())]
    tape.replace(edits)
    for pattern, sign in _SIGNS:
        tape.rewrite(pattern, sign)


def _letters_of_addresses(tape: Tape) -> None:
    """Look-alike letters on either side of an at sign, where the side is an ordinary one but for them. One for one, so no span moves."""
    text = tape.text
    if "@" not in text or not _TWIN.search(text):
        return
    out, done = [], 0

    def goes_on(i: int) -> bool:
        """Whether a letter stands at i, other than of a writing without gaps between words."""
        return 0 <= i < len(text) and text[i].isalpha() and ord(text[i]) < 0x2E80

    for m in _AT.finditer(text):
        for g, beyond in ((1, m.start() - 1), (2, m.end())):
            if not m.group(g).isascii() and not goes_on(beyond):
                out += [text[done : m.start(g)], m.group(g).translate(_TWINS)]
                done = m.end(g)
    tape.text = "".join([*out, text[done:]])


def _letters_of_numbers(tape: Tape) -> None:
    """Letters that look like digits inside a number of seven and more, most of it true digits. One for one as well."""
    if not _DIGIT_NEAR.search(tape.text):
        return

    def plain(m: re.Match) -> str:
        run = m.group()
        digits = sum(c.isdigit() for c in run)
        letters = sum(c in _DIGIT_TWINS for c in run)
        return run.translate(_DIGIT_TABLE) if letters and digits >= 5 and digits + letters >= 7 and digits > 2 * letters else run

    tape.text = _DIGIT_RUN.sub(plain, tape.text)


_DIGIT_TABLE = str.maketrans(_DIGIT_TWINS)


def undisguised(source: str) -> Tape:
    tape = Tape(source)
    if not source.isascii():
        if tape.marked:
            tape.rewrite(_SHAPELESS, "")
            tape.replace([(m.start(), m.end(), n) for m in _COMPOSABLE.finditer(tape.text) if len(n := unicodedata.normalize("NFC", m.group())) == 1])
        if _SPELLED_HAN.search(tape.text):
            tape.replace([(i, i + 1, _HAN_DIGITS[tape.text[i]]) for m in _SPELLED_HAN.finditer(tape.text) for i in range(m.start(), m.end())])
    if _SPELLED_SIGN.search(tape.text.lower()):
        edits = []
        for m in _SPELLED.finditer(tape.text):
            words = list(_SPELLED_WORD.finditer(tape.text, m.start(), m.end()))
            for w, nxt in zip(words, [*words[1:], None]):
                edits.append((w.start(), nxt.start() if nxt else w.end(), _DIGIT_WORDS[w.group().lower()]))
        tape.replace(edits)
    _signs(tape)
    _letters_of_addresses(tape)
    _letters_of_numbers(tape)
    return tape


# ---------------------------------------------------------------- patterns on undisguised text

_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9@])")

# Words that announce a person's number in any wording, and shapes of such numbers.
_ID_LABEL = (
    r"(?:passport|personal (?:no|number)|id(?:entity|entification)?(?: card)?|document|ssn|social security|tax|паспорт\w*|личн\w+ номер\w*|документ\w*|удостоверени\w+|снилс|инн|pasaport\w*|belge\w*|kimlik\w*|tckn?)"
    r"(?:\.?[ ][^\W\d_]+){0,2}\.?|(?:身份[證证]|[證证]件|[護护]照|[證证][號号])(?:[號号]?[碼码]?)(?:是|为|為)?"
)
_ID_VALUE = r"\d{6} ?\d{8} ?\d{3}[\dXx]|\d{3}-\d{3}-\d{3}[ -]\d{2}|\d{3}([ -])\d{2}\1\d{4}|\d{2} ?\d{2} ?(?:№ ?)?\d{6}|\d{3} \d{3} \d{3} \d{2}|\d{3}-\d{3}-\d{3}-\d{2}|\d{11}|\d{9}"
_ID_AFTER = r"(?=[^\d.!?;\n。！？；]{0,20}?(?<![^\W\d_])(?:kimlik|passport|identity|паспорт|身份[證证]|[證证]件))"
_EDGE, _END = r"(?<![\dA-Za-z])(?<!\d[.,/:\-])", r"(?![\dA-Za-z])(?![.\-/]\d)"
_ID = re.compile(
    rf"(?<![A-Za-zÀ-ɏЀ-ӿ])(?:{_ID_LABEL})\W{{0,3}}(?P<a>{_ID_VALUE}){_END}".replace(r"([ -])\d{2}\1", r"(?P<s1>[ -])\d{2}(?P=s1)")
    + rf"|{_EDGE}(?<![+(])(?P<b>{_ID_VALUE}){_END}{_ID_AFTER}".replace(r"([ -])\d{2}\1", r"(?P<s2>[ -])\d{2}(?P=s2)")
    + rf"|{_EDGE}(?P<c>\d{{17}}[\dXx]|\d{{6}} \d{{8}} \d{{3}}[\dXx]|\d{{3}}-\d{{3}}-\d{{3}} \d{{2}}|\d{{3}}-\d{{2}}-\d{{4}}|\d{{2}} ?\d{{2}} № ?\d{{6}})" + _END,
    re.I,
)
#: Seven and more digits with the signs that stand inside numbers. Numbers of persons and phones are looked for around these only.
_CLUSTER = re.compile(r"\d(?:[ .\-/()№]{0,3}\d){6,}")
_DAY = re.compile(r"\d{4}[.\-/]\d\d[.\-/]\d\d|\d\d[.\-/]\d\d[.\-/]\d{4}")
#: Signs before and after a number that may hold its label.
_BEFORE, _AFTER = 64, 40

_TEN = r"(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{2}[ .\-]?\d{2}"
_CALL = r"(?:call|ring|mobile|tel|phone|звоните|наберите|тел|телефон|cep|電話|电话|請撥|请拨|就打|手機|手机)"
_PHONE = re.compile(
    rf"{_EDGE}(?:(?:\+|00)(?:1|7|90)[ .\-]?{_TEN}"
    r"|(?:\+|00)86[ .\-]?(?:1\d{2}|\(?0?\d{2,3}\)?)[ .\-]?\d{4}[ .\-]?\d{4}"
    r"|\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,3}[ .\-]?\d{2,4}"
    rf"|[80][ \-]?{_TEN}"
    r"|(?:1[ .\-])?(?:\(\d{3}\)[ ]?|\d{3}[.\-])\d{3}[.\- ]\d{4}"
    r"|0\d{2,3}[ \-]\d{4}[ \-]?\d{4}"
    rf"|1\d{{10}}|1\d{{2}}[ \-]\d{{4}}[ \-]\d{{4}}){_END}"
)
#: A word that says that a number is called ends right before it.
_CALLED = re.compile(rf"{_CALL}(?: (?:me|us|him|her))?(?: (?:at|on))?\.?:? ?$", re.I)
_CALLED_NUMBER = re.compile(rf"\+?\(?\d(?:[ .\-]?[()]?[ ]?\d){{6,14}}{_END}")

_WORD = r"\p{Lu}[\p{L}\p{M}]*(?:[-'’][\p{L}\p{M}]+)*"
#: (a street word, the address): texts without the first are spared the second.
_ADDRESS = (
    # number, name, street word
    (
        re.compile(r" (?:Street|Road|Lane|Square|Avenue|Boulevard|Drive|Court|Terrace|Place|Way|Ave|St|Rd|Ln|Sq|Blvd|Dr|Ct)\b"),
        regex.compile(rf"(?<![\w.,/:\-])\d{{1,4}}[A-Za-z]?(?:/\d+)? (?:{_WORD} )+?(?:(?:Street|Road|Lane|Square|Avenue|Boulevard|Drive|Court|Terrace|Place|Way)\b|(?:Ave|St|Rd|Ln|Sq|Blvd|Dr|Ct)\b\.?)"),
    ),
    # name, street word, number; a bare number before a word in lower case counts something, unless the word says where
    (
        re.compile(r" (?:Cad|Sok|Sk|Bul|Blv|Mah)"),
        regex.compile(rf"(?<![\w-])(?:{_WORD}) (?:Caddesi|Cad\.?|Sokağı|Sokak|Sk\.?|Sok\.?|Bulvarı|Blv\.?|Bulv\.?|Mahallesi|Mah\.?)(?:,)? (?:[Nn][Oo](?:[:.] ?| ))?\d{{1,4}}(?:/?[A-Za-z])?(?:/\d+)?(?![\w])(?! ?\p{{Ll}}+l[iıuü]\b)"),
    ),
    # street word and name in either order, number with its word
    (
        re.compile(r"ул\.|улица|пер\.|переулок|пр-т|проспект|пр\.|пл\.|площадь|наб\.|набережная|ш\.|шоссе|бульвар|б-р"),
        regex.compile(rf"(?<![\w-])(?:(?:ул\.|улица|пер\.|переулок|пр-т\.?|проспект|пр\.|пл\.|площадь|наб\.|набережная|ш\.|шоссе|бульвар|б-р) ?{_WORD}(?: {_WORD})*|{_WORD} (?:улица|переулок|проспект|площадь|набережная|шоссе|бульвар))(?:,)? (?:д\. ?|дом )?\d{{1,4}}(?:/\d+)?(?:[ ]?(?:корп\.|к\.|стр\.) ?\d+)?[а-яА-Я]?(?![\w])"),
    ),
)
# Han: the street word and the number with its sign; the name goes back from there as far as the writing has no break
_HAN_STREET = regex.compile(r"(?:大道|街|路|巷|道|弄)(?:\p{Han}段)?\d{1,4}[A-Za-z]?(?:[-之]\d+)?[號号]")
_HAN_NAME = regex.compile(r"(?r)(?:\p{Han}|(?<=\p{Han})\d{1,3}(?=\p{Han}))+")
_HAN_LEAD = re.compile(r".*(?:住在|寄到|送到|地址是|位於|就在|在)")

# Titles and other general signs that a person follows, for persons of whom one name is unknown.
_CUE = regex.compile(r"(?:\b(?:Mrs?|Ms|Miss|Dr|Prof)\.? |\bSigned,? ?\n? ?|\bby |\bask for |Г-н |Г-жа |[Дд]октор |\bэто |Sayın |\p{L}: ?)$", regex.I)
_HAN_CUE = "[由是找叫]|(?<![\\p{Han}])"
# What a place is called by, when a name of the list stands before it.
_HAN_FEATURE = "[灣湾山河湖海江島岛廟庙村鎮镇縣县市路街橋桥站港]"
_NAME_WORD = regex.compile(r"\p{Lu}[\p{L}\p{M}]+(?:[-'’]\p{L}[\p{L}\p{M}]+)*")
_GAP = regex.compile(r" (?:\p{Lu}\p{M}*\. ?){0,2}|, ")


# ---------------------------------------------------------------- names


def fold_name(word: str) -> str:
    """One form for a name in any case and in look-alike letters."""
    w = word.capitalize() if word.isupper() else word
    return look_key(w).lower().replace("ı", "i").replace("̇", "")


class NameBook:
    """Given and family names of a list and of its word formation."""

    def __init__(self, rows: list[tuple[str | None, str | None, str | None]]):
        self.kinds: dict[str, set[str]] = defaultdict(set)
        self.formed: dict[str, list[tuple[set[str], set[str]]]] = {"given": [], "family": []}
        han: dict[str, set[str]] = {"given": set(), "family": set()}
        groups: dict[tuple[str, str], set[str]] = defaultdict(set)
        for lang, kind, name in rows:
            if not name or kind not in ("given", "family"):
                continue
            name = unicodedata.normalize("NFC", name.strip())
            if regex.search(r"\p{Han}", name):
                han[kind].add(name)
            else:
                groups[lang or "", kind].add(fold_name(name))
                self.kinds[fold_name(name)].add(kind)
        for (_, kind), names in groups.items():
            self.formed[kind].append(self._parts(names))
        self.cache: dict[str, frozenset[str]] = {}
        self.han = self._han(han) if han["given"] else None

    @staticmethod
    def _parts(names: set[str]) -> tuple[set[str], set[str]]:
        head, tail = Counter(), Counter()
        for n in names:
            for i in range(2, len(n) - 1):
                head[n[:i]] += 1
                tail[n[i:]] += 1
        heads, tails = Counter(), Counter()
        for n in names:
            cuts = [(head[n[:i]] * tail[n[i:]], i) for i in range(2, len(n) - 1) if head[n[:i]] > 1 and tail[n[i:]] > 1]
            if cuts:
                i = max(cuts)[1]
                heads[n[:i]] += 1
                tails[n[i:]] += 1
        return {h for h, c in heads.items() if c >= RECUR}, {t for t, c in tails.items() if c >= RECUR}

    @staticmethod
    def _han(han: dict[str, set[str]]):
        two = [g for g in han["given"] if len(g) == 2]
        first, second = Counter(g[0] for g in two), Counter(g[1] for g in two)
        firsts, seconds = "".join(c for c, n in first.items() if n >= RECUR), "".join(c for c, n in second.items() if n >= RECUR)
        given = "|".join(sorted(map(re.escape, han["given"]), key=lambda g: (-len(g), g)))
        if firsts and seconds:
            given += f"|[{firsts}][{seconds}]"
        family = "|".join(sorted(map(re.escape, han["family"]), key=lambda g: (-len(g), g))) or r"(?!)"
        # a family name of the list speaks for itself; an unknown one needs a cue or a boundary, and no feature named after the given name
        return regex.compile(rf"(?:{family})(?:{given})|(?<={_HAN_CUE})\p{{Han}}(?:{given})(?!{_HAN_FEATURE})")

    def of(self, word: str) -> frozenset[str]:
        got = self.cache.get(word)
        if got is None:
            got = self._of(word)
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def _of(self, word: str) -> frozenset[str]:
        parts = [p for p in re.split(r"[-'’]", word) if p]
        if len(parts) > 1:
            each = [self.of(p) for p in parts]
            return frozenset.intersection(*each) if all(each) else frozenset()
        w = fold_name(word)
        out = set(self.kinds.get(w, ()))
        for kind, sets in self.formed.items():
            if kind not in out and any(w[:i] in heads and w[i:] in tails for heads, tails in sets for i in range(2, len(w) - 1)):
                out.add(kind)
        return frozenset(out)

    def persons(self, text: str) -> Iterator[tuple[int, int]]:
        words = list(_NAME_WORD.finditer(text))
        kinds = [self.of(m.group()) for m in words]
        upto = 0
        for i in range(len(words) - 1):
            a, b = kinds[i], kinds[i + 1]
            if i < upto or not (a or b):
                continue
            gap = _GAP.fullmatch(text, words[i].end(), words[i + 1].start())
            if not gap:
                continue
            if a and b:
                comma = gap.group().startswith(",")
                ok = ("family" in a and "given" in b) if comma else (("given" in a and "family" in b) or ("family" in a and "given" in b))
            else:
                ok = self._announced(text, words[i].start(), words[i + 1].end())
            if ok:
                yield words[i].start(), words[i + 1].end()
                upto = i + 2
        if self.han is not None:
            for m in self.han.finditer(text):
                yield m.span()

    @staticmethod
    def _announced(text: str, a: int, b: int) -> bool:
        """Whether a cue stands before, or the two words have a line of their own."""
        if _CUE.search(text, max(0, a - 40), a):
            return True
        while a > 0 and text[a - 1] in " \t\r":
            a -= 1
        while b < len(text) and text[b] in " \t\r":
            b += 1
        breaks = text[a - 1 : a], text[b : b + 1]
        return "\n" in breaks and all(x in ("", "\n") for x in breaks)


# ---------------------------------------------------------------- detection


_DIGIT = re.compile("[0-9]")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def detect(source: str, book: NameBook) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the source text, in order and apart."""
    if not source or source.isspace():
        return []
    tape = undisguised(source)
    text = tape.text
    taken: list[tuple[int, int, str]] = []
    starts: list[int] = []

    def add(a: int, b: int, kind: str) -> None:
        i = bisect_right(starts, a)
        if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
            return
        starts.insert(i, a)
        taken.insert(i, (a, b, kind))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(*m.span(), "email")
    if _DIGIT.search(text):
        every = list(_CLUSTER.finditer(text))
        # each with the stretch that is searched around it, which ends before the next one
        stops = [m.start() for m in every[1:]] + [len(text)]
        clusters = [(m.start(), min(m.end() + _AFTER, stop), _digits(m.group())) for m, stop in zip(every, stops) if not _DAY.fullmatch(m.group())]
        for a, b, n in clusters:
            if n >= 9:
                for m in _ID.finditer(text, max(0, a - _BEFORE), b):
                    g = next(k for k in "abc" if m.group(k) is not None)
                    add(*m.span(g), "id_number")
        for word, pattern in _ADDRESS:
            if word.search(text):
                for m in pattern.finditer(text):
                    add(*m.span(), "address")
        if "號" in text or "号" in text:
            done = 0
            for m in _HAN_STREET.finditer(text):
                name = _HAN_NAME.match(text, done, m.start())
                if name:
                    lead = _HAN_LEAD.match(text, name.start(), m.start())
                    add(lead.end() if lead else name.start(), m.end(), "address")
                done = m.end()
        for a, b, n in clusters:
            while a and text[a - 1] in "+(":
                a -= 1
            m = _CALLED_NUMBER.match(text, a, b) if _CALLED.search(text, max(0, a - _BEFORE), a) else None
            if m and _digits(m.group()) <= 16:
                add(*m.span(), "phone")
            if n > 9 or text[a] == "+":
                for m in _PHONE.finditer(text, m.end() if m else a, b):
                    if 7 <= _digits(m.group()) <= 16:
                        add(*m.span(), "phone")
    for a, b in book.persons(text):
        add(a, b, "person")
    return [(*tape.span(a, b), kind) for a, b, kind in taken]


def redact(source: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [source[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, source[at:]])


def name_rows(names: DataFrame) -> list[tuple[str | None, str | None, str | None]]:
    """The list of names, of at most MAX_NAMES rows; more are an error, not a sample."""
    rows = [tuple(r) for r in names.select("lang", "name_kind", "name").distinct().limit(MAX_NAMES + 1).collect()]
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    return sorted(rows, key=str)


def personal_information(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, found (array of kind, found, start, length in code points) and redacted. One narrow stage over whole texts."""
    rows = name_rows(names)
    kind = docs.schema[key].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = NameBook(rows)
        for b in batches:
            found, redacted = [], []
            for t in b.column(1).to_pylist():
                spans = detect(t, book) if t else []
                found.append([{"kind": k, "found": t[s:e], "start": s, "length": e - s} for s, e, k in spans])
                redacted.append(redact(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, found_type), pa.array(redacted, pa.string())], [key, "found", "redacted"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, found array<struct<kind string, found string, start int, length int>>, redacted string")


def findings(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct key, kind, found."""
    per = personal_information(docs, names, key, text)
    # repeated findings of one text are dropped inside its row, so no exchange is needed
    return per.select(key, F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["found"].alias("found"))))).alias("f")).select(key, "f.kind", "f.found")
