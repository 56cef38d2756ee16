"""One consistent form for text that looks the same but differs in its characters.

A token's script is the intersection of the script sets of its letters. Where it is empty, the token
mixes scripts; where it is one script while the text is written in another and each letter has a
look-alike there, the whole token is confusable. Both are spelled again in the script that can hold
the whole token. What remains is normalised by kind of character.
"""

from __future__ import annotations

import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Letters that look the same, as (Latin, Cyrillic, Greek); "-" where a script has none.
LOOKALIKES = """
A А Α
B В Β
C С -
E Е Ε
H Н Η
I І Ι
J Ј -
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
S Ѕ -
T Т Τ
X Х Χ
Y Ү Υ
Z - Ζ
- Ф Φ
- Г Γ
- П Π
a а α
c с -
d ԁ -
e е -
h һ -
i і ι
j ј -
k к κ
l ӏ -
o о ο
p р ρ
q ԛ -
r г -
s ѕ -
u - υ
v ѵ ν
w ԝ ω
x х χ
y у γ
"""
SCRIPTS = ("Latin", "Cyrillic", "Greek")
# Letters of further scripts that look like Latin ones, as (letter, look-alikes).
LIKE_LATIN = """
A Ꭺ ꓮ
B Ᏼ ꓐ
C Ꮯ ꓚ Ⲥ
D Ꭰ ꓓ
E Ꭼ ꓰ
F ꓝ
G Ꮐ ꓖ
H Ꮋ ꓧ Ⲏ
I ꓲ Ⲓ
J Ꭻ ꓙ
K Ꮶ ꓗ Ⲕ
L Ꮮ ꓡ
M Ꮇ ꓟ Ⲙ
N ꓠ Ⲛ
O Օ ꓳ Ⲟ
P Ꮲ ꓑ Ⲣ
R Ꭱ ꓣ
S Ꮪ Տ ꓢ
T Ꭲ ꓔ Ⲧ
U Ս ꓴ
V Ꮩ ꓦ
W Ꮃ ꓪ
X ꓫ Ⲭ
Y ꓬ
Z Ꮓ ꓜ
a ɑ
c ⲥ
g ɡ ց
h հ
n ո
o օ ⲟ
p ⲣ
q զ
u ս
"""
LOOK: dict[str, dict[str, str]] = {}
for _row in LOOKALIKES.split("\n"):
    _group = dict(zip(SCRIPTS, _row.split(), strict=False))
    for _script, _letter in _group.items():
        if _letter != "-":
            LOOK.setdefault(_letter, {}).update({s: x for s, x in _group.items() if x != "-" and s != _script})
for _letter, *_like in map(str.split, filter(None, LIKE_LATIN.split("\n"))):
    for _x in _like:
        LOOK.setdefault(_x, {})["Latin"] = _letter
#: Latin letters that stand for others in words of ordinary ones; in phonetic notation they are letters of their own.
LATIN_LOOKS = "ɑɡ"
#: From so many letters on, a word with digits after it is judged as the word alone is.
WORD_WITH_DIGITS = 4

#: Signs without a width, that never belong into a word of plain text.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e\u2061\u2062\u2063\u2064\u034f"
#: Compatibility forms that are the usual way to type: the vowels AM of Thai and Lao.
USUAL = "ำຳ"

_SETS = {"Han": {"Han", "Jpan", "Kore", "Hanb"}, "Hiragana": {"Hiragana", "Jpan"}, "Katakana": {"Katakana", "Jpan"}, "Hangul": {"Hangul", "Kore"}, "Bopomofo": {"Bopomofo", "Hanb"}}
_NAMES = ("Latin", "Cyrillic", "Greek", "Armenian", "Georgian", "Cherokee", "Coptic", "Lisu", "Hebrew", "Arabic", "Devanagari", "Bengali", "Tamil", "Thai", "Lao", "Khmer", "Myanmar", "Ethiopic", "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo")
_BY_NAME = [(n, regex.compile(rf"\p{{scx={n}}}")) for n in _NAMES]
_ANY = regex.compile(r"\p{scx=Common}|\p{scx=Inherited}")


@lru_cache(1 << 16)
def scripts(ch: str) -> frozenset[str] | None:
    """Resolved script set of one character; None where it goes with any script."""
    if _ANY.match(ch):
        return None
    own = {s for n, p in _BY_NAME if p.match(ch) for s in _SETS.get(n, {n})}
    return frozenset(own) if own else frozenset({"other"})


@lru_cache(1 << 16)
def is_compatibility(ch: str) -> bool:
    """A letter, ideograph or digit in full-width, half-width, mathematical or another compatibility form."""
    if ch < "\u0080" or ch in USUAL:
        return False
    kind, how = ud.category(ch), ud.decomposition(ch)
    if kind[0] == "L" or kind in ("Nd", "Nl"):
        return how.startswith("<") or (bool(how) and kind == "Lo" and " " not in how and ud.name(ch, "").startswith("CJK COMPATIBILITY"))
    return kind == "So" and ud.name(ch, "").startswith("KANGXI RADICAL")


@lru_cache(1 << 16)
def composes(pair: str) -> bool:
    """A letter and a combining mark with one composed character."""
    return pair[0].isalpha() and ud.category(pair[1])[0] == "M" and len(ud.normalize("NFC", pair)) == 1


_JOINED = regex.compile(
    r"(?<=\p{Extended_Pictographic}[\p{Emoji_Modifier}\ufe0f]?)\u200d(?=\p{Extended_Pictographic})"
    r"|(?<=\p{Indic_Syllabic_Category=Virama})[\u200c\u200d]"
)
_HIDDEN = regex.compile(f"[{INVISIBLE}]")
_SPACES = regex.compile(r"[^\P{Zs} ]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_WORD_REST = regex.compile(r"[\p{N}_]")
_DIGITS_END = regex.compile(r"\p{Nd}+(?![\p{L}\p{N}_])")
_LETTERED = regex.compile(r"(?:\p{Cyrillic}|\p{Greek})")
_FURTHER = regex.compile(f"[{''.join(x for x in LOOK if x not in LOOKALIKES)}]")
_FURTHER_SCRIPTS = {s: regex.compile(rf"\p{{{s}}}") for s in ("Armenian", "Cherokee", "Coptic", "Lisu")}
_PHONETIC = regex.compile(rf"[A-Za-z]*[{LATIN_LOOKS}][A-Za-z{LATIN_LOOKS}]*")
_LATIN = regex.compile(r"\p{Latin}")
_MARKED = regex.compile(r"\p{M}")
_OF_SCRIPT = {s: regex.compile(rf"\p{{{s}}}") for s in SCRIPTS}
#: What can make a text a case at all, in Java's syntax: most texts never reach Python.
PLAIN = r"^\p{ASCII}*$"


def _hidden(text: str) -> bool:
    if not _HIDDEN.search(text):
        return False
    return bool(_HIDDEN.search(_JOINED.sub("", text)))


def _dominant(text: str) -> str | None:
    """The script of most letters among those that have look-alikes in each other, else None."""
    n = Counter()
    for s in SCRIPTS:
        n[s] = len(_OF_SCRIPT[s].findall(text))
    if _FURTHER.search(text):
        n.update({s: len(p.findall(text)) for s, p in _FURTHER_SCRIPTS.items()})
    best, count = n.most_common(1)[0]
    return best if count and best in SCRIPTS else None


def _target(token: str, text_script: str | None, alone: bool) -> str | None:
    """The script a confusable token belongs to; None where the token is consistent."""
    own = [s for s in map(scripts, token) if s is not None]
    if not own:
        return None
    shared = frozenset.intersection(*own)
    fits = lambda target: all((s := scripts(c)) is None or target in s or target in LOOK.get(c, {}) for c in token)
    if shared:
        if _PHONETIC.fullmatch(token) and sum(c.isascii() for c in token) >= 2:
            return "Latin"
        if alone and text_script and text_script not in shared and fits(text_script):
            return text_script
        return None
    order = Counter(next(iter(s)) for s in own if len(s) == 1)
    for target in [*([text_script] if text_script else []), *(s for s, _ in order.most_common() if s != text_script)]:
        if target in SCRIPTS and fits(target):
            return target
    return None


def _respell(text: str) -> tuple[str, bool]:
    """Tokens of confusable letters in the script they belong to; whether there was one."""
    mixed = _LETTERED.search(text) and (_LATIN.search(text) or sum(p.search(text) is not None for p in _OF_SCRIPT.values()) > 1)
    if not mixed and not (_FURTHER.search(text) and _LATIN.search(text)):
        return text, False
    script, out, at, hit = _dominant(text), [], 0, False
    for m in _TOKEN.finditer(text):
        token, (a, b) = m.group(), m.span()
        if token.isascii() and script == "Latin":
            continue
        # an abbreviation or a number with letters is one word: it must fit as a whole
        alone = not (_WORD_REST.match(text[b : b + 1]) or _WORD_REST.match(text[a - 1 : a] if a else ""))
        alone = alone or (b - a >= WORD_WITH_DIGITS and not _WORD_REST.match(text[a - 1 : a] if a else "") and _DIGITS_END.match(text, b) is not None)
        alone = alone and not (text[b : b + 1] == "." and text[b + 1 : b + 2].isalnum()) and not (a > 1 and text[a - 1] == "." and text[a - 2].isalnum())
        if target := _target(token, script, alone):
            out += [text[at:a], "".join(LOOK[c][target] if (s := scripts(c)) is not None and (target not in s or c in LATIN_LOOKS) else c for c in token)]
            at, hit = b, True
    return ("".join([*out, text[at:]]), True) if hit else (text, False)


def kinds(text: str | None) -> list[str]:
    """What makes the text a case: compatibility, decomposed, invisible, space, script; none for null or ASCII text."""
    if text is None or text.isascii():
        return []
    found = []
    present = set(text)
    if any(is_compatibility(c) for c in present):
        found.append("compatibility")
    if _MARKED.search(text) and any(composes(text[m.start() - 1 : m.start() + 1]) for m in _MARKED.finditer(text, 1)):
        found.append("decomposed")
    if _hidden(text):
        found.append("invisible")
    if _SPACES.search(text):
        found.append("space")
    # forms are unified first, so that a look-alike is seen beside a mathematical letter too
    if _respell(_unify(text))[1]:
        found.append("script")
    return found


def _unify(text: str) -> str:
    if _HIDDEN.search(text):
        keep = {m.start() for m in _JOINED.finditer(text)}
        text = "".join(c for i, c in enumerate(text) if c not in INVISIBLE or i in keep)
    if any(map(is_compatibility, set(text))):
        text = "".join(ud.normalize("NFKC", "".join(run)) if odd else "".join(run) for odd, run in groupby(text, is_compatibility))
    if not ud.is_normalized("NFC", text):
        text = ud.normalize("NFC", text)
    return _SPACES.sub(" ", text)


def consistent(text: str | None) -> str | None:
    """The text in its one form. Null stays null, empty stays empty; applying it again changes nothing."""
    if text is None or text.isascii():
        return text
    return _respell(_unify(text))[0]


RESULT = StructType([StructField("kinds", ArrayType(StringType())), StructField("clean", StringType())])


@F.pandas_udf(RESULT)
def _examine(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        k = [kinds(t) for t in s]
        yield pd.DataFrame({"kinds": k, "clean": [consistent(t) if f else t for t, f in zip(s, k, strict=True)]})


def examine(text: Column) -> Column:
    """Struct of ``kinds`` and ``clean``. Only for text beyond ASCII; see ``unify_values``."""
    return _examine(text)


def unify_values(values: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``clean`` and ``kinds`` to each row; ASCII, empty and null values never leave the JVM.

    Existing columns of these names are replaced. Null gives null and no kinds. Repeated rows are kept.
    """
    col = F.col(f"`{text}`")
    ascii_only = col.isNull() | col.rlike(PLAIN)
    rest = values.drop(*[c for c in ("clean", "kinds") if c != text])
    a = rest.where(ascii_only).withColumns({"clean": col, "kinds": F.array().cast("array<string>")})
    b = rest.where(~ascii_only).withColumn("_x", _examine(col)).withColumns({"clean": F.col("_x.clean"), "kinds": F.col("_x.kinds")}).drop("_x")
    return a.unionByName(b)


def affected_values(values: DataFrame) -> DataFrame:
    """Of (src, row_key, field, text): each value that holds a confusable form, once per key, with kinds and clean text."""
    beyond = values.where("text IS NOT NULL").where(~F.col("text").rlike(PLAIN))
    return beyond.withColumn("_x", _examine(F.col("text"))).where(F.size("_x.kinds") > 0).select("src", "row_key", "field", F.col("_x.kinds").alias("kinds"), F.col("_x.clean").alias("clean")).dropDuplicates(["src", "row_key", "field"])
