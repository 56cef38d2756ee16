"""Sentence boundaries across languages and scripts.

A text falls into blocks at blank lines. Within a block every place where a sentence could end is a node
of a lattice; quotations and brackets are passed in one step, each node weighs what stands around it, and
the best path through the lattice gives the sentences. Scripts that are written without spaces are read as
a lattice of dictionary words, and the gaps between sentences are told by final particles and opening words.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .chars import INVISIBLE, consistent

# Titles and other abbreviations that a name, number or further words follow.
BEFORE_NAMES = """
mr mrs ms mx dr prof cr sr jr st rev hon sen rep gen col capt lt sgt cpl fr pres gov supt messrs mme mlle mgr
adm cmdr maj brig pvt insp det ald amb msgr bros treas atty esq mt ft ave blvd rd dept univ assn
no nos nr num fig figs vol ch sec art p pp para eq ed eds trans approx ca circa est env cf vs viz al resp incl excl
abb bd bzw bspw evtl ggf inkl jh kap max min mind s str tel u usf vgl z zb zz frl hr hrn
ex art chap tél av bd éd
др г гг им ул стр рис табл см ср тыс млн млрд проф акад руб коп обл
κ κα κος δρ καθ αρ σελ π χ μ λ βλ
د أ م ص
डॉ श्री प्रो क्र सं पृ
""".split()
# Abbreviations that may close a sentence before a capital.
MAY_CLOSE = "etc usw inc ltd co corp bros e.g i.e д т.д т.п κ.λπ κ.ά u.a u.s.w".split()
# Marks that close a sentence by themselves, single stops, and the Greek question mark.
STRONG, STOPS, QUESTION = "!?‼⁇⁈⁉！？。｡।॥؟۔።။", ".．", ";\u037e"
# Quotation marks and brackets with what closes them.
PAIRS = {"“": "”", "«": "»", "‘": "’", "「": "」", "『": "』", "„": "“”", "‚": "‘’", "‹": "›", '"': '"', "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "<": ">", "{": "}"}
BRACKETS = "([（【<{《〈"
CLOSERS = "”»’」』“›\"')]）】》〉"
OPENERS = "“«‘「『„‚‹\"([（【《〈"
# Words that go on after a quotation in scripts without capitals.
GOES_ON = "と って という といった 然后 说 道 问 他说 她说 答 هكذا قال قالت قالوا وقال وقالت ऐसा कहा बोला बोली पूछा उसने यह".split()
# Words of scripts without spaces, as dictionary of their lattices.
FINAL_WORDS = "です ます でした ました た だ った んだ した いた きた えた けた せた てた べた めた れた ね よ か ない 了 吗 呢 吧 啊 的 过 着".split()
PARTICLES = "了吗呢吧啊"
OPENING_WORDS = "そのあと 昨日 今日 明日 そして しかし また 次に 后来 昨天 今天 明天 他 她 我 我们 他们 但是 不过 那天".split()
# Polite endings, after which an opening word begins a sentence even without a gap.
POLITE_ENDINGS = "でした ました です ます".split()
#: A public vocabulary, in ranked tokens, whose words of spaceless scripts are the lattices' dictionary.
DEFAULT_WORDS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


_BLANK = regex.compile(r"(?>\r\n|\n|\r)[^\S\n\r]*(?:(?>\r\n|\n|\r)[^\S\n\r]*)+")
_LINE = regex.compile(r"[^\n\r]+")
_BREAK = regex.compile(r"\s*[\n\r]\s*")
_ITEM = regex.compile(r"(?:\(?(\d{1,3})[.)]|[•‣▪*\-–—])[^\S\n\r]+(?=\S)")
_LABEL = regex.compile(r"(?:\p{Lu}\p{L}{0,4}\.[^\S\n\r]+)?\p{Lu}[\p{L}\p{M}\p{N}'’\-]*(?:[^\S\n\r]+\p{Lu}[\p{L}\p{M}'’\-]*)?[^\S\n\r]*:(?=\s)")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}\p{So}\p{Sk}]")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_MARKS = re.compile(r"[.．…!?‼⁇⁈⁉！？。｡।॥؟۔።။;\u037e]")
_GREEK = regex.compile(r"\p{Greek}")
_OPENING = re.compile(r"[“«‘「『„‚‹\"(\[（【《〈<{]")
_SPACELESS_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{M}]+")
_SPACELESS_GAP = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}ー])\s+(?=[\p{Han}\p{Hiragana}\p{Katakana}])")
_SPACELESS_BEFORE = regex.compile(r"(?r)[\p{Han}\p{Hiragana}\p{Katakana}ー]+")
_POLITE_GAP = regex.compile(rf"(?<={'|'.join(POLITE_ENDINGS)})(?={'|'.join(OPENING_WORDS)})")
_LETTERS = regex.compile(rf"[\p{{L}}\p{{M}}{INVISIBLE}]+")
_MARK = regex.compile(r"\p{M}")
_ONE_OR_TWO_DIGITS = re.compile(r"\d{1,2}")
_NUMBERED = re.compile(r"(?m)^\s*\(?(\d{1,3})[.)]\s")
_NEXT_NUMBERED = re.compile(r"\s*[\n\r]\s*(?=\(?(\d{1,3})[.)]\s)")
_SPACE = regex.compile(r"\s+")
_ABBREVIATED = frozenset(BEFORE_NAMES)
_CLOSING = frozenset(MAY_CLOSE)
#: Weight that a sentence without any word costs, against 1 for each boundary.
WORDLESS = 3.0


def protected(block: str) -> list[tuple[int, int]]:
    """(start, end) of outermost quotations and brackets that are closed within the block."""
    out, i = [], 0
    while m := _OPENING.search(block, i):
        a = m.start()
        o = block[a]
        closing, j, depth = PAIRS[o], a + 1, 1
        while j < len(block):
            c = block[j]
            if o in BRACKETS and c == o:
                depth += 1
            elif c in closing and not (c in "’'" and (block[j + 1 : j + 2].isalpha() or j + 1 < len(block) and block[j + 1] in INVISIBLE)):
                depth -= 1
                if not depth:
                    break
            j += 1
        if j < len(block):
            out.append((a, j + 1))
            i = j + 1
        else:
            i = a + 1
    return out


@lru_cache(4)
def dictionary(path: str | None = DEFAULT_WORDS) -> dict[str, float]:
    """Words of spaceless scripts with their costs: those of a ranked vocabulary, the commoner the cheaper, and the words above."""
    costs: dict[str, float] = {}
    if path:
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                word = base64.b64decode(token).decode("utf-8", "ignore").strip()
                if len(word) > 1 and _SPACELESS_RUN.fullmatch(word):
                    costs.setdefault(word, 2 + math.log(1 + int(rank)))
    return costs | dict.fromkeys(FINAL_WORDS + OPENING_WORDS + GOES_ON, 4.0)


#: Cost of a character that no word of the dictionary covers.
UNKNOWN = 9.0


def word_lattice(text: str, words: dict[str, float] | None = None) -> list[str]:
    """The cheapest reading of spaceless text as dictionary words and single characters; of equal ones the fewest words."""
    words = dictionary(None) if words is None else words
    longest = max(map(len, words), default=1)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for i in range(1, len(text) + 1):
        options = [(best[i - 1][0] + UNKNOWN, best[i - 1][1] + 1, i - 1)]
        for n in range(1, min(i, longest) + 1):
            cost = words.get(text[i - n : i])
            if cost is not None:
                options.append((best[i - n][0] + cost, best[i - n][1] + 1, i - n))
        best.append(min(options))
    out, i = [], len(text)
    while i:
        out.append(text[best[i][2] : i])
        i = best[i][2]
    return out[::-1]


@lru_cache(1 << 14)
def _last_word(run: str) -> str:
    return word_lattice(run, _words())[-1]


@lru_cache(1 << 14)
def _first_word(run: str) -> str:
    return word_lattice(run, _words())[0]


_WORDS: dict[str, dict[str, float]] = {}


def _words() -> dict[str, float]:
    """The dictionary that the driver has read, else the words above."""
    return _WORDS.get("now") or dictionary(None)


def use_words(words: dict[str, float] | None) -> None:
    """The dictionary that lattices read from now on in this process."""
    if words is not None and _WORDS.get("now") != words:
        _WORDS["now"] = words
        _last_word.cache_clear()
        _first_word.cache_clear()


def _gap_ends(block: str, a: int, b: int) -> bool:
    """A gap between spaceless words ends a sentence: a final particle before it, an opening word after it."""
    before, after = _SPACELESS_BEFORE.search(block, 0, a), _SPACELESS_RUN.match(block, b)
    if not before or before.end() != a or not after:
        return False
    last = _last_word(before.group())
    return (last in FINAL_WORDS or last[-1] in PARTICLES) and _first_word(after.group()) in OPENING_WORDS


def _next(block: str, i: int) -> tuple[int, str, bool]:
    """(place, character, space before) of what follows, past white space, invisible characters and opening marks."""
    j, space = i, False
    while j < len(block) and (block[j].isspace() or block[j] in INVISIBLE):
        space |= block[j].isspace()
        j += 1
    k = j
    while k < len(block) and (block[k] in OPENERS or block[k] in INVISIBLE):
        k += 1
    return j, block[k] if k < len(block) else (block[j] if j < len(block) else ""), space


@lru_cache(1 << 16)
def _shape(word: str) -> str:
    """What kind of word stands before a stop: initial, clock, number, title, closing or word."""
    w = consistent(word).strip("'’-_")
    low = w.lower()
    if low in ("a.m", "p.m", "am", "pm") and "." in low:
        return "clock"
    if low in _CLOSING:
        return "closing"
    last = low.rpartition(".")[2]
    if low in _ABBREVIATED or last in _ABBREVIATED or low.replace(".", "") in _ABBREVIATED:
        return "title"
    if _ONE_OR_TWO_DIGITS.fullmatch(w):
        return "number"
    letters = last if last.isascii() else _MARK.sub("", last)
    if len(letters) == 1 and letters.isalpha():
        return "initial"
    return "word"


def _word_before(block: str, a: int) -> str:
    """The word that ends at ``a``, invisible signs aside."""
    e = a
    while e and block[e - 1] in INVISIBLE:
        e -= 1
    k = e
    while k and ((c := block[k - 1]).isalnum() or c in "._'’-" or (c > "\u00a0" and (c in INVISIBLE or _MARK.match(c)))):
        k -= 1
    return consistent(block[k:e])


def _starts_line(block: str, j: int, item: int | None) -> bool:
    """A speaker label or a further item begins here, at the beginning of a line."""
    if j >= len(block):
        return False
    if _LABEL.match(block, j):
        return True
    m = _ITEM.match(block, j)
    return bool(m) and (m.group(1) is None or item is None or int(m.group(1)) == item + 1)


def _weight(block: str, a: int, b: int, quoted: bool) -> float:
    """How much speaks for a sentence's end after the marks block[a:b], above 0, or against it."""
    marks = block[a:b].strip("".join(CLOSERS))
    j, nx, space = _next(block, b)
    if j >= len(block):
        return 1.0
    opening = block[j] in OPENERS
    first = nx if opening else block[j]
    if quoted:
        if first.islower() or block[j] in ",;:，、；：":
            return -1.0
        if first.isalpha() and not first.isupper() and not opening:
            follow = _LETTERS.match(block, j)
            word = consistent(follow.group()) if follow else ""
            if word in GOES_ON or (word and _CJK.match(first) and _first_word(word) in GOES_ON):
                return -1.0
        return 1.0
    if not space and (block[j] in ",;:)]-–—/%_@&" or first.isdigit()):
        return -1.0
    stop = marks and all(c in STOPS for c in marks)
    if any(c in STRONG + QUESTION for c in marks):
        return -1.0 if not space and first.islower() else 1.0
    if not stop or len(marks) > 1:  # dots in a row
        return -1.0 if first.islower() or block[j] in ",;:" else 1.0
    word = _word_before(block, a)
    shape = _shape(word)
    if not space and not opening:
        # a missing space: a capital, or a script without capitals on both sides
        caseless = first.isalpha() and first.lower() == first.upper() and word[-1:].lower() == word[-1:].upper()
        if not ((first.isupper() and (shape == "clock" or shape == "word" and len(word) > 1)) or (caseless and shape == "word" and word and not word[-1].isdigit())):
            return -1.0
    if first.islower() or block[j] in ",;:":
        return -1.0
    line = "\n" in block[b:j] or "\r" in block[b:j]
    if shape == "clock":
        return 1.0 if opening or first.isupper() or (line and _ITEM.match(block, j)) else -1.0
    if shape == "closing":
        return 1.0 if opening or first.isupper() else -1.0
    if shape in ("initial", "title", "number"):
        return -1.0
    return 1.0


def terminator_lattice(block: str, item: int | None = None) -> list[tuple[int, float]]:
    """(place, weight) of each place where a sentence could end, in order."""
    jumps = protected(block)
    nodes: dict[int, float] = {}
    inside = [False] * (len(block) + 1)
    for a, b in jumps:
        inside[a:b] = [True] * (b - a)
        quote = block[a] not in BRACKETS
        k = b - 1
        while k > a and (block[k - 1].isspace() or block[k - 1] in INVISIBLE):
            k -= 1
        if quote and k > a + 1 and _MARKS.match(block[k - 1]) and (block[k - 1] not in QUESTION or _GREEK.search(block[a:b])):
            nodes[b] = _weight(block, k - 1, b, True)
    at = 0
    while m := _MARKS.search(block, at):
        a = m.start()
        if inside[a] or (m.group() in QUESTION and not _GREEK.search(_word_before(block, a))):
            at = a + 1
            continue
        b = a + 1
        while b < len(block) and not inside[b] and (_MARKS.match(block[b]) and block[b] not in QUESTION or block[b] in CLOSERS or block[b] in INVISIBLE):
            b += 1
        nodes[b] = _weight(block, a, b, False)
        at = b
    # lines that begin with a label or an item
    for m in _BREAK.finditer(block):
        j, e = m.end(), m.start()
        if j < len(block) and not inside[j] and not inside[e] and _starts_line(block, j, item):
            ended = e and (block[e - 1] in STRONG + STOPS + "…" or block[e - 1] in CLOSERS)
            if ended or item is not None or _LABEL.match(block, j):
                nodes[e] = 1.0
    if block.isascii():
        return sorted(nodes.items())
    # scripts without spaces, where a mark may be missing
    if _THAI.search(block):
        for m in _SPACE.finditer(block):
            a, b = m.span()
            if a and b < len(block) and not inside[a] and (_THAI.match(block[a - 1]) or _THAI.match(block[b])):
                nodes[a] = -1.0 if block[a - 1].isdigit() or block[b].isdigit() else 1.0
    if _CJK.search(block):
        for m in _SPACELESS_GAP.finditer(block):
            a, b = m.span()
            if not inside[a] and a not in nodes:
                nodes[a] = 1.0 if _gap_ends(block, a, b) else -1.0
        for m in _POLITE_GAP.finditer(block):
            a = m.start()
            if not inside[a] and a not in nodes and _gap_ends(block, a, a):
                nodes[a] = 1.0
    return sorted(nodes.items())


def best_path(block: str, nodes: list[tuple[int, float]]) -> list[int]:
    """The ends of sentences on the best path through the lattice; the block's end is always one.

    A boundary brings its weight; a sentence without a word costs ``WORDLESS``.
    """
    places = [p for p, _ in nodes if 0 < p < len(block)]
    weight = {p: w for p, w in nodes}
    if not places:
        return [len(block)]
    points = [0, *places, len(block)]
    wordy = [block[a].isalnum() or _WORDLIKE.search(block, a, b) is not None for a, b in zip(points, points[1:], strict=False)]
    best, back = [0.0] + [float("-inf")] * (len(points) - 1), [0] * len(points)
    for j in range(1, len(points)):
        gain = weight.get(points[j], 0.0) if j < len(points) - 1 else 0.0
        if gain < 0:
            continue
        words = False
        for i in range(j - 1, -1, -1):
            words = words or wordy[i]
            if best[i] > float("-inf"):
                s = best[i] + gain - (0.0 if words else WORDLESS)
                if s > best[j]:
                    best[j], back[j] = s, i
                if words and i:
                    break  # a longer sentence would only lose boundaries
    out, j = [], len(points) - 1
    while j:
        out.append(points[j])
        j = back[j]
    return out[::-1]


def sentences(text: str | None, kind: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, end exclusive, without outer white space.

    Null, empty and blank texts have none. All else belongs to exactly one sentence.
    """
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        if s := piece.strip():
            out.append((a, a + len(s)))

    if kind is not None and kind.strip().lower() == "captions":
        for m in _LINE.finditer(text):
            add(*m.span())
        return out
    at, item = 0, None
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        lead = len(text[at:end]) - len(text[at:end].lstrip())
        block = text[at + lead : end]
        if block.strip():
            if (first := _ITEM.match(block)) and first.group(1):
                item = int(first.group(1))
            since = 0
            for e in best_path(block, _items(block, item)):
                add(at + lead + since, at + lead + e)
                since = e
            if item is not None and (numbers := _NUMBERED.findall(block)):
                item = int(numbers[-1])
        at = m.end() if m else end
    return out


def _items(block: str, item: int | None) -> list[tuple[int, float]]:
    """The block's lattice, its items counted on from ``item``."""
    nodes = dict(terminator_lattice(block, item))
    if item is not None:
        now = item
        for m in _NEXT_NUMBERED.finditer(block):
            if int(m.group(1)) == now + 1:
                nodes[m.start()] = 1.0
                now += 1
    return sorted(nodes.items())


def sentence_units(documents: DataFrame, with_text: bool = False, words: str | None = DEFAULT_WORDS) -> DataFrame:
    """(doc_id, start_char, end_char[, sentence]) of every sentence of every document.

    Null, empty and blank texts and null ids give no rows; a null kind counts as running text. Ids are taken as
    unique: a row that repeats gives its sentences again. ``words`` is the path of a ranked vocabulary, read by
    the driver, as dictionary of spaceless scripts; None leaves the few words fixed here. Other columns are ignored.
    """
    costs = dictionary(words)
    kind = dict(documents.dtypes)["doc_id"]
    base = documents.select("doc_id", "text", "kind").where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_words(costs)
        for b in batches:
            out = [(i, a, e, t[a:e]) for i, t, k in zip(b["doc_id"], b["text"], b["kind"], strict=True) for a, e in sentences(t, k)]
            f = pd.DataFrame(out, columns=["doc_id", "start_char", "end_char", "sentence"])
            yield f if with_text else f[["doc_id", "start_char", "end_char"]]

    return base.mapInPandas(run, f"doc_id {kind}, start_char long, end_char long" + ", sentence string" * with_text)
