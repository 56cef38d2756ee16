"""Transcripts into clean speaker turns.

Whether a turn begins at a line is a decision of boosted trees over what stands before the line's first
colon or semicolon (how it resembles the speakers' names, its length, star, stamp), the time that has passed
and the lines around. They are trained on lines whose labels are certain, on copies with shortened and
misspelled names, and on copies with words and names of nobody in the label's place. Words are told from time
stamps, sound notes and fillers token by token, and a label is brought to the spelling of the speaker it
resembles most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted
from .chars import consistent
from .plain import is_filler, without_notes

#: Most transcripts that give training rows, and most rows that the decisions are trained on; they are applied to all.
SAMPLE, SAMPLE_ROWS = 40, 6_000
#: Depth of the trees, and lines of a transcript on which a name is tried that labels none.
DEPTH, TRIED = 3, 4
#: Edits and lengths beyond these are alike to the decisions.
_FAR, _WIDE = 9, 40

_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?"
_STAMP = re.compile(rf"[\s\x15]*(?:\[\s*{_CLOCK}\s*\]|\(\s*{_CLOCK}\s*\)|<\s*{_CLOCK}\s*>|{_CLOCK}(?=[\s:;]|$))[\s\x15]*")
_SPAN = re.compile(r"\x15?\b\d+_\d+\b\x15?")
_ALONE = re.compile(rf"(?<![\w:.,]){_CLOCK}(?![\w:])")
_META = re.compile(r"\s*[@%][^\W\d_]")
_ONE_CLOCK, _LABEL_END, _OUTER = re.compile(_CLOCK), re.compile("[:;]"), re.compile(r"[.\s]+$")
_RUN, _ASCII_RUN = regex.compile(r"[\p{L}\p{M}\p{N}'’:\-]+"), re.compile(r"[A-Za-z0-9':\-]+")
_LETTER_OR_DIGIT = regex.compile(r"[\p{L}\p{N}]")
_LABEL_WORD = re.compile(r"[^\W_]+")
_WORD_END, _WORD_START = regex.compile(r"\p{L}+$"), regex.compile(r"\p{L}+")
ALL = "ALL"


def _seconds(stamp: str) -> float | None:
    m = _ONE_CLOCK.search(stamp)
    if not m:
        return None
    total = 0.0
    for p in m.group().replace(",", ".").split(":"):
        total = total * 60 + float(p)
    return total


@lru_cache(1 << 16)
def distance(a: str, b: str) -> int:
    """Edits between two names; two letters that changed places count as one."""
    prev2, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        prev2, prev = prev, cur
    return prev[-1]


class Likeness(NamedTuple):
    """How a label resembles the speaker it resembles most."""

    speaker: str | None
    exact: bool = False
    prefix: float = 0.0  # share of the name that the label is the beginning of, else 0
    edits: int = _FAR  # edits to the name or its beginning
    ratio: float = 1.0  # edits for each letter
    margin: int = 0  # edits more to the next name

    @property
    def rank(self) -> float:
        return 1.0 if self.exact else 0.5 + self.prefix / 2 if self.prefix else max(0.0, 0.5 - self.ratio)


NOBODY = Likeness(None)


class Names:
    """A transcript's speakers: finds whom a label means, and how well it fits."""

    def __init__(self, speakers):
        own = [s for s in (speakers if speakers is not None else []) if s is not None and str(s).strip()]
        self.by: dict[str, str] = {}
        for s in own:
            self.by.setdefault(consistent(str(s)).strip().lower(), s)
        self.cache: dict[str, Likeness] = {}

    def one(self, label: str) -> Likeness:
        label = _OUTER.sub("", label.strip().lower())
        if label in self.by:
            return Likeness(self.by[label], True, 1.0, 0, 0.0, _FAR)
        if not label or not self.by:
            return NOBODY
        begun = min((n for n in self.by if n.startswith(label)), key=len, default=None)
        if begun is not None:
            return Likeness(self.by[begun], False, len(label) / len(begun), 0, 0.0, _FAR)
        # a label longer than a name by more than the edits that count is as far as can be
        near = sorted((_FAR if len(label) - len(n) >= _FAR else min(_FAR, distance(label, n[: len(label) + 3])), n) for n in self.by)
        d, n = near[0]
        return Likeness(self.by[n], False, 0.0, d, d / min(len(label), len(n)), near[1][0] - d if len(near) > 1 else _FAR)

    def label(self, text: str) -> Likeness:
        """Of a whole label: one name, several joined by a slash, or all. Of joint names the least alike counts."""
        found = self.cache.get(text)
        if found is None:
            found = self.cache[text] = self._label(consistent(text).strip())
        return found

    def _label(self, text: str) -> Likeness:
        if text.lower() == "all" and "all" not in self.by:
            return Likeness(ALL, True, 1.0, 0, 0.0, _FAR)
        parts = [self.one(p) for p in text.split("/")]
        if any(p.speaker is None for p in parts):
            return NOBODY
        worst = min(parts, key=lambda p: p.rank)
        return worst._replace(speaker="/".join(dict.fromkeys(str(p.speaker) for p in parts)))


@dataclass(slots=True)
class Line:
    number: int
    text: str  # without stamps before the label
    label: str | None  # what stands before the first colon or semicolon, if it may be a label
    rest: str
    like: Likeness
    star: bool
    stamp: float | None
    meta: bool
    indent: int


def _lengthened(body: str, at: int) -> bool:
    """The colon stands inside a lengthened filler, as in u:m."""
    if body[at] != ":" or not (around := (_WORD_END.search(body[:at]), _WORD_START.match(body, at + 1)))[0] or not around[1]:
        return False
    return is_filler((around[0].group() + around[1].group()).lower())


def read_lines(text: str, names: Names) -> list[Line]:
    """Lines at each LF, from 1, with their possible labels."""
    out = []
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip("\r")
        if number == 1:
            line = line.lstrip("\ufeff")
        body = line.lstrip()
        indent = len(line) - len(body)
        meta = body[:1] in ("@", "%") and _META.match(body) is not None
        stamp, label, like, star = None, None, NOBODY, False
        if m := _STAMP.match(line):
            stamp, body = _seconds(m.group()), line[m.end() :]
        rest = body
        head = None if meta else _LABEL_END.search(body)
        if head:
            at = head.start()
            star = body[0] == "*"
            label = body[star:at].strip()
            if not label or _lengthened(body, at):
                label, star = None, False
            else:
                like, rest = names.label(label), body[at + 1 :]
                if m := _STAMP.match(rest):
                    rest, stamp = rest[m.end() :], stamp if stamp is not None else _seconds(m.group())
        out.append(Line(number, body, label, rest, like, star, stamp, meta, indent))
    return out


#: What the decisions see: the label's likeness, its shape, stamps and gaps, and the lines around.
FEATURES = "exact prefix edits ratio margin words chars names star stamped gap indent recurs before after".split()


def _shown(label: str, like: Likeness) -> tuple:
    return like.exact, like.prefix, like.edits, like.ratio, min(like.margin, _FAR), min(_WIDE, len(_LABEL_WORD.findall(label))), min(_WIDE, len(label)), label.count("/") + 1


def features(lines: list[Line]) -> np.ndarray:
    """One row for each line with a label; the others have nothing that could name a speaker."""
    rows, last, seen = [], None, {}
    for x in lines:
        if x.label:
            k = x.label.lower()
            seen[k] = seen.get(k, 0) + 1
    for i, x in enumerate(lines):
        gap = x.stamp - last if x.stamp is not None and last is not None else -1.0
        last = x.stamp if x.stamp is not None else last
        if x.label is None:
            continue
        before = lines[i - 1].like.rank if i else 0.0
        after = lines[i + 1].like.rank if i + 1 < len(lines) else 0.0
        rows.append((*_shown(x.label, x.like), x.star, x.stamp is not None, max(-1.0, min(gap, 60.0)), min(x.indent, 8), seen[x.label.lower()] / len(lines), before, after))
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


def _spoilt(name: str, h: int) -> list[str]:
    """A name in full, shortened and misspelled, as labels are."""
    out = [name, name[: 1 + h % len(name)]]
    if len(name) > 3:
        i = 1 + h // 7 % (len(name) - 2)
        out += [name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + name[i + 1 :], name[:i] + name[i] + name[i:], name[:i] + chr(97 + h // 11 % 26) + name[i + 1 :]]
    if len(name) > 5:
        out.append(name[: i - 1] + name[i : len(name) - 1])
    return out


def _other(name: str, h: int) -> list[str]:
    """Names of nobody: one spelled backwards, and one with every other letter changed."""
    return [name[::-1], "".join(chr(97 + (ord(c) + h + i) % 26) if i % 2 else c for i, c in enumerate(name))]


def training_rows(key: str, text: str | None, speakers) -> list[tuple[tuple, int]]:
    """(features, begins a turn) of lines of one transcript, told without the decisions.

    A line labelled in full begins a turn. So do copies of labelled lines under a speaker's name, shortened or
    misspelled; copies under words of the line, or under names of nobody, do not.
    """
    names = Names(speakers)
    if not text or not names.by:
        return []
    lines = read_lines(text, names)
    x, out = features(lines), []
    labelled = [n for n in lines if n.label is not None]
    own = sorted(names.by)

    def copy(row: np.ndarray, label: str, begins: int) -> None:
        like = names.label(label)
        if begins and like.speaker is None or not begins and like.prefix:
            return
        new = row.copy()
        new[:8] = _shown(label, like)
        new[12] = new[12] if begins else xxhash.xxh64_intdigest(label) % 8 / len(lines)
        out.append((tuple(new), begins))

    blank = np.zeros(len(FEATURES))
    blank[10], blank[12] = -1.0, 1 / len(lines)
    tried = [*zip(labelled, x, strict=True)] or [(n, blank) for n in lines if not n.meta][:TRIED]
    for n, row in tried:
        h = xxhash.xxh64_intdigest(f"{key}:{n.number}")
        if n.like.exact:
            out.append((tuple(row), 1))
        if n.like.exact or len(tried) <= TRIED:
            for s in _spoilt(own[h % len(own)], h):
                copy(row, s, 1)
                copy(row, s.upper() if h & 1 else s + "/" + own[h // 3 % len(own)], 1)
        words = _LABEL_WORD.findall(n.rest)[:4]
        for k in range(1, len(words) + 1):
            copy(row, " ".join(words[:k]), 0)
            copy(row, words[k - 1], 0)
        for s in _other(own[h % len(own)], h):
            copy(row, s, 0)
    return out


def train(transcripts: list[tuple[str, str | None, list[str]]]) -> Boosted:
    """Boosted decisions from (id, text, speakers) of some transcripts."""
    return fit([r for t in transcripts for r in training_rows(*t)])


def fit(rows: list[tuple[tuple, int]]) -> Boosted:
    rows = sorted(rows)
    return Boosted(depth=DEPTH).fit(np.array([r for r, _ in rows]).reshape(-1, len(FEATURES)), np.array([y for _, y in rows]))


@lru_cache(1 << 16)
def _is_word(run: str) -> bool:
    """Holds a letter or digit, and is no filler."""
    return _LETTER_OR_DIGIT.search(run) is not None and not is_filler(re.sub(r"['’:\-]", "", run).lower())


def clean_words(text: str) -> list[str]:
    """Words without time stamps, sound notes and fillers, as they are written."""
    text = without_notes(consistent(text))
    if "_" in text:
        text = _SPAN.sub(" ", text)
    if ":" in text:
        text = _ALONE.sub(" ", text)
    return [w for w in (_ASCII_RUN if text.isascii() else _RUN).findall(text) if _is_word(w)]


def turns_of(transcripts: list[tuple[str | None, object]], model: Boosted) -> list[list[tuple[str, int, int, str]]]:
    """(speaker, first line, last line, words) of each turn of each (text, speakers); none for null, empty and blank texts."""
    read = [read_lines(t, Names(s)) if t and t.strip() else [] for t, s in transcripts]
    shown = [features(lines) for lines in read]
    begins = iter((model.probability(np.vstack(shown)) >= 0.5).tolist() if shown else [])
    out = []
    for lines in read:
        turns: list[tuple[str, int, int, list[str]]] = []
        speaker = None
        for x in lines:
            label = x.label is not None and next(begins)
            if x.meta:
                continue
            # where there are no speakers, nobody can begin
            label = label and x.like.speaker is not None
            if label:
                speaker = x.like.speaker
            if speaker is None:
                continue
            words = clean_words(x.rest if label else x.text)
            if not words:
                continue
            if turns and turns[-1][0] == speaker:
                s, a, _, w = turns[-1]
                w.extend(words)
                turns[-1] = (s, a, x.number, w)
            else:
                turns.append((speaker, x.number, x.number, words))
        out.append([(s, a, b, " ".join(w)) for s, a, b, w in turns])
    return out


def turns(text: str | None, speakers, model: Boosted) -> list[tuple[str, int, int, str]]:
    """Turns of one transcript."""
    return turns_of([(text, speakers)], model)[0]


def speaker_turns(transcripts: DataFrame, sample: int = SAMPLE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(transcript_id, turn, speaker, line_start, line_end, text) of every transcript, in order.

    The text is raw_text, else text. Null, empty and blank transcripts and those without speakers give no
    turns; repeated rows count once per transcript_id. Decisions are trained on at most ``sample_rows`` rows, by
    their hashes, of the transcripts with the ``sample`` smallest id hashes; an empty table gives none. Other
    columns are ignored.
    """
    base = transcripts.select("transcript_id", "speakers", F.coalesce("raw_text", "text").alias("_t")).where("transcript_id IS NOT NULL AND _t <> ''")
    kind = dict(base.dtypes)["transcript_id"]
    hashed = F.xxhash64("transcript_id").alias("_h")
    last = transcripts.where("transcript_id IS NOT NULL").select(hashed).distinct().orderBy("_h").limit(sample).agg(F.max("_h").alias("last")).first()["last"]

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for i, t, s in zip(b["transcript_id"], b["_t"], b["speakers"], strict=True) for r in training_rows(str(i), t, s)]
            yield pd.DataFrame({"x": [list(map(float, x)) for x, _ in rows], "y": np.array([y for _, y in rows], dtype=np.int32)})

    model = Boosted()
    if last is not None:
        some = base.where(hashed <= last).dropDuplicates(["transcript_id"]).mapInPandas(rows_of, "x array<double>, y int")
        model = fit([(tuple(r["x"]), r["y"]) for r in some.distinct().orderBy(F.xxhash64("x", "y"), "x").limit(sample_rows).collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = turns_of([*zip(b["_t"], b["speakers"], strict=True)], model)
            out = [(i, k, *x) for i, own in zip(b["transcript_id"], found, strict=True) for k, x in enumerate(own)]
            yield pd.DataFrame(out, columns=["transcript_id", "turn", "speaker", "line_start", "line_end", "text"])

    return base.dropDuplicates(["transcript_id"]).mapInPandas(run, f"transcript_id {kind}, turn int, speaker string, line_start long, line_end long, text string")
