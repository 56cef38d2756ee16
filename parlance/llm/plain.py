"""Plain words: what is left of a text once case, punctuation, spacing, line-end hyphens, look-alike
and invisible characters, fillers and sound notes are set aside."""

from __future__ import annotations

import re
from functools import lru_cache

import regex

from .chars import consistent

#: Sound notes: anything in brackets, &=word, *words*, runs of @.
NOTE = regex.compile(r"\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|&=[^\s:;,.?!]+|(?<![\w*])\*[^*\n]+\*(?!\w)|@+")
#: um, uh, er, erm, ah, ahm, hm and mm, however lengthened.
FILLER = regex.compile(r"(?:u+m+|u+h+|e+r+m*|a+h+m*|h+m+|mm+)")
_LINE_END = regex.compile(r"(?<=\p{L})-[ \t]*\r?\n[ \t]*(?=\p{L})")
_INSIDE = regex.compile(r"(?<=[\p{L}\p{M}\p{N}])['’:\-‐‑]+(?=\p{L})")
_SPACELESS = r"\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WORD = regex.compile(rf"(?V1)[{_SPACELESS}]\p{{M}}*|[[\p{{L}}\p{{M}}\p{{N}}]--[{_SPACELESS}]]+")
_ASCII_WORD = re.compile("[a-z0-9]+")
#: Words of texts without marks and spaceless scripts, for which this says the same and is quicker.
_SIMPLE_WORD = re.compile(r"[^\W_]+")
_NOT_SIMPLE = regex.compile(rf"[\p{{M}}{_SPACELESS}]")
_MAY_NOTE = re.compile(r"[\[(<&*@]")


def without_notes(text: str) -> str:
    """Sound notes replaced by a space, nested ones from the inside out."""
    if not _MAY_NOTE.search(text):
        return text
    while True:
        text, n = NOTE.subn(" ", text)
        if not n:
            return text


@lru_cache(1 << 16)
def is_filler(word: str) -> bool:
    return FILLER.fullmatch(word) is not None


def _words(text: str) -> list[str]:
    text = text.lower()
    if "-" in text and "\n" in text:
        text = _LINE_END.sub("", text)
    text = _INSIDE.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text)
    return (_WORD if _NOT_SIMPLE.search(text) else _SIMPLE_WORD).findall(text)


def words(text: str | None) -> list[str]:
    """Words after case, punctuation, spacing, line-end hyphens and look-alikes; characters in scripts without spaces."""
    return _words(consistent(text)) if text else []


def plain_words(text: str | None) -> list[str]:
    """Plain words; an empty list for null, empty and blank texts."""
    return [w for w in _words(without_notes(consistent(text))) if not is_filler(w)] if text else []
