"""The Porter stemmer (Porter 1980, with the published later rules), over single lower-case words.

It is called once per distinct word of a vocabulary; words that hold anything but a-z stay as they are, but for accents
that :func:`folded` takes off first.
"""

from __future__ import annotations

import re
import unicodedata

# Suffixes of the second, third and fourth step and what stands for them.
STEP_2 = dict(
    x.split(":")
    for x in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate"
        " alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
    ).split()
)
STEP_3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_ASCII = re.compile(r"[a-z]+")
_LETTERS = str.maketrans({c: "v" if c in "aeiou" else "c" for c in "abcdefghijklmnopqrstuvwxyz"})
_ENDS_2, _ENDS_3, _ENDS_4 = tuple(STEP_2), tuple(STEP_3), tuple(STEP_4)


def folded(word: str) -> str:
    """Lower case without combining marks."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _shape(stem: str) -> str:
    """``c`` and ``v`` for each letter: y is a vowel behind a consonant."""
    if "y" not in stem:
        return stem.translate(_LETTERS)
    out = ""
    for k, c in enumerate(stem):
        out += "v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels goes over into consonants."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last none of w, x and y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], ends: tuple[str, ...], least: int) -> str:
    """The longest suffix of the table counts, and goes if enough stands before it."""
    if not word.endswith(ends):
        return word
    suffix = max((s for s in table if word.endswith(s)), key=len)
    stem = word[: len(word) - len(suffix)]
    return stem + table[suffix] if _measure(stem) > least else word


def _tense(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = next((s for s in ("ed", "ing") if word.endswith(s)), None)
    if suffix is None or "v" not in _shape(word[: -len(suffix)]):
        return word
    word = word[: -len(suffix)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def porter(word: str) -> str:
    """The stem of a word, without accents."""
    word = folded(word)
    if len(word) < 3 or not _ASCII.fullmatch(word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _tense(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, _ENDS_2, 0), STEP_3, _ENDS_3, 0)
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len) if word.endswith(_ENDS_4) else None
    if suffix is not None and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[: -len(suffix)][-1:] in ("s", "t")):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
