"""Porter's stemming rules (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes and what replaces them, in the order of the published steps 2, 3 and 4.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]

_VOWELS = frozenset("aeiou")


def _kinds(word: str) -> str:
    """v and c for the vowels and consonants of a word; y is a vowel after a consonant."""
    kinds = ""
    for i, letter in enumerate(word):
        vowel = letter in _VOWELS or letter == "y" and i > 0 and kinds[-1] == "c"
        kinds += "v" if vowel else "c"
    return kinds


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: list[tuple[str, str]]) -> str:
    """The longest suffix among the rules, replaced where a measure of 1 or more is left."""
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found and _measure(stem := word[: -len(found[0])]) > 0:
        return stem + found[1]
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if _has_vowel(left := word[: -len(suffix)]):
                    if left.endswith(("at", "bl", "iz")):
                        left += "e"
                    elif _doubled(left) and left[-1] not in "lsz":
                        left = left[:-1]
                    elif _measure(left) == 1 and _short_end(left):
                        left += "e"
                    word = left
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if suffix:
        left = word[: len(word) - (3 if suffix in ("sion", "tion") else len(suffix))]
        if _measure(left) > 1:
            word = left
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if _doubled(word) and word[-1] == "l" and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
