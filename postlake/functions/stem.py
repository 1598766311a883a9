"""Porter's suffix-stripping algorithm for English words (M. F. Porter, 1980, with the author's two later changes)."""

from __future__ import annotations

import functools

#: The algorithm's suffixes and what takes their place, by step; within a step the longest that fits counts.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_BY_LENGTH = {k: sorted(s, key=len, reverse=True) for k, s in ((2, STEP2), (3, STEP3), (4, STEP4))}


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or w[i] == "y" and i > 0 and not _vowel(w, i - 1)


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last being none of w, x, y."""
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            bare = w[: -len(end)]
            if not _has_vowel(bare):
                return w
            if bare.endswith(("at", "bl", "iz")):
                return bare + "e"
            if len(bare) > 1 and bare[-1] == bare[-2] and not _vowel(bare, len(bare) - 1) and bare[-1] not in "lsz":
                return bare[:-1]
            return bare + "e" if _measure(bare) == 1 and _short_end(bare) else bare
    return w


def _replaced(w: str, table: dict[str, str], order: list[str]) -> str:
    for end in order:
        if w.endswith(end):
            return w[: -len(end)] + table[end] if _measure(w[: -len(end)]) else w
    return w


def _dropped(w: str) -> str:
    for end in _BY_LENGTH[4]:
        if w.endswith(end):
            bare = w[: -len(end)]
            return bare if _measure(bare) > 1 and (end != "ion" or bare.endswith(("s", "t"))) else w
    return w


def _tidied(w: str) -> str:
    if w.endswith("e"):
        bare = w[:-1]
        m = _measure(bare)
        if m > 1 or m == 1 and not _short_end(bare):
            w = bare
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer, and of more than 64, are left as they are."""
    if not 2 < len(word) <= 64:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    return _tidied(_dropped(_replaced(_replaced(w, STEP2, _BY_LENGTH[2]), STEP3, _BY_LENGTH[3])))
