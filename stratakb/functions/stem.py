"""English suffix stripping (Porter, 1980) and folding of case and diacritics."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column

from .batches import string_lists

_SPLIT = re.compile(r"[\W_]+")
# The suffix tables of the published algorithm, longest first.
STEP2 = [("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("alli", "al"), ("ator", "ate"), ("bli", "ble"), ("eli", "e")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _shape(w: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _shape(w).endswith("cvc") and w[-1] not in "wxy"


def porter(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters and others than a-z stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for suffix, new in table:
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]):
                    w = w[: -len(suffix)] + new
                break
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(text: str, known: dict[str, str] | None = None) -> list[str]:
    """Stemmed words of a text, without case and diacritics, in order; known keeps stems for other texts."""
    plain = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    known = {} if known is None else known
    return [known[w] if w in known else known.setdefault(w, porter(w)) for w in _SPLIT.split(plain.lower()) if w]


def stemmed(text: Column) -> Column:
    """array<string> of fold(); a null text gives null."""

    def make():
        known: dict[str, str] = {}
        return lambda t: None if t is None else fold(t, known)

    return string_lists(make, text)
