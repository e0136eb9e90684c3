"""English word stems by the published Porter2 rules, for texts and queries alike."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published rules.
DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
LI_ENDINGS = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_S = "inning outing canning herring earring proceed exceed succeed".split()
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = re.compile(rf"(^{_VOWEL}{_OTHER}|{_OTHER}{_VOWEL}[^aeiouywxY])$")


def _region(word: str, start: int = 0) -> int:
    found = re.search(_VOWEL + _OTHER, word[start:])
    return start + found.end() if found else len(word)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _past(word: str, r1: int) -> str:
    """Step 1b: -eed, -ed and -ing with their -ly forms."""
    end = _longest(word, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    body = word[: -len(end)] if end else ""
    if not re.search(_VOWEL, body):
        return word
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if body[-2:] in DOUBLES:
        return body[:-1]
    return body + "e" if r1 >= len(body) and _SHORT.search(body) else body


@lru_cache(maxsize=100_000)
def english_stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, numbers and words of other scripts stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else _region(w)
    r2 = _region(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in AFTER_S:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not re.match(_VOWEL, w[-2]):
        w = w[:-1] + "i"
    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w.endswith("logi")) and (end != "li" or w[-3] in LI_ENDINGS):
        w = w[: -len(end)] + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stem(term: Column) -> Column:
    """The stems of a column of lower-case words; null stays null."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else english_stem(w))

    return stems(term)
