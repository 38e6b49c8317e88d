"""The English Snowball stemmer, from its published definition."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
# The definition's word and suffix lists.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    m = re.match(r"gener|commun|arsen", w) or re.search(r"[aeiouy][^aeiouy]", w)
    r1 = m.end() if m else len(w)
    m = re.search(r"[aeiouy][^aeiouy]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if re.search("[aeiouy]", w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return w
    base = w[: -len(end)]
    if end.startswith("eed"):
        return base + "ee" if len(base) >= r1 else w
    if not re.search("[aeiouy]", base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT.search(base) else base


def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    w = w.lstrip("'")
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'(?:s'?)?$", "", w)
    w = _plural(w)
    if w in AFTER_1A:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, (*STEP_2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(end)] + STEP_2[end]
    end = _longest(w, (*STEP_3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + STEP_3[end]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    end = _longest(w, (*STEP_4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
