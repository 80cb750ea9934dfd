"""The English (Porter2) stemmer, for one term at a time; callers hand it distinct terms."""

from __future__ import annotations

import re

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Fixed values of the published algorithm: whole-word exceptions, suffixes and their replacements.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_DONE_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_REGION = re.compile(f"[{_VOWELS}][^{_VOWELS}]")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _regions(word: str) -> tuple[int, int]:
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _after(word, 0)
    return r1, _after(word, r1)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def english_stem(term: str) -> str:
    """Stem of a lower-cased term; terms of one or two letters, and other scripts, stay as they are."""
    word = term.replace("’", "'").lstrip("'")
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    if word[0] == "y":
        word = "Y" + word[1:]
    word = re.sub(f"(?<=[{_VOWELS}])y", "Y", word)
    r1, r2 = _regions(word)

    word = re.sub(r"('s'|'s|')$", "", word)
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in _DONE_AFTER_1A:
        return word
    # 1b: past and progressive forms
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and _has_vowel(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"
    # 1c: final y
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # 2 and 3: derivational endings in the first region
    ending = _longest(word, (*_STEP_2, "ogi", "li"))
    if ending and len(word) - len(ending) >= r1:
        stem = word[: -len(ending)]
        if ending == "ogi":
            word = stem + "og" if stem.endswith("l") else word
        elif ending == "li":
            word = stem if stem and stem[-1] in "cdeghkmnrt" else word
        else:
            word = stem + _STEP_2[ending]
    ending = _longest(word, (*_STEP_3, "ative"))
    if ending and len(word) - len(ending) >= r1:
        if ending != "ative":
            word = word[: -len(ending)] + _STEP_3[ending]
        elif len(word) - len(ending) >= r2:
            word = word[: -len(ending)]
    # 4: endings in the second region
    ending = _longest(word, (*_STEP_4, "ion"))
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(ending)]
    # 5: final e and l
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _ends_short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
