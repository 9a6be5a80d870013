"""Snowball stems of English and Danish words, by the published definitions of the two algorithms.

Words are stemmed once each: stems() takes the distinct terms, not the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The English algorithm's exceptions and endings.
EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
EN_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
EN_DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
EN_STARTS = ("gener", "commun", "arsen")
EN_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EN_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
EN_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
# The Danish algorithm's endings.
DA_STEP1 = ("erendes", "erende", "hedens", "ethed", "erede", "heden", "heder", "endes", "ernes", "erens", "erets", "ered", "ende", "erne", "eren", "erer", "heds", "enes", "eres", "eret", "hed", "ene", "ere", "ens", "ers", "ets", "en", "er", "es", "et", "e")
DA_S = "abcdfghjklmnoprtvyzå"
DA_STEP3 = ("elig", "els", "lig", "ig")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part behind the first consonant that follows a vowel begins."""
    m = re.search(f"[{vowels}][^{vowels}]", word[start:])
    return start + m.end() if m else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _short(word: str) -> bool:
    """Does it end in a short syllable?"""
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EN_WHOLE or word in EN_KEPT:
        return EN_WHOLE.get(word, word)
    w = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word.lstrip("'"))
    start = next((p for p in EN_STARTS if w.startswith(p)), None)
    r1 = len(start) if start else _region(w, "aeiouy")
    r2 = _region(w, "aeiouy", r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in EN_DONE:
        return w
    # past and present forms
    e = _longest(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if e in ("eedly", "eed"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search("[aeiouy]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(EN_DOUBLE):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # suffixes in the first region
    e = _longest(w, EN_STEP2)
    if e and len(w) - len(e) >= r1 and not (e == "ogi" and w[-4:-3] != "l") and not (e == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(e)] + EN_STEP2[e]
    e = _longest(w, EN_STEP3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + EN_STEP3[e]
    # suffixes in the second region
    e = _longest(w, EN_STEP4)
    if e and len(w) - len(e) >= r2 and not (e == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def danish(word: str) -> str:
    r1 = max(_region(word, "aeiouyæåø"), 3)
    w = word

    def ending(endings) -> str | None:
        e = _longest(w[r1:], endings)
        return e

    def pair() -> None:
        """A consonant pair at the end loses its last letter."""
        nonlocal w
        if ending(("gd", "dt", "gt", "kt")):
            w = w[:-1]

    if e := ending(DA_STEP1):
        w = w[: -len(e)]
    elif ending(("s",)) and len(w) > 1 and w[-2] in DA_S:
        w = w[:-1]
    pair()
    if w.endswith("igst"):
        w = w[:-2]
    if ending(("løst",)):
        w = w[:-1]
    elif e := ending(DA_STEP3):
        w = w[: -len(e)]
        pair()
    if len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø":
        w = w[:-1]
    return w


STEMMERS = {"en": english, "da": danish}


def stems(terms: DataFrame, lang: str = "en") -> DataFrame:
    """term, stem of distinct terms."""
    stem = STEMMERS[lang]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("term").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([stem(w) for w in words], pa.string())], ["term", "stem"])

    return terms.select("term").distinct().mapInArrow(run, "term string, stem string")
