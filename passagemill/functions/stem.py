"""English stems (the published Porter2 rules) for batches of lexemes."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

V = "aeiouy"

# Fixed values of the Porter2 rules.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_S = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def region(word: str, start: int) -> int:
    found = re.search(rf"[{V}][^{V}]", word[start:])
    return start + found.end() if found else len(word)


def short(word: str) -> bool:
    return bool(re.search(rf"(^[{V}][^{V}]|[^{V}][{V}][^{V}wxY])$", word))


def longest(word: str, endings) -> str:
    return max((ending for ending in endings if word.endswith(ending)), key=len, default="")


@lru_cache(maxsize=200_000)
def english_stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub(rf"(^|[{V}])y", r"\1Y", word.lstrip("'"))
    special = re.match("gener|commun|arsen", word)
    r1 = special.end() if special else region(word, 0)
    r2 = region(word, r1)

    # Possessives and plurals.
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{V}]", word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_S:
        return word

    # Past and progressive forms.
    ending = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    stem = word[: len(word) - len(ending)]
    if ending in ("eed", "eedly"):
        word = stem + "ee" if len(stem) >= r1 else word
    elif ending and re.search(f"[{V}]", stem):
        word = stem
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and short(word):
            word += "e"
    if len(word) > 2:
        word = re.sub(rf"(?<=[^{V}])[yY]$", "i", word)

    # Derivational endings.
    ending = longest(word, [*STEP_2, "ogi", "li"])
    if ending and len(word) - len(ending) >= r1:
        stem = word[: len(word) - len(ending)]
        if ending in STEP_2:
            word = stem + STEP_2[ending]
        elif ending == "ogi" and stem.endswith("l"):
            word = stem + "og"
        elif ending == "li" and stem[-1:] in tuple("cdeghkmnrt"):
            word = stem
    ending = longest(word, [*STEP_3, "ative"])
    if ending and len(word) - len(ending) >= r1:
        stem = word[: len(word) - len(ending)]
        if ending in STEP_3:
            word = stem + STEP_3[ending]
        elif len(stem) >= r2:
            word = stem
    ending = longest(word, [*STEP_4, "ion"])
    stem = word[: len(word) - len(ending)]
    if ending and len(stem) >= r2 and (ending != "ion" or stem.endswith(("s", "t"))):
        word = stem

    # Final e and l.
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def english(terms: Column) -> Column:
    """Stems of an array of terms: each distinct term of an Arrow batch is stemmed once."""

    def kernel(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        stems = pa.array([english_stem(word) for word in words.dictionary.to_pylist()], pa.string())
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), stems.take(words.indices))

    return F.arrow_udf(kernel, "array<string>").asNondeterministic()(terms)


def identity(terms: Column) -> Column:
    return terms
