"""Tokens of keyword search as expressions: classes of tokens and a suffix-stripping stemmer.

A configuration names how an index cuts its texts; questions to it are cut alike. ``simple`` keeps runs of
letters and digits. ``compound`` keeps addresses, file paths and hyphenated words whole too, beside their
parts. ``english`` is ``compound`` with stems by Porter's published algorithm (1980). Null has no tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.functions.arrays import bound
from lodeframe.functions.text import fts_words

CONFIGS = ("simple", "compound", "english")

_WORD = r"[\p{L}\p{N}]+"
_HOST = r"[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
#: An address with or without its scheme, a file path, a hyphenated word, a word; the first that fits counts.
TOKEN = rf"(?U)(?:\p{{L}}[\p{{L}}\p{{N}}+.-]*://[^\s/?#]+|{_HOST})(?:[/?#][^\s,;<>\"']*)?|(?:~|\.\.?)?(?:/[\p{{L}}\p{{N}}_.-]+){{2,}}|{_WORD}(?:-{_WORD})+|{_WORD}"

# fixed values: the suffixes of the algorithm's steps 2, 3 and 4
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: A run of consonants and one of vowels; y is a vowel behind a consonant, so never at a word's start.
_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy][aeiou]*"
_HEAD = f"^(?:{_C}|(?=[aeiou]))"
_SOME = f"{_HEAD}{_V}{_C}"
_ONE = f"{_HEAD}{_V}{_C}(?:{_V})?$"
_TWO = f"{_HEAD}{_V}{_C}{_V}{_C}"
_VOWEL = f"{_HEAD}[aeiouy]"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _plural(w: Column) -> Column:
    return F.when(w.rlike("(?:ss|i)es$"), _cut(w, 2)).when(w.rlike("[^s]s$"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    def mended(s: Column) -> Column:
        twice = s.rlike(r"([^aeiouylsz])\1$")
        return F.when(s.rlike("(?:at|bl|iz)$"), F.concat(s, F.lit("e"))).when(twice, _cut(s, 1)).when(s.rlike(_CVC), F.concat(s, F.lit("e"))).otherwise(s)

    eed = F.when(_cut(w, 3).rlike(_SOME), _cut(w, 1)).otherwise(w)
    stem = F.regexp_replace(w, "(?:ed|ing)$", "")
    return F.when(w.endswith("eed"), eed).when(w.rlike("(?:ed|ing)$") & stem.rlike(_VOWEL), bound(stem, mended)).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _mapped(table: dict[str, str]):
    """The longest suffix of ``table`` is replaced behind a stem that has a vowel and a consonant after it."""
    pattern = f"^(.+?)({'|'.join(table)})$"
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))

    def step(w: Column) -> Column:
        stem, end = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
        return F.when(stem.rlike(_SOME), F.concat(stem, F.try_element_at(pairs, end))).otherwise(w)

    return step


def _bare(w: Column) -> Column:
    stem, end = (F.regexp_extract(w, f"^(.+?)({'|'.join(STEP4)})$", i) for i in (1, 2))
    return F.when(stem.rlike(_TWO) & ((end != "ion") | stem.rlike("[st]$")), stem).otherwise(w)


def _last_e(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.endswith("e") & (stem.rlike(_TWO) | stem.rlike(_ONE) & ~stem.rlike(_CVC)), stem).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _cut(w, 1).rlike(_TWO), _cut(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word of three or more of the letters a to z; other words stay."""
    steps = (_plural, _past, _last_y, _mapped(STEP2), _mapped(STEP3), _bare, _last_e, _last_l)
    return F.when(word.rlike("^[a-z]{3,}$"), reduce(bound, steps, word)).otherwise(word)


def _parts(token: Column) -> Column:
    """A token and what it is made of: an address gives itself without a scheme, its host and the path behind it, a
    hyphenated word itself and its words, a file path itself."""
    address = F.regexp_replace(token, r"^[^/?#]*?://", "")
    host, rest = F.regexp_extract(address, "^[^/?#]+", 0), F.regexp_extract(address, "[/?#].*$", 0)
    is_address = token.contains("://") | token.rlike(rf"(?U)^{_HOST}(?:[/?#]|$)")
    of_address = F.array_distinct(F.filter(F.array(address, host, rest), lambda x: x.rlike(r"(?U)[\p{L}\p{N}]")))
    hyphened = F.concat(F.array(token), F.split(token, "-"))
    return F.when(is_address, of_address).when(token.contains("/"), F.array(token)).when(token.contains("-"), hyphened).otherwise(F.array(token))


def tokens(text: Column, config: str = "simple") -> Column:
    """The tokens of a text in their order, lower-cased."""
    if config not in CONFIGS:
        raise ValueError(f"text configuration must be one of {', '.join(CONFIGS)}")
    if config == "simple":
        return fts_words(text)
    raw = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    every = F.flatten(F.transform(raw, _parts))
    return F.transform(every, stem) if config == "english" else every
