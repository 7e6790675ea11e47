"""Text normalisers for recognition and synthesis over whole columns: built-ins, with Arrow UDFs for readings."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import readings as R
from .numbers import NE_POINT, NE_SMALL, NUMBER, digit_words, english_number, nepali_integer, nepali_number
from .text import DEVANAGARI_DIGITS, PLAIN_SIGNS, SIGNS, SPACES, ZERO_WIDTH, collapsed

_DIGITS = str.maketrans(DEVANAGARI_DIGITS, "0123456789")
_PLAIN = str.maketrans(SIGNS + DEVANAGARI_DIGITS, PLAIN_SIGNS + "0123456789", ZERO_WIDTH)
_NOT_PLAIN = re.compile(f"[{re.escape(SIGNS + DEVANAGARI_DIGITS + ZERO_WIDTH)}]")
_ALL_SPACES = SPACES.replace("[", "[\\u001C-\\u001F", 1)


def composed(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


@F.pandas_udf(T.StringType())
def numbers_read(texts: pd.Series, langs: pd.Series) -> pd.Series:
    """Composed text with plain signs and its numbers in words, Nepali for ne-NP and else English."""

    def one(text: str | None, lang: str | None) -> str | None:
        if text is None:
            return None
        say = nepali_number if lang == "ne-NP" else english_number
        text = composed(text)
        return NUMBER.sub(lambda m: f" {say(m[0])} ", text.translate(_PLAIN) if _NOT_PLAIN.search(text) else text)

    return pd.Series([one(t, v) for t, v in zip(texts, langs, strict=True)], dtype=object)


def asr_normalized(text: Column, lang: Column, kept: str | None = None) -> Column:
    """Composed, folded, numbers in words, lower case, blanks collapsed. kept is a regex class of representable
    characters, the others become blanks; None for all. Null stays null."""
    low = F.lower(numbers_read(text, lang))
    return collapsed(F.regexp_replace(low, f"[^{kept} ]+", " ") if kept else low, _ALL_SPACES)


_SYLLABLE = re.compile(f"(?:(?P<cluster>{'|'.join(R.CLUSTERS)})|(?P<single>[{''.join(R.CONSONANTS)}]))?(?P<vowel>{'|'.join(R.VOWEL_SIGNS)})?")
_SPELLED = re.compile("[A-Z]{1,5}|[B-DF-HJ-NP-TV-Z]+")


def _syllable(m: re.Match) -> str:
    vowel, onset = m["vowel"], R.CLUSTERS.get(m["cluster"]) or R.CONSONANTS.get(m["single"])
    if onset is None:
        return R.VOWEL_LETTERS.get(vowel, "")
    return onset + (R.VOWEL_SIGNS[vowel] if vowel else R.HALANT if m["single"] else "")


def transliterated(word: str) -> str:
    """Latin word in Devanagari, syllable by syllable: a consonant or cluster, and a vowel; either may lack. A single
    consonant without a vowel takes a halant, but not at the end."""
    return _SYLLABLE.sub(_syllable, word.lower()).removesuffix(R.HALANT)


def is_acronym(word: str) -> bool:
    """Capitals only, and few or without a vowel."""
    return _SPELLED.fullmatch(word) is not None


def number_read(digits: str) -> str:
    """Seven digits and more are read one by one."""
    plain = digits.translate(_DIGITS)
    return nepali_integer(int(plain)) if len(plain) < 7 else digit_words(plain, NE_SMALL)


def latin_read(word: str) -> str:
    return " ".join(map(R.LETTER_NAMES.get, word.lower())) if is_acronym(word) else transliterated(word)


class Reader:
    """One scan over a text; each kind of token has its reading.

    A token of letters and digits is in the lexicon, or is read by its runs of letters and of digits. With keep_latin
    tokens of Latin letters alone stay and phrases are not replaced, but letters beside digits are read.
    """

    def __init__(self, keep_latin: bool = False, lexicon: dict[str, str] = R.LEXICON) -> None:
        self.keep_latin, self.lexicon = keep_latin, lexicon
        self.known = lru_cache(1 << 16)(self.token)
        phrases = [] if keep_latin else sorted((p for p in lexicon if " " in p), key=len, reverse=True)
        phrase = "(?i:" + "|".join(map(re.escape, phrases)) + ")" if phrases else "(?!)"
        decimal = "[0-9०-९]+[.][0-9०-९]+"
        plain = f"(?!{phrase}|{decimal})"
        self.scanner = re.compile(f"(?P<phrase>{phrase})|(?P<decimal>{decimal})|(?P<token>(?:{plain}[A-Za-z0-9])+|(?:{plain}[०-९])+)")
        self.signs = str.maketrans(dict.fromkeys(R.BLANKS, " ") | {s: f" {w} " for s, w in R.SYMBOL_WORDS.items()} | R.PLAIN)
        self.unsafe = re.compile("[^" + re.escape("".join(sorted(R.SAFE))) + ("A-Za-z" if keep_latin else "") + "]+")

    def token(self, word: str) -> str:
        if self.keep_latin and word.isascii() and word.isalpha():
            return word
        if (known := self.lexicon.get(word.lower())) is not None:
            return known
        runs = [x for x in re.split("([0-9०-९]+)", word) if x]
        return " ".join(number_read(x) if x.isdecimal() else self.lexicon.get(x.lower()) or latin_read(x) for x in runs)

    def reading(self, m: re.Match) -> str:
        if m.lastgroup == "token":
            return self.known(m[0])
        if m.lastgroup == "phrase":
            return self.lexicon[m[0].lower()]
        whole, part = m[0].split(".")
        return f"{number_read(whole)} {NE_POINT} {digit_words(part.translate(_DIGITS), NE_SMALL)}"

    def read(self, text: str) -> str:
        """Everything a speaker would say, in representable characters only; Latin glosses in brackets go."""
        plain = re.sub(r"[(\[{][A-Za-z0-9 .,'&-]*[)\]}]", " ", composed(text)).translate(self.signs)
        return " ".join(self.unsafe.sub("", self.scanner.sub(self.reading, plain)).split())


@cache
def reader(keep_latin: bool) -> Reader:
    return Reader(keep_latin)


def synthesis_text(text: str, keep_latin: bool = False) -> str:
    return reader(keep_latin).read(text)


def tts_normalized(text: Column, keep_latin: bool = False) -> Column:
    """Reader.read of a column; null as empty."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: synthesis_text(t or "", keep_latin))

    return run(text)


def asserted_clean(text: Column, kept_class: str) -> Column:
    """The text, or an error where a character outside the class is left."""
    return F.when(text.rlike(f"[^{kept_class}]"), F.raise_error(F.concat(F.lit("not representable: "), text))).otherwise(text)
