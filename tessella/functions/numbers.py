"""Numbers as words, in English and Nepali, and the kind of a number token."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import DEVANAGARI_DIGITS, ascii_digits

# Number words. Nepali has its own word for every number below 100.
EN_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_SCALE = [(10**9, "billion"), (10**6, "million"), (10**3, "thousand"), (100, "hundred")]
NE_SMALL = """
शून्य एक दुई तीन चार पाँच छ सात आठ नौ
दस एघार बाह्र तेह्र चौध पन्ध्र सोह्र सत्र अठार उन्नाइस
बीस एक्काइस बाइस तेइस चौबिस पच्चिस छब्बिस सत्ताइस अठ्ठाइस उनन्तिस
तीस एकतिस बत्तिस तेत्तिस चौँतिस पैँतिस छत्तिस सैँतिस अठतिस उनन्चालिस
चालिस एकचालिस बयालिस त्रिचालिस चवालिस पैँतालिस छयालिस सच्चालिस अठचालिस उनन्चास
पचास एकाउन्न बाउन्न त्रिपन्न चवन्न पचपन्न छपन्न सन्ताउन्न अन्ठाउन्न उनान्साठी
साठी एकसट्ठी बयसट्ठी त्रिसट्ठी चौंसट्ठी पैंसट्ठी छयसट्ठी सतसट्ठी अठसट्ठी उनन्सत्तरी
सत्तरी एकहत्तर बहत्तर त्रिहत्तर चौहत्तर पचहत्तर छयहत्तर सतहत्तर अठहत्तर उनासी
असी एकासी बयासी त्रियासी चौरासी पचासी छयासी सतासी अठासी उनान्नब्बे
नब्बे एकानब्बे बयानब्बे त्रियानब्बे चौरानब्बे पन्चानब्बे छयानब्बे सन्तानब्बे अन्ठानब्बे उनान्सय
""".split()
NE_SCALE = [(10**7, "करोड"), (10**5, "लाख"), (10**3, "हजार"), (100, "सय")]
NE_POINT = "दशमलव"

NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_TO_ASCII = str.maketrans(DEVANAGARI_DIGITS, "0123456789")


def _in_words(n: int, small, scale: list[tuple[int, str]]) -> str:
    parts = []
    for value, name in scale:
        if n >= value:
            count, n = divmod(n, value)
            parts += [_in_words(count, small, scale), name]
    if n or not parts:
        parts.append(small(n))
    return " ".join(parts)


def _english_below_hundred(n: int) -> str:
    if n < 20:
        return EN_SMALL[n]
    return EN_TENS[n // 10 - 2] + (f" {EN_SMALL[n % 10]}" if n % 10 else "")


def english_integer(n: int) -> str:
    return _in_words(n, _english_below_hundred, EN_SCALE)


def nepali_integer(n: int) -> str:
    return _in_words(n, NE_SMALL.__getitem__, NE_SCALE)


def digit_words(digits: str, words: list[str]) -> str:
    return " ".join(words[int(c)] for c in digits if "0" <= c <= "9")


def english_number(token: str) -> str:
    """Decimals by 'point'; seven and more digits, or a leading zero, digit by digit."""
    whole, point, part = token.partition(".")
    if point:
        return f"{english_number(whole) if whole else EN_SMALL[0]} point {digit_words(part, EN_SMALL)}"
    if len(whole) >= 7 or len(whole) > 1 and whole[0] == "0":
        return digit_words(whole, EN_SMALL)
    return english_integer(int(whole))


def number_kind_of(token: str) -> str:
    token = token.strip().translate(_TO_ASCII)
    if re.fullmatch(r"[0-9]+\.[0-9]+", token):
        return "decimal"
    if not re.fullmatch(r"[0-9]+", token):
        return "not-a-number"
    if len(token) >= 7:
        return "phone/id"
    if len(token) == 4 and 1900 <= int(token) <= 2100:
        return "year-ad"
    if len(token) == 4 and 2101 <= int(token) <= 2199:
        return "year-bs"
    return "cardinal"


def nepali_number(token: str) -> str | None:
    """Reading of a number in either script; None for anything else."""
    kind, token = number_kind_of(token), token.strip().translate(_TO_ASCII)
    if kind == "not-a-number":
        return None
    if kind == "decimal":
        whole, part = token.split(".")
        return f"{nepali_integer(int(whole))} {NE_POINT} {digit_words(part, NE_SMALL)}"
    return digit_words(token, NE_SMALL) if kind == "phone/id" else nepali_integer(int(token))


@F.pandas_udf(T.StringType())
def english_reading(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: english_number(t) if t is not None and NUMBER.fullmatch(t) else None)


@F.pandas_udf(T.StringType())
def nepali_reading(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else nepali_number(t))


def digits_spelled(token: Column, words: list[str]) -> Column:
    """Digit by digit, without Python."""
    table = F.array(*map(F.lit, words[:10]))
    return F.array_join(F.transform(F.split(F.regexp_replace(ascii_digits(token), "[^0-9]", ""), ""), lambda d: F.element_at(table, d.cast("int") + 1)), " ")


def number_kind(token: Column) -> Column:
    """Kind of a number token, as number_kind_of says, without Python."""
    a = F.trim(ascii_digits(token))
    four = (F.length(a) == 4) & a.rlike("^[0-9]+$")
    value = F.when(a.rlike("^[0-9]{1,9}$"), a.cast("int"))
    return (
        F.when(a.rlike("^[0-9]+\\.[0-9]+$"), "decimal")
        .when(~a.rlike("^[0-9]+$"), "not-a-number")
        .when(F.length(a) >= 7, "phone/id")
        .when(four & value.between(1900, 2100), "year-ad")
        .when(four & value.between(2101, 2199), "year-bs")
        .otherwise("cardinal")
    )
