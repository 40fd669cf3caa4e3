"""Versioned text normalisers and tokenisers as Column builders."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hypomill.errors import ConfigError

#: What separates words: the blanks that Python's str.split() knows.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0  -     　"


def identity(text: Column) -> Column:
    return text


def conservative_english(text: Column) -> Column:
    """Lower case, typewriter apostrophes, everything but letters, digits and apostrophes to one blank.

    Plain JVM expressions, for text whose compatibility form changes no letter or digit (all
    of ASCII and the accented Latin letters). Null stays null.
    """
    straight = F.translate(F.lower(text), "‘’", "''")
    kept = F.regexp_replace(straight, rf"[^\p{{L}}\p{{N}}'{BLANKS}]|[{BLANKS}]+", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; ASCII text passes untouched."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def conservative_english_unicode(text: Column) -> Column:
    """As ``conservative_english`` for any script: compatibility characters are composed first (Arrow)."""
    return conservative_english(nfkc(text))


def whisper_english(text: Column) -> Column:
    """Adapter of an external English normaliser, in Arrow batches; raises where it is not installed."""
    try:
        from whisper.normalizers import EnglishTextNormalizer
    except ImportError as error:
        raise ConfigError("this normalizer needs its external package") from error
    normal = EnglishTextNormalizer()

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else normal(x).strip())

    return run(text)


_REGISTRY: dict[str, Callable[[Column], Column]] = {
    "identity@v1": identity,
    "conservative-english@v1": conservative_english_unicode,
    "conservative-english-latin@v1": conservative_english,
}


def register_normalizer(normalizer_id: str, build: Callable[[Column], Column]) -> None:
    """Add a normaliser; an id names one text form for ever, so it cannot be replaced."""
    if normalizer_id in _REGISTRY:
        raise ConfigError(f"normalizer id is taken: {normalizer_id}")
    _REGISTRY[normalizer_id] = build


def normalizer(normalizer_id: str) -> Callable[[Column], Column]:
    if normalizer_id in _REGISTRY:
        return _REGISTRY[normalizer_id]
    if normalizer_id.startswith("openai-whisper-english@"):
        return whisper_english
    raise ConfigError(f"unknown normalizer id: {normalizer_id}")


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda t: t != "")


def char_tokens(text: Column) -> Column:
    """Code points without U+0020; other blanks count."""
    return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda t: t != "")
