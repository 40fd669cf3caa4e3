import pytest
from pyspark.sql import functions as F

from hypomill.errors import ConfigError
from hypomill.functions import text as X


@pytest.mark.parametrize("raw,want", [
    ("  I'VE  got  2 apples... ", "i've got 2 apples"), ("U.S.A.\tand Mr. Smith", "u s a and mr smith"), ("A’T  word---spacing", "a't word spacing"),
    ("Numbers 10 and 42 stay numeric", "numbers 10 and 42 stay numeric"), ("snake_case", "snake case"), ("", ""), (None, None), ("Ünï　code", "ünï code"),
])
def test_conservative(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    for build in (X.conservative_english, X.conservative_english_unicode):
        assert df.select(build(F.col("t"))).first()[0] == want


def test_compatibility_forms_need_the_unicode_form(spark):
    df = spark.createDataFrame([("ﬁne ２",)], "t string")
    assert df.select(X.conservative_english_unicode(F.col("t"))).first()[0] == "fine 2"


def test_identity(spark):
    assert spark.createDataFrame([(" Raw, Text! ",)], "t string").select(X.normalizer("identity@v1")(F.col("t"))).first()[0] == " Raw, Text! "


def test_tokens(spark):
    row = spark.createDataFrame([("a  b\tc d",)], "t string").select(X.word_tokens(F.col("t")), X.char_tokens(F.col("t"))).first()
    assert row[0] == ["a", "b", "c", "d"] and row[1] == ["a", "b", "\t", "c", "d"]
    assert spark.createDataFrame([("",)], "t string").select(X.char_tokens(F.col("t"))).first()[0] == []


def test_registry():
    with pytest.raises(ConfigError):
        X.normalizer("unknown@v1")
    with pytest.raises(ConfigError):
        X.register_normalizer("identity@v1", X.identity)
    with pytest.raises(ConfigError):
        X.normalizer("openai-whisper-english@1")(None)
