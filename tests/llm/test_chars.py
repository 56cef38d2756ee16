import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm import chars, plain


@pytest.mark.parametrize(
    "text, clean, kinds",
    [
        ("ｔｈｉｓ", "this", ["compatibility"]),
        ("𝐭𝐡𝐢𝐬 soup", "this soup", ["compatibility"]),
        ("ﬁne oﬀer", "fine offer", ["compatibility"]),
        ("ﾃｰﾌﾟを", "テープを", ["compatibility"]),
        ("ﾄﾞｱ", "ドア", ["compatibility"]),
        ("ﻻ شيء", "لا شيء", ["compatibility"]),
        ("No １２", "No 12", ["compatibility"]),
        ("豈", "豈", ["compatibility"]),
        ("māori", "māori", ["decomposed"]),
        ("a​cross", "across", ["invisible"]),
        ("﻿so", "so", ["invisible"]),
        ("so­ft", "soft", ["invisible"]),
        ("by the way　x", "by the way x", ["space"]),
        ("thіs frоm", "this from", ["script"]),
        ("beyοnd", "beyond", ["script"]),
        ("Наша грyппа слушала", "Наша группа слушала", ["script"]),
        ("Η ομάδα τoν άκουσε", "Η ομάδα τον άκουσε", ["script"]),
        ("they saw the осе near here", "they saw the oce near here", ["script"]),
        ("they wrote раура1 there", "they wrote paypa1 there", ["script"]),
        ("the ԼBC tape", "the ԼBC tape", []),
        ("ցoogle it", "google it", ["script"]),
        ("an Ꭺpple", "an Apple", ["script"]),
        ("an ɑpple", "an apple", ["script"]),
        ("ⲟne more", "one more", ["script"]),
        ("a ꓬes from us", "a Yes from us", ["script"]),
    ],
)
def test_cases(text, clean, kinds):
    assert chars.kinds(text) == kinds
    assert chars.consistent(text) == clean
    assert chars.kinds(clean) == []


@pytest.mark.parametrize(
    "text",
    [None, "", "plain", "é Māori", "½ cup… “yes” ‘no’ «x» „y“", "👨‍👩‍👧 👩🏽‍🏫", "दर्‍या का", "น้ำในถัง", "v2.1版の橋（2番目の）", "a\tb\r\nc", "версия 2 и я с ним", "κατά 3 p.m. εδώ", "テープと二つ", "А1 и Б2 в плане", "said [ɡɑt] twice", "Նա ասաց ո՛չ to us", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ in Tsalagi", "ışık ve ağaç", "日本語とEnglish", "ー一ニ二"],
)
def test_not_cases(text):
    assert chars.kinds(text) == [] and chars.consistent(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_settles(text):
    once = chars.consistent(text)
    assert chars.consistent(once) == once


def test_tables(spark):
    rows = [(1, "thіs", "a"), (1, "thіs", "a"), (2, None, "a"), (3, "", "b"), (4, "plain", "b"), (5, "x" * 200_000 + "​", "c")]
    df = spark.createDataFrame(rows, "id int, text string, clean string")
    got = {x["id"]: (x["clean"], x["kinds"]) for x in chars.unify_values(df).collect()}
    assert got[1] == ("this", ["script"]) and got[2] == (None, []) and got[5] == ("x" * 200_000, ["invisible"]) and got[4] == ("plain", [])
    assert chars.unify_values(df).count() == 6
    v = df.select(F.lit("t").alias("src"), F.col("id").cast("string").alias("row_key"), F.lit("text").alias("field"), "text")
    assert sorted(x["row_key"] for x in chars.affected_values(v).collect()) == ["1", "5"]
    assert chars.affected_values(v.limit(0)).count() == 0


def test_plain_words():
    assert plain.plain_words("Joud-\nundell um, U:m (0.8) ah:m o'clock [x ((y))] *clears throat* &=sighs Erm; errm thіs @@@ mm hmm") == ["joudundell", "oclock", "this"]
    assert plain.plain_words(None) == plain.plain_words("") == plain.plain_words(" \n") == []
    assert plain.words("谢谢大家。テープ v2") == ["谢", "谢", "大", "家", "テ", "ー", "プ", "v2"]
    assert [w for w in ("um", "umm", "uh", "uhhh", "er", "erm", "ah", "ahm", "hm", "hmm", "mm", "mmm") if not plain.is_filler(w)] == []
    assert not any(map(plain.is_filler, ("m", "oh", "her", "ham", "us")))
