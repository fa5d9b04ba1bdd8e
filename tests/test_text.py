import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import dates, fuzzy, language
from textloom.functions import text as tx

_SAME = ("This is another sentence.", "And a third sentence.")
T1 = " ".join(["This is a sentence.", *_SAME, "And yet a fourth sentence."])
T2 = " ".join(["This is a different sentence.", *_SAME, "But the fourth sentence is different too."])


URL = "http://www." + "example.com?test=asdf"


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr.alias("x")).first()[0]


def test_has_fragment(spark):
    df = spark.createDataFrame([("Où est le café", "cafe"), ("plain", "lai"), ("no", "yes"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(tx.has_fragment("a", "b")).collect()] == [True, True, False, None]


def test_remove_fragments(spark):
    assert one(spark, "testing one two three", tx.remove_fragments("t", ["one two ", "missing"])) == "testing three"
    assert one(spark, "gone", tx.remove_fragments("t", ["gone"])) == "gone"
    assert one(spark, "le café noir", tx.remove_fragments("t", ["cafe "])) == "le noir"
    assert one(spark, "café noir", tx.remove_fragments("t", ["zzz"])) == "café noir"


def test_contractions(spark):
    stems = ["would", "should", "could", "does", "do"]
    text = " ".join(["won't", *(f"{w}n't" for w in stems)])
    assert one(spark, text, tx.clean("t")) == " ".join(f"{w}_not" for w in ["will", *stems])


@pytest.mark.parametrize(
    "text, options, want",
    [
        (URL, {}, ""),
        (URL, {"remove_urls": False}, "http www example com test asdf"),
        ("<html>" "<body></body>" "</html>", {"html": True}, ""),
        ("Test One Two Three", {"lowercase": False, "stop_words": ["one", "two", "three"]}, "Test"),
        ("the of and ok", {"stop_words": []}, "the and"),
        ("abc a1b2 x99 word", {}, "abc word"),
        ("they're walking we've", {"stop_words": []}, "they are walking have"),
        ("swap me", {"replacers": [("swap", "changed")]}, "changed"),
    ],
)
def test_cleaner(spark, text, options, want):
    assert one(spark, text, tx.clean("t", **options)) == want


def test_cleaner_stems_and_null(spark):
    assert one(spark, "running ponies", tx.clean("t", process=language.stem_words)) == "run poni"
    assert one(spark, None, tx.clean("t")) is None


def test_sentences(spark):
    assert one(spark, T1, tx.sentences("t")) == T1.replace(". ", ".|").split("|")
    assert one(spark, "Short. A longer sentence here.", tx.sentences("t", 10)) == ["A longer sentence here."]
    assert one(spark, "one; two; three", tx.sentences("t", trailing="(;)")) == ["one;", "two;", "three"]
    assert one(spark, "one; two; three", tx.sentences("t", trailing=";")) == ["one", "two", "three"]
    assert one(spark, "a - b - c", tx.sentences("t", leading="(-)")) == ["a", "- b", "- c"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(tx.ngrams(F.col("w"), 1, 3)).collect()] == [["a", "b", "c", "a b", "b c", "a b c"], ["x"], []]


def test_overlaps(spark):
    df = spark.createDataFrame([(T1, T2)], "a string, b string")
    assert set(df.select(fuzzy.text_overlaps("a", "b", 10)).first()[0]) == set(_SAME)
    assert df.select(fuzzy.text_overlaps("a", "b", 10, tokenize=False)).first()[0] == [f" sentence. {' '.join(_SAME)} ", " fourth sentence"]
    assert df.select(fuzzy.largest_overlap("a", "b")).first()[0] == f" sentence. {' '.join(_SAME)} "


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert fuzzy.lcs_length(a, b) == row[-1]


def test_ratios(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("same", "same"), ("", ""), (None, "x"), ("bc", "abcd")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.fuzzy_ratio("a", "b")).collect()] == [75.0, 100.0, 100.0, None, pytest.approx(200 / 3)]
    assert [r[0] for r in df.select(fuzzy.fuzzy_partial_ratio("a", "b")).collect()] == [75.0, 100.0, 100.0, None, 100.0]
    assert [r[0] for r in df.select(fuzzy.edit_ratio("a", "b")).collect()] == [75.0, 100.0, 100.0, None, 50.0]
    assert fuzzy.partial_ratio_value("ab" * 50, "xy" * 4000, timeout=0) is None


def test_dates(spark):
    text = " and ".join(["January 1, 2018", "02/01/2019", "Mar. 1st 2020 at 10:30"])
    got = one(spark, text, dates.find_dates("t", "2017-01-01", "2021-01-01"))
    assert {d.ts.date() for d in got} == {dt.date(2018, 1, 1), dt.date(2019, 2, 1), dt.date(2020, 3, 1)}
    assert one(spark, text, dates.find_dates("t", "2019-01-01", "2019-12-31"))[0].raw == "02/01/2019"
    assert one(spark, "nothing in May", dates.find_dates("t")) == []


@pytest.mark.parametrize("word, want", [("consigned", "consign"), ("knightly", "knight"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("skies", "sky"), ("generously", "generous"), ("happy", "happi"), ("ties", "tie"), ("national", "nation"), ("cats", "cat")])
def test_stem(word, want):
    assert language.stem(word) == want


def test_parts_of_speech(spark):
    assert one(spark, "The old Paris is quickly running home", language.filter_parts_of_speech("t")) == "old Paris home"
    assert "Paris" not in one(spark, "The old Paris is big", language.filter_parts_of_speech("t", ["NNP"], exclude=True))
    assert one(spark, "a b", language.filter_parts_of_speech("t", ["X"], tagger=lambda ws: ["X" if w == "b" else "Y" for w in ws])) == "b"


def test_entities(spark):
    got = one(spark, "They say that Ann Smith met the State University of Ohio. Ann Smith left Orange County.", language.named_entities("t"))
    assert got["PERSON"] == ["Ann Smith"] and got["ORGANIZATION"] == ["State University of Ohio"] and got["GPE"] == ["Orange County"]
    assert one(spark, "x", language.named_entities("t", [lambda t: [("ORG", "A")], lambda t: [("ORGANIZATION", "B")]])) == {"ORGANIZATION": ["A", "B"]}


def test_probable_stopwords(spark):
    words = spark.createDataFrame([("the",), ("whale",), ("thing",), ("zzz",)], "word string")
    lexicon = spark.createDataFrame([("the", 1, 3, 9), ("whale", 2, 4, 9), ("thing", 2, 6, 1)], "word string, n_synsets int, min_depth int, max_lemma int")
    assert {r.word: r.is_stopword for r in language.probable_stopwords(words, lexicon).collect()} == {"the": True, "whale": False, "thing": True, "zzz": True}


def test_common_subsequences_against_a_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(2))
        if rng.random() < 0.3:
            b = a[:5] + b + a[-4:]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert fuzzy.lcs_length(a, b) == row[-1]
        least = rng.randrange(0, 35)
        assert fuzzy.lcs_length(a, b, least) == row[-1] or row[-1] < least > fuzzy.lcs_length(a, b, least)


def test_words_by_table(spark):
    docs = spark.createDataFrame([(1, "The cats saw New York"), (2, "nothing known"), (3, None), (4, "")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("cats", "NN", "cat"), ("cats", "VB", "cat"), ("Saw", "VB", "see"), ("the", "DT", "the")], "word string, tag string, lemma string")
    assert {r.doc_id: r.text for r in language.lemmatise(docs, "doc_id", "text", lexicon).collect()} == {1: "the cat see new york", 2: "nothing known"}
    assert {r.doc_id: r.text for r in language.filter_tags(docs, "doc_id", "text", lexicon).collect()} == {1: "cats"}
    assert {r.doc_id: r.text for r in language.filter_tags(docs, "doc_id", "text", lexicon, ["NN"], exclude=True).collect()} == {1: "The saw New York", 2: "nothing known"}
    names = spark.createDataFrame([("New York", "GPE"), ("York", "PERSON"), ("york", "PERSON")], "name string, kind string")
    assert {tuple(r) for r in language.entities_by_table(docs, "doc_id", "text", names).collect()} == {(1, "GPE", "New York"), (1, "PERSON", "York")}


def test_runs_of_words(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (None,)], "w array<string>")
    got = [r[0] for r in df.select(tx.ngrams(F.col("w"), 1, 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], [], None]


def test_equal_dates_are_parsed_once():
    dates.parse.cache_clear()
    for _ in range(50):
        found = dates.find_dates_value(["May 4, 1996", "06/13/1996"], None, None)
    assert [d for d, _ in found] == [dt.datetime(1996, 5, 4), dt.datetime(1996, 6, 13)] and dates.parse.cache_info().misses == 2
