from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphgrid.functions import terms
from glyphgrid.functions import words as word_rules
from glyphgrid.functions.analysis import ASCII_FOLDING, LOWERCASE, STANDARD, STANDARD_TOKENIZER, Analyzer, Grams, TokenFilter, Tokenizer
from glyphgrid.functions.folding import TABLE, fold_text
from glyphgrid.functions.similarity import Bm25, TfIdf, length_code
from glyphgrid.functions.words import words

FRONT, BACK, ANY = Grams(2, 3, "front"), Grams(2, 3, "back"), Grams(2, 3)
STD = Tokenizer()
CASES = [
    (Analyzer(STD), "Down the river, past two Mills; home!", [(w, i + 1) for i, w in enumerate("Down the river past two Mills home".split())]),
    (Analyzer(STD), "こんにちは、ハチ公！", [(w, i + 1) for i, w in enumerate(["こ", "ん", "に", "ち", "は", "ハチ", "公"])]),
    (Analyzer(STD), "can't 3.14 a_b _ x:y 1,000;2 l’eau ..", [(w, i + 1) for i, w in enumerate(["can't", "3.14", "a_b", "x:y", "1,000;2", "l’eau"])]),
    (Analyzer(Tokenizer("standard", ANY)), "hello", [(g, 1) for g in "he hel el ell ll llo lo".split()]),
    (Analyzer(Tokenizer("standard", FRONT)), "hello world", [("he", 1), ("hel", 1), ("wo", 2), ("wor", 2)]),
    (Analyzer(Tokenizer("standard", Grams(2, 1000, "front"))), "hello", [(g, 1) for g in "he hel hell hello".split()]),
    (Analyzer(Tokenizer("standard", BACK)), "hello world", [("lo", 1), ("llo", 1), ("ld", 2), ("rld", 2)]),
    (Analyzer(STD, (TokenFilter("grams", ANY),)), "hello", [(g, 1) for g in "he hel el ell ll llo lo".split()]),
    (Analyzer(STD, (TokenFilter("grams", Grams(20, 20)),)), "hello", []), (Analyzer(STD, (TokenFilter("grams", Grams(0, 0)),)), "hello", []), (Analyzer(STD, (TokenFilter("grams", Grams(20, 5)),)), "hello", []),
    (Analyzer(STD, (TokenFilter("grams", Grams(3, 1)),)), "hello", [("hel", 1)]),
    (Analyzer(STD, (LOWERCASE,)), "Hulk SMASH ハチ公 Test", [("hulk", 1), ("smash", 2), ("ハチ", 3), ("公", 4), ("test", 5)]),
    (Analyzer(STD, (ASCII_FOLDING,)), "Ĥéllø Ａ i⁹ straße Æon", [("Hello", 1), ("A", 2), ("i", 3), ("9", 4), ("strasse", 5), ("AEon", 6)]),
    (STANDARD, "", []), (STANDARD, "ĤÉLLØ", [("hello", 1)]), (Analyzer(Tokenizer("lowercase")), "ABC d", [("abc", 1), ("d", 2)]),
]


def test_analyzers_in_spark_and_on_the_driver(spark):
    for analyzer, text, want in CASES:
        assert analyzer.tokens_of(text) == want, text
        row = spark.createDataFrame([(text,), (None,)], "x string").select(analyzer.tokens(F.col("x")).alias("t")).collect()
        assert [(t["term"], t["position"]) for t in row[0]["t"]] == want, text
        assert row[1]["t"] is None


def test_graphemes_stay_whole(spark):
    word = "u̇" + "\U0001f468‍\U0001f469" + "e"
    assert Grams(2, 2).of_text(word) == ["u̇\U0001f468‍\U0001f469", "\U0001f468‍\U0001f469e"]
    assert Grams(2, 2).of_text("u̇ab") == ["u̇a", "ab"]


#: Texts and their words by the default rules of UAX #29.
BOUNDARIES = [
    ("a\u00adb", ["a\u00adb"]), ("l‘eau d’été", ["l‘eau", "d’été"]), ("a․b", ["a․b"]), ("1٬2", ["1٬2"]), ('א"ב', ['א"ב']), ("א'", ["א'"]), ('א"', ["א"]), ("a'", ["a"]), ('a"b', ["a", "b"]),
    ("Ⓐ", ["Ⓐ"]), ("สวัสดี", ["ส", "วั", "ส", "ดี"]), ("ハチ公こん", ["ハチ", "公", "こ", "ん"]), ("ｱｲｳabc", ["ｱｲｳ", "abc"]), ("ab\u200dcd", ["ab\u200dcd"]), ("А.Б. ок", ["А.Б", "ок"]),
    ("a:b a.b a,b a;b", ["a:b", "a.b", "a", "b", "a", "b"]), ("1:2 1.2 1,2 1;2", ["1", "2", "1.2", "1,2", "1;2"]), ("a.1 1.a a1.2b", ["a", "1", "1", "a", "a1.2b"]), ("3a a3", ["3a", "a3"]),
    ("_ __ _a a_ a_b 1_2 カ_a", ["_a", "a_", "a_b", "1_2", "カ_a"]), ("a..b", ["a", "b"]), ("can't", ["can't"]), ("'tis", ["tis"]), ("é e\u0301", ["é", "e\u0301"]), ("a\u0301'\u0301b", ["a\u0301'\u0301b"]),
    ("a\u0308\u200d_", ["a\u0308\u200d_"]), ("क्षि", ["क्षि"]), ("𝒳y", ["𝒳y"]), ("1\ufe0f\u20e3", ["1\ufe0f\u20e3"]), ("\U0001f600 \U0001f1e9\U0001f1ea", []), ("¸ ˂", []), ("½ Ⅷ ٣", ["½", "Ⅷ", "٣"]), ("안녕 세계", ["안녕", "세계"]), ("a\r\nb\nc", ["a", "b", "c"]), ("", []), (" \t", []),
]


def test_word_boundaries(spark):
    got = spark.createDataFrame([(t,) for t, _ in BOUNDARIES], "x string").select("x", STANDARD_TOKENIZER.tokens(F.col("x")).alias("t")).collect()
    assert {r["x"]: [t["term"] for t in r["t"]] for r in got} == dict(BOUNDARIES)
    assert all(words(t) == want for t, want in BOUNDARIES)


FULL = word_rules._Rules(0x10FFFF)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB9_.,:;'’‘ éßǅɏ¸字あカーｱ-\"אבש\u0301\u00ad\u200dั͜А1٢٬\n𝒳𐐀")), max_size=14))
def test_fast_patterns_are_the_full_rules(text):
    full = FULL
    found = (full.hebrew if word_rules._HEBREW.search(text) else full.general).findall(text)
    assert words(text) == [w for w in found if full.alnum.search(w)]


def test_fold_table_in_spark(spark):
    assert len(TABLE) == 1242 and sum(len(v) == 1 for v in TABLE.values()) == 1072
    assert all(v.isascii() for v in TABLE.values())
    assert fold_text("こんにちは क्षि  Ⅷ") == "こんにちは क्षि  Ⅷ" and fold_text("ẛǥ«ﬃ⑾") == 'fG"ffi(11)'
    from glyphgrid.functions.folding import fold

    rows = spark.createDataFrame([(c,) for c in TABLE] + [("".join(TABLE),), ("plain",), (None,)], "x string").select("x", fold(F.col("x")).alias("y")).collect()
    assert all(r["y"] == (None if r["x"] is None else fold_text(r["x"])) for r in rows)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB9_.,:'’ éß字あカー-")), max_size=30), min_size=1, max_size=8))
def test_words_are_the_same_in_both(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(STANDARD.tokens(F.col("x")).alias("t")).collect()
    assert [[(t["term"], t["position"]) for t in r["t"]] for r in rows] == [STANDARD.tokens_of(t) for t in texts]


def test_term_bytes(spark):
    when = datetime.fromisoformat("2016-07-23T16:15:00+01:00")
    cases = [("foo", b"foo"), (True, b"t"), (False, b"f"), (123, b"\x7b" + bytes(7)), (-123, b"\x85" + b"\xff" * 7), (when, bytes.fromhex("0065bf034f380500")), (when.replace(microsecond=123123), bytes.fromhex("f345c1034f380500"))]
    for value, want in cases:
        assert terms.term_of(value) == want
    df = spark.sql("SELECT 123L i, -123L j, timestamp'2016-07-23 15:15:00.123123' t, true b, 'foo' s")
    got = df.select(terms.integer_term(F.col("i")), terms.integer_term(F.col("j")), terms.instant_term(F.col("t")), terms.boolean_term(F.col("b")), terms.text_term(F.col("s"))).first()
    assert [bytes(x) for x in got] == [cases[3][1], cases[4][1], cases[6][1], b"t", b"foo"]
    assert terms.after(b"ab") == b"ac" and terms.after(b"a\xff\xff") == b"b" and terms.after(b"\xff") is None and terms.after(b"") is None


def test_similarity_orders(spark):
    rows = [(2, 40, 100, 10, 5), (1, 40, 100, 10, 5), (1, 40, 100, 10, 10), (1, 40, 100, 20, 5), (1, 100, 100, 20, 5), (1, 40, 1000, 20, 5), (0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "tf int, n bigint, tokens bigint, docs bigint, df bigint")
    columns = [F.col("tf"), length_code(F.col("n")), F.col("tokens"), F.col("docs"), F.col("df")]
    got = df.select(Bm25().score(*columns).alias("b"), TfIdf().score(*columns).alias("t")).collect()
    b, t = [r["b"] for r in got], [r["t"] for r in got]
    assert b[0] > b[1] > b[2] and t[0] > t[1] > t[2] and b[3] > b[4] and b[5] > b[3]
    assert all(x == x and abs(x) < 1e9 for x in b + t)
    codes = spark.createDataFrame([(n,) for n in (0, 1, 2, 16, 7225, 10**9)], "n bigint").select(length_code(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in codes] == [0, 0, 1, 9, 252, 255]


def test_begins_with_covers_the_byte_range(spark):
    df = spark.createDataFrame([(bytearray(x),) for x in (b"a", b"ab", b"abz", b"ac", b"b", b"\xff", b"\xff\xffa")], "term binary")
    pick = lambda p: sorted(bytes(r["term"]) for r in df.where(terms.begins_with(F.col("term"), p)).collect())
    assert pick(b"ab") == [b"ab", b"abz"] and pick(b"\xff") == [b"\xff", b"\xff\xffa"] and len(pick(b"")) == 7


@pytest.mark.parametrize("chain,single", [((LOWERCASE,), True), ((TokenFilter("grams", ANY),), False)])
def test_one_per_position(chain, single):
    assert Analyzer(STD, chain).one_per_position == single


def test_words_of_many_texts_at_once_are_those_of_each(monkeypatch):
    """Every character of the basic plane between letters, digits and underscores, and mixed texts in small groups."""
    import random
    from collections import Counter

    from glyphgrid.functions import words as wording

    def check(texts):
        row, found = wording.split_all(texts)
        got = [Counter() for _ in texts]
        for i, w in zip(row.tolist(), found.to_pylist()):
            got[i][w] += 1
        assert got == [Counter(wording.words(t)) for t in texts]

    plane = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    for before, after in ("ab", "12", "__"):
        check([before + c + after for c in plane])
    rng, letters = random.Random(2), "aZ09__ .,;:'\n-éßɏªº·’‧．²א漢́\U0001f600\U0001d400"
    monkeypatch.setattr(wording, "_AT_ONCE", 40)
    for _ in range(300):
        check(["".join(rng.choices(letters[: rng.choice([14, 22, 30])], k=rng.randrange(30))) for _ in range(rng.randrange(9))])
    # no string is made for a word of these
    monkeypatch.setattr(wording, "words", None)
    row, found = wording.split_all(["The l'été", "", "_", "__x 3.5"])
    assert sorted(zip(row.tolist(), found.to_pylist())) == [(0, "The"), (0, "l'été"), (3, "3.5"), (3, "__x")]
