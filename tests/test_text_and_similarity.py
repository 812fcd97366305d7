"""Normalisation, keys and similarities by hand and against plain definitions."""

import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import similarity as M
from kinweave.functions import text as T
from kinweave.functions.indic import transliterate_text


def column(spark, values, f, *more):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, " + ", ".join(f"{c} string" for c in "ab"[: 2 if isinstance(values[0], tuple) else 1]))
    return [r[1] for r in df.select("i", f.alias("x")).orderBy("i").collect()]


def test_norm(spark):
    got = column(spark, ["  Café & Söhne GmbH. ", None, "", "A-1/2, St. -- x.y", "Œuvre Straße’s", "３０ ﬁn"], T.norm("a"))
    assert got == ["cafe and sohne gmbh", "", "", "a-1/2 st x.y", "oeuvre strasse s", "30 fin"]


def test_transliteration():
    assert transliterate_text("राम") == "rAm"
    assert transliterate_text("कमल x") == "kamal x"
    assert transliterate_text("दिल्ली") == "dillI"
    assert transliterate_text("plain") == "plain"
    assert transliterate_text("कॉलोनी") == "kolonI" and transliterate_text("ऍपल ऑफिस") == "epal ophis"
    assert transliterate_text("ਪੰਜਾਬ") == "panjAb" and transliterate_text("ਪੱਕਾ ਮੱਖਣ") == "pakkA makkhaN"
    assert transliterate_text("അവൻ") == "avan" and transliterate_text("উৎস") == "uts"
    assert transliterate_text("१२") == "12"


def test_keys(spark):
    rows = [("the acme co ltd", "12 main road pune"), ("a", "x"), ("o'neil-sons", "pune"), (None, None)]
    assert column(spark, rows, T.core_name("a")) == ["acme", "a", "o neil sons", ""]
    assert column(spark, rows, T.name_key("a", "b")) == ["acme|road pune", "", "oneilsons|pune", ""]
    assert column(spark, rows, T.addr_key("b")) == ["12 main road pune", "", "", ""]
    assert column(spark, [("7 A, St. 7", "")], T.house("a")) == ["7"]
    assert column(spark, [("7 A 12 7", "")], T.numbers("a")) == [["7", "12"]]
    assert column(spark, [("12 Main Rd, New  Delhi ,x, Inde", "")], T.address_parts("a")) == [["12 main rd", "new delhi", "inde"]]
    assert sorted(column(spark, [("a b c,d", "")], T.region_keys(F.split("a", ",")))[0]) == ["a", "a b", "a b c", "b c", "c", "d"]
    assert column(spark, [("ab c", "")], T.word_trigrams("a")) == [[" ab", "ab ", " c "]]
    assert column(spark, ["abc é 1", "абв", None], T.non_latin("a")) == [False, True, False]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abc ", max_size=40))
def test_lcs_is_the_plain_one(a, b):
    assert M.lcs(a, b) == plain_lcs(a, b)
    assert M.ratio(a, b) == M.ratio(b, a)


def test_partial_ratio_is_the_best_window():
    draw = random.Random(4)
    for _ in range(200):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randrange(1, 12))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        windows = {long[max(i, 0) : i + len(short)] for i in range(1 - len(short), len(long))} if short else {""}
        best = max(M.ratio(short, w) for w in windows if w)
        if len(a) == len(b):
            best = max([best, *(M.ratio(long, short[max(i, 0) : i + len(short)]) for i in range(1 - len(short), len(short)))])
        assert abs(M.partial_ratio(a, b) - best) < 1e-9, (a, b)


def test_similarity_edges():
    assert M.ratio("", "") == 100.0 and M.ratio("", "a") == 0.0
    assert round(M.ratio("this is a test", "this is a test!"), 4) == 96.5517
    assert M.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100.0
    assert M.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert M.token_set_ratio("", "a") == 0.0
    assert M.partial_ratio("this is a test", "this is a test!") == 100.0
    assert M.partial_ratio("", "a") == 0.0 and M.partial_ratio("", "") == 100.0
    assert round(M.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(M.jaro_winkler("dwayne", "duane"), 4) == 0.84
    assert M.jaro_winkler("", "") == 1.0


def test_columns_match_the_functions(spark):
    rows = [("abc def", "abd de"), ("x", None), ("", "")]
    for f, c in ((M.ratio, M.indel_ratio_column), (M.token_set_ratio, M.token_set_ratio_column), (M.token_sort_ratio, M.token_sort_ratio_column), (M.partial_ratio, M.partial_ratio_column), (M.jaro_winkler, M.jaro_winkler_column)):
        assert column(spark, rows, c("a", "b")) == [f(a or "", b or "") for a, b in rows]


def test_marks_are_stripped_as_unicode_says(spark):
    text = "ÀÉÎõü Åå ﬃ ½"
    assert column(spark, [text], T.strip_marks("a")) == ["".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))]
