"""Text rules on hand-written rows."""

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.functions.blank import is_blank


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_clean_text(spark):
    raw = "A  title\t here\n\n 12 \nPage 3 of 9\npage 4\n body \r\nPager duty\nPage\n"
    assert one(spark, text.clean_text, raw, "", None) == ["A title here\nbody\nPager duty\nPage", "", None]
    assert one(spark, lambda c: text.clean_text(c, F.array(F.lit("H"))), "H\nx\n H ") == ["x"]


def test_heading(spark):
    got = one(spark, text.heading, "# Title", "x\n## A B", "ALL CAPS", "A B C D E F G H I J", "123", "", None)
    assert got == ["Title", "A B", "ALL CAPS", None, None, None, None]


def test_sentences(spark):
    assert one(spark, text.sentences, "One. Two!  Three?\nFour", "no end", "", "3.5 is.") == [["One.", "Two!", "Three?", "Four"], ["no end"], [], ["3.5 is."]]


def test_terms(spark):
    got = one(spark, text.word_terms, "student's classes is", "bus glass", "red red-hot 'tis", "", "A1-b's")
    assert got == [["student", "classe"], ["bus", "glas"], ["red", "red-hot", "tis"], [], ["a1-b"]]
    assert one(spark, text.has_cjk, "成績", "abc", "\U00020000", "カ") == [True, False, True, False]
    assert one(spark, text.query_terms, "成績冊 Where", "成成") == [["成", "績", "冊", "where"], ["成", "成"]]
    for q in ("student's classes is", "成績冊 Where is it", "red red-hot", ""):
        assert text.terms_of(q)[0] == one(spark, text.query_terms, q)[0]


def test_phrases(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (["a", "a", "a"],)], "t array<string>")
    got = [r[0] for r in df.select(text.phrases(F.col("t"), 3)).collect()]
    assert got == [["a b", "b c", "a b c"], [], [], ["a a", "a a a"]]
    assert text.phrases_of(["a", "b", "c"], 3, " ") == ["a b", "b c", "a b c"]


def test_source_url(spark):
    got = one(spark, text.source_url, "www.a.b", " http://a.b. ", "(https://a.b)", "ftp://a", "", None, "https://a.b/c;")
    assert got == ["https://www.a.b", "https://a.b", "https://a.b", "", "", "", "https://a.b/c"]


def test_types_titles_prefixes(spark):
    assert one(spark, lambda c: text.manual_type(c), "x/Teacher_1.pdf", "學生手冊", "teacher student", "other", None) == ["teacher", "student", "teacher", "", ""]
    assert one(spark, text.session_title, "x" * 50, "y" * 51, "") == ["x" * 50, "y" * 50 + "...", ""]
    assert one(spark, lambda c: text.prefixed(c)[1], "Teacher: hi ", "student:", "plain") == ["hi", "", "plain"]


def test_blank(spark):
    blank = ["", " \n\t", "​", "　", "N/A", "n.a.", "...", "…", "-", "—", "(empty)", "None", "null", "[no response]", None, " None. ", "⠀"]
    told = ["No.", "Yes.", "?", "0", ":)", "none of them", "null and void", "可以。", "Nothing here", "-1"]
    assert one(spark, is_blank, *blank) == [True] * len(blank)
    assert one(spark, is_blank, *told) == [False] * len(told)
