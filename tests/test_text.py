"""Text functions against plain definitions."""

from pyspark.sql import functions as F

from inkwell.functions import text as T


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("v")).first()["v"]


def test_tokens(spark):
    assert value(spark, "中值定理 x^2 = f(a) 定", T.tokenize) == ["中值", "值定", "定理", "x^2", "=", "f", "(", "a", ")", "定"]
    assert value(spark, None, T.tokenize) == []
    assert value(spark, "什么是切片 slice", T.query_tokens) == ["切片", "slice"]


def test_upper_case_letter_by_letter(spark):
    assert value(spark, "straße ﬁx\nŉ ᾳé ǆ", T.upper_each) == "STRAẞE ﬁX\nŉ ᾼÉ Ǆ"
    assert value(spark, "", T.upper_each) == "" and value(spark, None, T.upper_each) is None


def test_query_features(spark):
    q = "请问张三的学号是什么"
    assert value(spark, q, T.query_anchors) == ["张三"]
    assert "学号是" not in value(spark, q, T.query_phrases)
    assert value(spark, "a ab ab 切片", T.query_terms) == ["ab", "切片"]


def test_expansion(spark):
    assert value(spark, "Go 的包外访问", T.expand_question).endswith("可见性 公有 私有 大写 小写 包内 包外")
    assert value(spark, "hello", T.expand_question) == "hello"


def test_cleaning(spark):
    assert value(spark, "e\x00xam-\nple  ﬁt\t\tx　y\f", T.clean_text) == "example fit x y"
    assert value(spark, "a  b", lambda c: T.clean_text(c, True)) == "a  b"


def test_boilerplate(spark):
    for line in ("12", "第 3 页", "Page 3 of 9", "CONFIDENTIAL", "-----", "draft."):
        assert value(spark, line, T.is_boilerplate)
    for line in ("", "12345", "A page of text", "x" * 61):
        assert not value(spark, line, T.is_boilerplate)


def test_estimates(spark):
    assert [value(spark, t, T.estimate_tokens) for t in ("", "abc", "中文", "中文abcd", "a" * 40)] == [0, 1, 2, 3, 10]


def test_formula(spark):
    assert value(spark, r"\frac{a}{b}", T.plausible_formula) and value(spark, "x = 1", T.plausible_formula)
    assert not value(spark, "只是文字", T.plausible_formula) and not value(spark, r"\quad" * 9, T.plausible_formula)
    assert not value(spark, "", T.plausible_formula) and not value(spark, None, T.plausible_formula)


def test_sentences(spark):
    assert value(spark, "One. Two! Three", T.split_sentences) == ["One.", "Two!", "Three"]


def test_answers_of_models(spark):
    """Nulls, empty answers, one pair of quotes only, items and objects in prose."""
    rows = [(None, "q"), ("", "q"), ("\"'a'\"", "long enough"), ("```", "question"), ("“x", "question"), ("1) a\n- a\n2. q\n\n无\n* b\nc\nd", "q"), ('x {"vague": False} {', "q"), ('{"a": {"Vague":true}} }', "q")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, q string").coalesce(1)
    raw, q = F.col("raw"), F.col("q")
    got = d.select("i", T.rewritten(raw, q).alias("r"), T.listed_items(raw, q).alias("l"), T.lenient_object(raw).alias("o"), T.verdict(raw).alias("v")).orderBy("i").collect()
    assert [g.r for g in got[:5]] == ["q", "q", "'a'", "question", "“x"]
    assert got[5].l == ["a", "b", "c"] and got[0].l == [] and got[1].l == []
    assert [g.o for g in got] == [None] * 8
    assert [g.v for g in got] == [None] * 6 + [False, True]
