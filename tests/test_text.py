import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("  张　三 ", "张 三"), (None, ""), ("张，三", "张,三"), ("Smith, John", "Smith, John"), ("“李四”", "李四")])
def test_person(spark, raw, want):
    assert one(spark, X.normalize_person(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("a", "b", "want"), [("ab", "ab", 0), ("ab", "ac", 1), ("", "abc", 3), ("abc", "", 3), ("ab", "abcdefgh", 3), ("", "", 0)])
def test_capped_distance(spark, a, b, want):
    assert one(spark, X.capped_levenshtein(F.col("a"), F.col("b"), 2), a=a, b=b) == want


def test_occurrences_do_not_overlap(spark):
    assert one(spark, X.occurrences(F.col("a"), "aa"), a="aaaa") == 2
    assert one(spark, X.unnegated_occurrences(F.col("a"), "肯", ["不"], 2), a="不肯，他肯，从不会肯") == 1


def test_hash_ignores_outer_space_only(spark):
    h = X.text_hash(F.col("a"))
    assert one(spark, h, a=" x y ") == one(spark, h, a="x y") != one(spark, h, a="x  y")
    assert len(one(spark, h, a="")) == 16


def test_ngrams_and_lists(spark):
    assert one(spark, X.ngram_set(F.col("a"), 3), a="ab") == ["ab"]
    assert one(spark, X.ngrams(F.col("a"), 2), a="😀ab") == ["😀a", "ab"]
    assert one(spark, X.keep_last(F.split("a", ""), 2), a="abac") == ["b", "c"]
    assert tuple(one(spark, X.ellipsis_ends(F.col("a")), a="开头……中间……结尾")) == ("开头", "结尾")
    assert one(spark, X.clip(F.col("a"), 3), a="abcdef") == "ab…"
    assert one(spark, X.bounded_score(F.col("a")), a="x") == 0.0
    assert one(spark, X.bounded_score(F.col("a")), a="12") == 10.0


def test_name_lists():
    from palimpsest.functions.names import split_names_of, split_top_level

    assert split_names_of("张三、李四、王五") == ["张三", "李四", "王五"]
    assert split_names_of("张三,李四") == ["张三", "李四"]
    assert split_names_of("Smith, John") == ["Smith, John"]
    assert split_names_of("群臣、百官") == split_names_of(None) == split_names_of(" ") == []
    assert split_names_of("张三、、李四") == ["张三", "李四"]
    assert split_top_level("张三（又名、李四）、王五", "、") == ["张三（又名、李四）", "王五"]


def test_groups_and_similarity(spark):
    from palimpsest.functions.names import is_group, similarity

    rows = [("群臣、百官", True), ("将领、士兵等人", True), ("", True), ("某人", True), ("张三", False)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    assert [r.x for r in df.select(is_group(F.col("a")).alias("x")).collect()] == [b for _, b in rows]
    assert one(spark, similarity(F.col("a"), F.col("b")), a="abc", b="abc") == 1.0
    assert one(spark, similarity(F.col("a"), F.col("b")), a="", b="abc") == 0.0
    assert 0.5 < one(spark, similarity(F.col("a"), F.col("b")), a="abcd", b="abce") < 1
