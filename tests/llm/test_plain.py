import pytest

from palimpsest.llm.plain import _compile, not_plain, plain, with_plain_form

CASES = [
    ("Ｍａｒｇａ⁠ｒｅｔｈｅ Ｈ．", "Margarethe H."),
    ("Hélène", "Hélène"),
    ("⻔外两⼈", "门外两人"),
    ("Χ12号 и А3号", "X12号 и A3号"),
    ("Tаmmeyуer", "Tammeyyer"),
    ("Pогнеда", "Рогнеда"),
    ("А. Верхоумова", "А. Верхоумова"),
    ("她说：“走！”，（低声）", "她说：“走！”，（低声）"),
    ("傅\U000e0100昕︀绮", "傅昕绮"),
    ("​‍", ""),
    ("", ""),
    ("line\nbreak\ttab", "line\nbreak\ttab"),
    ("👩‍🚀 ok", "👩‍🚀 ok"),
]


@pytest.mark.parametrize(("raw", "want"), CASES)
def test_plain(raw, want):
    assert plain(raw) == want
    assert plain(want) == want


def test_null_and_mapping():
    assert plain(None) is None
    assert _compile()["Ａ"] == "A"


def test_columns(spark):
    df = spark.createDataFrame([(i, raw, "extra") for i, (raw, _) in enumerate(CASES)] + [(99, None, None)], "id long, value string, plain_ string")
    got = {r.id: r.out for r in with_plain_form(df, "value", "out").collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)} | {99: None}
    found = {r.id for r in not_plain(df, "id", "value").collect()}
    assert found == {i for i, (raw, want) in enumerate(CASES) if raw != want}
    assert not_plain(df.limit(0), "id", "value").count() == 0


def test_long_text():
    assert plain("Ａ" * 200_000) == "A" * 200_000
