from palimpsest.llm.names import Knowledge, edits, likelihood, parse, persons, readings, spelling_pairs, spellings

ENTRIES = [
    *[(1, "江梦灵")] * 9, *[(1, "江灵梦")] * 2, (1, "江梦灵（巫祝）"), (2, "方紫（巫祝）"), (1, "巫祝江梦灵"), (1, "阿灵"), (1, "Jiang Mengling"), (1, "J. Mengling"), (1, "江梦梦灵"), (1, "梦灵"),
    *[(1, "江梦雪")] * 8, (1, "她"), (1, " "), (1, None),
    *[(2, "Hélène Zanault")] * 9, (2, "Zanault, H."), (2, "Zanault, Helene"), (2, "Hélène Zannault"), (2, "Lady Zanault"), (2, "Ｈélène​ Zanault"), (2, "Hélène “Nell” Zanault"), (2, "Nell Zanault"),
    *[(2, "Margarethe Dovmeyer")] * 5, (2, "Margarethe"), (3, "Hélène Zanault"), (None, "Hélène"),
]


def test_persons(spark):
    entries = spark.createDataFrame([(*e, "x") for e in ENTRIES], "book_id long, heroine_name string, person string")
    candidates = spark.createDataFrame([(1, "江梦灵", ["小灵", None, "师姐", ""]), (2, None, None)], "book_id long, canonical_name string, aliases array<string>")
    linked = persons(spellings(entries, candidates))
    groups = {}
    for r in linked.collect():
        groups.setdefault((r.book_id, r.person), set()).add(r.name)
    found = sorted(map(sorted, groups.values()))
    assert sorted(["江梦灵", "江灵梦", "江梦灵（巫祝）", "巫祝江梦灵", "阿灵", "Jiang Mengling", "J. Mengling", "江梦梦灵", "梦灵", "小灵"]) in found
    assert sorted(["Hélène Zanault", "Zanault, H.", "Zanault, Helene", "Hélène Zannault", "Lady Zanault", "Hélène “Nell” Zanault", "Nell Zanault"]) in found
    assert ["Margarethe", "Margarethe Dovmeyer"] in found
    assert len(found) == 3
    pairs = spelling_pairs(linked)
    assert pairs.filter("name_a >= name_b").count() == 0
    assert pairs.count() == sum(len(g) * (len(g) - 1) // 2 for g in found)


def test_empty_tables(spark):
    entries = spark.createDataFrame([], "book_id long, heroine_name string")
    candidates = spark.createDataFrame([], "book_id long, canonical_name string, aliases array<string>")
    assert persons(spellings(entries, candidates)).count() == 0


def test_channel(spark):
    known = Knowledge(readings(spark))
    assert likelihood(parse("苏研昕", known), parse("苏妍昕", known), known) > 0
    assert likelihood(parse("秦泠绾", known), parse("秦泠梦", known), known) == 0
    assert likelihood(parse("Исаев", known), parse("Злата Исаев", known), known) > 0
    assert edits("abcd", "acbd") == 1
    assert edits("abc", "abc") == 0
    assert edits("abc", "xyzabc") == 3
