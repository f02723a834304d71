import random

import numpy as np

from palimpsest.llm.neardup import member_pairs, near_duplicates, overlap

WORDS = [f"{a}{b}" for a in "kltmrs" for b in ("ando", "eri", "umo", "ixa", "opel", "argu", "ilt", "ener")]


def corpus():
    rnd = random.Random(7)
    base = [" ".join(rnd.choice(WORDS) for _ in range(60)) for _ in range(25)]
    rows, groups, i = [], {}, 0
    for g, text in enumerate(base):
        for _ in range(rnd.randrange(1, 5)):
            words = text.split()
            for _ in range(rnd.randrange(0, 3)):
                words[rnd.randrange(60)] = rnd.choice(WORDS)
            half = rnd.choice([0, 30])
            rows.append((i, ", ".join([" ".join(words[half:]), " ".join(words[:half])]).strip(", "), "x"))
            groups[i] = g
            i += 1
    return rows, groups


def closure(rows):
    """Components of all pairs above the threshold, pair by pair."""
    texts = [t for _, t, _ in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        good = overlap([texts[a]] * len(rows), texts)
        for b in np.flatnonzero(good >= 0.62):
            ra, rb = a, int(b)
            while parent[ra] != ra:
                ra = parent[ra]
            while parent[rb] != rb:
                rb = parent[rb]
            parent[max(ra, rb)] = min(ra, rb)
    roots = []
    for a in range(len(rows)):
        while parent[a] != a:
            a = parent[a]
        roots.append(rows[a][0])
    return {r[0]: g for r, g in zip(rows, roots, strict=True) if roots.count(g) > 1}


def test_groups_equal_brute_force(spark):
    rows, _ = corpus()
    extra = [(1000, None, "x"), (1001, " ", "x"), (1002, "。", "x"), rows[0]]
    df = spark.createDataFrame(rows + extra, "id long, text string, group_id string")
    got = {r.id: r.group_id for r in near_duplicates(df, "id", "text").collect()}
    assert got == closure(rows)


def test_hot_shingles_lose_no_copy(spark):
    rnd = random.Random(3)
    base = [rnd.choice(WORDS) for _ in range(50)]
    rows = [(i, " ".join(base[: i % 45] + [f"new{i}"] + base[i % 45 + 1 :])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.group_id for r in near_duplicates(df, "id", "text", hot=4).collect()}
    assert got == {0}


def test_hot_phrase_loses_no_pair(spark):
    """Different texts with one long phrase, whose retellings differ in size from the next text and the smallest one."""
    rnd = random.Random(5)
    phrase = [rnd.choice(WORDS) for _ in range(30)]
    rows = []
    for g in range(12):
        own = [f"{rnd.choice(WORDS)}{rnd.randrange(1000)}" for _ in range(30)]
        for copy in range(2):
            words = own.copy()
            for i in range(2 + copy, 30, 5):  # hardly a run of eight tokens outside the phrase is left
                words[i] = f"edit{g}x{copy}x{i}"
            rows.append((g + 100 * copy, " ".join(phrase + words)))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.group_id for r in near_duplicates(df, "id", "text", hot=4).collect()}
    assert got == closure([(*r, "x") for r in rows])


def test_member_pairs_and_empty(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "id long, group_id long")
    assert {tuple(r) for r in member_pairs(df, "a", "b").collect()} == {(1, 2), (1, 3), (2, 3), (4, 5)}
    empty = spark.createDataFrame([], "id long, text string")
    assert near_duplicates(empty, "id", "text").count() == 0


def test_overlap_counts_multisets():
    assert overlap(["a b a b"], ["a b"])[0] == 1 / 3
    assert overlap(["x"], ["x"])[0] == 1.0
    assert overlap([""], ["x"])[0] == 0.0
    assert len(overlap([], [])) == 0


def test_members_of_a_group_are_compared_where_leaders_fail(spark):
    """Two texts of one prefix and size; only the second is similar to a third text."""
    from palimpsest.llm.neardup import _expanded

    kin = spark.createDataFrame([(1, 2, 0.7)], "leader long, id long, part double")
    failed = spark.createDataFrame([(1, 9, 0.5), (1, 8, 0.1), (5, 6, 0.6)], "a long, b long, part double")
    assert {tuple(r) for r in _expanded(failed, kin, 0.62).collect()} == {(2, 9)}


def test_hot_and_usual_runs_give_the_same_groups(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "id long, text string, group_id string")
    assert {r.id: r.group_id for r in near_duplicates(df, "id", "text", hot=1).collect()} == closure(rows)


def test_texts_with_one_common_clause_do_not_leave_the_task(spark, monkeypatch):
    """Pairs that share less than the similarity are dropped by their sketches, and all true ones are found."""
    from palimpsest.llm import neardup

    found = []
    real = neardup.materialize

    def counted(df, name="table", parts=None):
        table = real(df, name, parts)
        if name == "found":
            found.append(table.count())
        return table

    monkeypatch.setattr(neardup, "materialize", counted)
    rnd = random.Random(9)
    clause = [rnd.choice(WORDS) for _ in range(20)]
    rows = []
    for g in range(60):
        own = [f"{rnd.choice(WORDS)}{rnd.randrange(1000)}" for _ in range(30)]
        for copy in range(1 + (g < 5)):
            words = own.copy()
            words[3 + copy] = f"edit{copy}"
            rows.append((g + 100 * copy, " ".join(clause + words)))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.group_id for r in near_duplicates(df, "id", "text").collect()}
    assert got == closure([(*r, "x") for r in rows]) == {i: i % 100 for g in range(5) for i in (g, g + 100)}
    assert found[0] < 500  # 2080 pairs share the clause


def test_sketches_bound_the_overlap():
    from palimpsest.llm.neardup import SKETCH, _sketches
    from palimpsest.llm.tokens import tokenize

    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([1, 2, 5, 40, 700]))) for _ in range(60)] + ["", "。", "x", "x"]
    tokens = tokenize(texts)
    rows = np.flatnonzero(np.diff(tokens.bounds()))
    bits = np.unpackbits(_sketches(tokens, rows), 1)
    assert bits.shape == (len(rows), SKETCH)
    size = np.maximum(1, np.diff(tokens.bounds())[rows] - 1)
    for a in range(len(rows)):
        part = overlap([texts[rows[a]]] * len(rows), [texts[r] for r in rows])
        most = (bits[a] & bits).sum(1) + np.minimum(size[a] - bits[a].sum(), size - bits.sum(1))
        assert (part * np.maximum(size[a], size) <= most + 1e-9).all()
