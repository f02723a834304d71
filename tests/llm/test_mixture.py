import random

from palimpsest.llm.mixture import mix, running_sums, with_tokens


def test_running_sums_equal_a_loop(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("aab"), rnd.randrange(100), rnd.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, k long, n long")
    got = {r.id: r.before for r in running_sums(df, "g", ["k", "id"], "n").collect()}
    for g in "ab":
        total = 0
        for i, _, _, n in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            assert got[i] == total
            total += n


def test_shares_and_caps(spark):
    rnd = random.Random(4)
    docs = [(i, "word " * rnd.randrange(5, 60), "big", 1) for i in range(400)] + [(1000 + i, "word " * rnd.randrange(5, 60), "small", 1) for i in range(30)]
    docs += [(2000, None, "big", 1), (2001, "", "small", 1), (2002, "x y", None, 1), (2003, "x y", "other", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, copies int")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixture, report = mix(d, "doc_id", "text", "source", t)
    rows = mixture.collect()
    assert all(r.copies <= {"big": 1, "small": 3}[r.source] for r in rows)
    assert not {2000, 2001, 2002, 2003} & {r.doc_id for r in rows}
    shares = {r.source: r for r in report.collect()}
    assert shares["none"].used_tokens == 0
    for s in ("big", "small"):
        assert abs(shares[s].used_tokens - shares[s].budget) <= 60
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in mix(d, "doc_id", "text", "source", t)[0].collect()}
    assert mix(d.limit(0), "doc_id", "text", "source", t)[0].count() == 0


def test_token_counts_ignore_nothing(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, "字句字句"), (3, None), (4, "<|endoftext|>")], "id long, text string")
    got = {r.id: r.n_tokens for r in with_tokens(d, "text", ["id"]).collect()}
    assert got[3] == 0 and all(got[i] > 1 for i in (1, 2, 4))
