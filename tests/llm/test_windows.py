import random

from palimpsest.llm.windows import balanced, split_windows


def brute(s, e, text, limit, overlap):
    """TESTDATA's rule, read character by character."""
    s, e = max(0, min(s, e)), min(len(text), max(s, e))
    if e - s <= limit:
        return []
    out = []
    while e - s > limit:
        ends = [p for p in range(s + limit // 2 + 1, s + limit + 1) if text[p - 1] in "。！？\n"]
        cut = max(ends, default=s + limit)
        out.append((s, cut))
        s = cut - overlap
    return [(i, *p) for i, p in enumerate([*out, (s, e)], 1)]


def cases():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("字词句😀ab \r" * 5 + "。！？\n") for _ in range(rnd.choice([0, 50, 300, 2000]))) for _ in range(30)] + ["无" * 500, None]
    spans = [(rnd.choice([None, -5, 0, 3, rnd.randrange(2000)]), rnd.choice([None, 5000, 0, rnd.randrange(2500)])) for _ in texts]
    return list(enumerate(zip(texts, spans, strict=True)))


def tables(spark):
    windows = spark.createDataFrame([(i, 1, i, s, e) for i, (_, (s, e)) in cases()], "cluster_id long, book_id long, chunk_idx int, window_start int, window_end int")
    texts = spark.createDataFrame([(1, i, t) for i, (t, _) in cases()], "book_id long, chunk_idx int, text string")
    return windows, texts


def test_equals_brute_force(spark):
    windows, texts = tables(spark)
    got = {tuple(r) for r in split_windows(windows, texts, ["book_id", "chunk_idx"], "cluster_id", 100, 10).collect()}
    want = {(i, *p) for i, (t, (s, e)) in cases() if t is not None and None not in (s, e) for p in brute(s, e, t, 100, 10)}
    assert got == want
    assert len(want) > 50
    assert split_windows(windows.limit(0), texts, ["book_id", "chunk_idx"], "cluster_id").count() == 0


def test_balanced_pieces_cover_and_fit(spark):
    windows, texts = tables(spark)
    rows = split_windows(windows, texts, ["book_id", "chunk_idx"], "cluster_id", 100, 10, plan="balanced").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.cluster_id, r.piece_no)):
        by.setdefault(r.cluster_id, []).append((r.piece_start, r.piece_end))
    assert by
    for pieces in by.values():
        assert all(0 < b - a <= 100 for a, b in pieces)
        assert all(q[0] == p[1] - 10 for p, q in zip(pieces, pieces[1:], strict=False))


def test_balanced_uses_least_count():
    assert len(balanced(0, 1900, [], [], 1000, 100)) == 2
    assert balanced(0, 1800, [980, 940], [False, True], 1000, 100)[0][1] in (940, 980)
