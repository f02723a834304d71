import random

from palimpsest.llm.leaks import find_leaks, held
from palimpsest.llm.tokens import slices

rnd = random.Random(9)
WORDS = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 4))) for _ in range(400)]


def text(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_held_counts_two_stretches_in_order():
    p = [text(10) for _ in range(8)]
    passage = ". ".join(p)
    assert held(passage, passage) == 1.0
    assert 0.45 < held(passage, f"{text(30)} {p[0]} {p[1]} {text(30)} {p[4]} {p[5]} {text(20)}") < 0.6
    assert held(passage, f"{text(30)} {p[5]} {p[6]} {text(30)} {p[0]} {p[1]}") < 0.35
    assert held(passage, f"{text(60)} {p[3]} {text(60)}") < 0.2
    assert held(passage, "") == held("", passage) == 0.0


def test_frequent_phrases_hide_no_stretch():
    """Three phrases of the passage stand 300 times each in a long text that also holds the whole passage."""
    parts = [text(9) for _ in range(4)]
    phrases = [f"{a}captain{b}lighthouse" for a, b in (("old", "grey"), ("young", "red"), ("late", "blue"))]
    words = " ".join(f"{p} {q}" for p, q in zip(parts, [*phrases, ""], strict=True))
    changed = " ".join(w if k % 4 or "captain" in w else f"q{w[1:]}" for k, w in enumerate(words.split()))
    many = " ".join(f"{phrases[i % 3]} {text(3)}" for i in range(900))
    assert held(words, changed) > 0.7
    assert held(words, f"{many} {changed} {many}") >= held(words, changed)


def test_search(spark):
    items = [(i, text(70)) for i in range(6)] + [(6, "字" * 3), (7, None), (8, "!!!")]
    docs = [(100 + i, text(200)) for i in range(30)]
    planted = set()
    for d, i in ((1, 0), (2, 1), (3, 2), (4, 2)):
        words = items[i][1].split()
        part = words if d % 2 else words[10:50]
        changed = [w if k % 17 else "x" + w for k, w in enumerate(part, 1)]
        docs[d] = (100 + d, f"{docs[d][1]}\r\n{' ,'.join(changed).upper()}. {text(50)}")
        planted.add((100 + d, i))
    docs += [(500, None), (501, ""), (502, docs[1][1]), (100 + 1, docs[1][1])]
    planted.add((502, 0))
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, share int")
    p = spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(d, "doc_id", "text", p, "item_id", "passage").collect()}
    assert got == planted
    assert find_leaks(d.limit(0), "doc_id", "text", p, "item_id", "passage").count() == 0
    assert find_leaks(d, "doc_id", "text", p.limit(0), "item_id", "passage").count() == 0


def test_blocks_of_passages_change_nothing(spark):
    items = [(i, text(70)) for i in range(12)]
    docs = [(i, f"{text(100)} {items[i % 12][1]} {text(100)}") for i in range(24)]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(d, "doc_id", "text", p, "item_id", "passage", block=1000).collect()}
    assert got == {(i, i % 12) for i in range(24)}


def test_slices_cover_all():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 3]
    found = list(slices(texts, 50))
    assert [i for a, b in found for i in range(a, b)] == list(range(5))
