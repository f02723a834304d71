import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions.packs import NOVEL
from palimpsest.operators.segment import book_chunk_table, chunk_table, fixed_chunks_of, halves_of, length_chunks_of, line_spans, semantic_chunks_of

HEADING = re.compile(NOVEL.heading)
texts = st.text(alphabet="字句😀a。！\n 第一章", max_size=300)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(5, 60), st.integers(0, 20))
def test_fixed_chunks(text, size, overlap):
    chunks = fixed_chunks_of(text, size, overlap)
    lines = [m.group() for m in re.finditer(r"[^\n]+", text) if m.group().strip()]
    assert "".join(re.sub(r"\n", "", text[a:b]) for a, b, _, _ in chunks).replace(" ", "").replace("　", "") == "".join(lines).replace(" ", "").replace("　", "")
    for a, b, wa, wb in chunks:
        assert wa <= a < b <= wb
        assert b - a <= size or "\n" not in text[a:b].strip("\n") or len(text[a:b].split("\n")[0]) > 0
    assert all(p[1] <= q[0] for p, q in zip(chunks, chunks[1:], strict=False))


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(5, 60), st.integers(1, 20))
def test_semantic_windows_hold_cores(text, size, overlap):
    for a, b, wa, wb in semantic_chunks_of(text, size, overlap, HEADING):
        assert wa <= a < b <= wb


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 50))
def test_length_chunks_tile(text, size):
    chunks = length_chunks_of(text, size, 10)
    assert "".join(text[a:b] for a, b in chunks) == text
    assert "".join(text[a:b] for a, b in halves_of(text)) == text


def test_two_chapters_fall_back_and_three_do_not():
    text = "第一章 甲\n" + "字" * 30 + "\n第二章 乙\n" + "句" * 30
    assert semantic_chunks_of(text, 1000, 10, HEADING) == fixed_chunks_of(text, 1000, 10)
    assert len(semantic_chunks_of(text + "\n第三章 丙\n末", 1000, 10, HEADING)) == 3


def test_tables(spark):
    rnd = random.Random(1)
    rows = [(i, "\r\n".join("行" * rnd.randrange(0, 9) for _ in range(rnd.randrange(6))), "x") for i in range(20)] + [(90, None, "x"), (91, "", "x"), (92, " \n\t\n", "x")]
    df = spark.createDataFrame(rows, "id long, text string, start string")
    spans = {(r.id, r.start, r.end) for r in line_spans(df, "id", "text").collect()}
    want = {(i, m.start(), m.end()) for i, t, _ in rows if t for m in re.finditer(r"[^\n]+", t.replace("\r\n", "\n")) if m.group().strip()}
    assert spans == want
    for mode in ("fixed", "semantic", "length", "halves"):
        assert {r.id for r in chunk_table(df, "id", "text", mode, 10, 3).collect()} >= {i for i, _, _ in want} - {92}
        assert chunk_table(df.limit(0), "id", "text", mode).count() == 0


def test_whole_books_are_cut_at_their_chapters(spark):
    """Chapters that run over many texts, fewer than three headings in any eight of them, and a book without chapters."""
    rows = []
    for book, every in ((1, 5), (2, 3), (3, 40), (4, 1)):
        for i in range(30):
            head = f"第{i // every + 1}章 风雨\n" if i % every == 2 % every and every < 40 else ""
            rows.append((book, i, f"开头第{i}行\r\n{head}" + "\n".join(f"第{i}段第{j}句话。" * (j % 4 + 1) for j in range(i % 7)) + ("\n\n" if i % 3 else "")))
    rows += [(1, 99, None), (5, 0, ""), (6, 0, " \n ")]
    df = spark.createDataFrame(rows, "book_id long, chunk_idx int, text string")
    got = {}
    for r in sorted(book_chunk_table(df, "book_id", "chunk_idx", "text", 120, 30).collect()):
        got.setdefault(r.book_id, []).append(tuple(r)[1:])
    want = {}
    for book in range(1, 7):
        whole = "\n".join(t.replace("\r\n", "\n") for b, _, t in rows if b == book and t is not None)
        found = semantic_chunks_of(whole, 120, 30, HEADING)
        if found:
            want[book] = [(n, *c) for n, c in enumerate(found, 1)]
    assert got == want


def test_halves_are_cut_before_the_nearest_mark():
    assert halves_of("aaaa。bbb\ncccc") == [(0, 8), (8, 13)]
    assert halves_of("aa。b\ncc。d") == [(0, 4), (4, 9)]
    assert halves_of("abcdef") == [(0, 3), (3, 6)]
    assert halves_of("\nabc。") == [(0, 2), (2, 5)]
