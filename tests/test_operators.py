import json
from datetime import datetime

from pyspark.sql import functions as F

from palimpsest.functions.jsontext import diagnose, repair
from palimpsest.operators import anchors, entities, joins, records, states, windows
from palimpsest.sources import files


def test_keep_first_and_coverage(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (None, 7, "c"), (2, 1, "z"), (2, 1, "z")], "k int, o int, v string")
    assert {(r.k, r.o, r.v) for r in records.keep_first(df, ["k"], [F.col("o")]).collect()} == {(1, 2, "a"), (None, 7, "c"), (2, 1, "z")}
    other = spark.createDataFrame([(2,), (3,)], "k int")
    got = {(r.k, r.side) for r in records.coverage(df.filter("k is not null"), other, ["k"]).collect()}
    assert got == {(1, "left_only"), (3, "right_only")}


def test_reuse_and_rescan_partition(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, h string")
    old = spark.createDataFrame([("a",), ("a",), (None,)], "h string")
    reused, again = records.reuse(new, old, "h"), records.rescan(new, old, "h")
    assert {r.id for r in reused.collect()} == {1}
    assert {r.id for r in again.collect()} == {2, 3}


def test_tri_state(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, False), (2, None), (3, None)], "k int, f boolean")
    assert {(r.k, r.x) for r in df.groupBy("k").agg(records.tri_state(F.col("f")).alias("x")).collect()} == {(1, True), (2, False), (3, None)}


def test_greedy_consumes_planted_items(spark):
    rows = [("b", 1, 1, 10, 5, 9), ("b", 1, 1, 11, 6, 9), ("b", 2, 2, 11, 6, 4), ("b", 2, 2, 10, 5, 9)]
    df = spark.createDataFrame(rows, "book string, planted int, planted_at int, resolved int, resolved_at int, score int")
    got = {(r.planted, r.resolved) for r in joins.greedy_matches(df, ["book"]).collect()}
    assert got == {(1, 10), (2, 11)}


def test_anchored_clusters_reset_at_the_first(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 60, 100, 130, 190, 300)] + [(2, 5)], "k int, t bigint")
    got = sorted((r.k, r.first, r.last, r.n) for r in windows.anchored_clusters(df, "k", "t", 100).collect())
    assert got == [(1, 0, 100, 3), (1, 130, 190, 2), (1, 300, 300, 1), (2, 5, 5, 1)]
    gaps = sorted((r.k, r["first"], r["last"], r.n) for r in windows.session_gaps(df.withColumn("id", F.col("t")), "k", "t", "id", 60).collect())
    assert gaps == [(1, 0, 190, 5), (1, 300, 300, 1), (2, 5, 5, 1)]


def test_uniform_sample_takes_both_ends(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (2, 1)], "k int, i int")
    got = sorted(r.i for r in windows.uniform_sample(df, "k", ["i"], 5).filter("k = 1").collect())
    assert got == [round(j * 49 / 4) for j in range(5)]


def test_labels_are_the_smallest_of_each_component(spark):
    links = [("a", "b"), ("b", "c"), ("x", "y"), ("d", "d"), (None, "q")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    got = {r.node: r.label for r in entities.smallest_labels(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["n040"] == "n000" and "d" not in got and "q" not in got


def test_json_ladder():
    assert repair('{"a": 1}') == ('{"a": 1}', "strict")
    assert repair('```json\n{"a": [1,],}\n``` tail')[1] == "fence"
    assert repair('note ｛"a"：1｝')[0] == '{"a": 1}'
    assert repair('{"a": "x')[1] == "truncated"
    assert repair("none here")[1] == "no_object"
    assert repair(None) == (None, "empty")


def test_anchor_cascade():
    text = "前文。" * 20 + "她把祖传的铜钥匙匆忙交给了他，转身走进雨里。" + "后文。" * 20
    assert anchors.anchor("她把祖传的铜钥匙", text)[2] == "EXACT"
    assert anchors.anchor("祖传的铜钥匙……走进雨里", text)[2] == "ELLIPSIS_BOTH"
    assert anchors.anchor("完全无关的一句话而已", text) == (-1, -1, "NONE")
    assert anchors.anchor(None, text)[2] == anchors.anchor("x", None)[2] == "NONE"


def test_context_forgets_what_is_resolved():
    state = states.context_step({}, 1, ["a"], ["t1", "t2"], [])
    state = states.context_step(state, 2, ["b", "a"], ["t3"], ["t1"])
    assert state == {"characters": ["b", "a"], "open_threads": ["t2", "t3"], "resolved": ["t1"], "last_chunk": 2}
    memory = {}
    for chunk in range(1, 80):
        memory = states.memory_step(memory, chunk, ["old"] if chunk == 1 else [f"thread {chunk:03}"])
    assert len(memory["threads"]) <= 40


def test_decode_and_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "甲.txt").write_bytes("第一章 夜雨，他说：“走！”".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("plain text, nothing else.".encode())
    rows = {r.name: (r.text, r.encoding) for r in files.documents(spark, str(tmp_path)).collect()}
    assert rows["甲"][0].startswith("第一章 夜雨") and rows["b"][0] == "plain text, nothing else."
    assert files.latest_file(spark, str(tmp_path), "*.txt").endswith(".txt")


def test_profiles_inherit(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"limits": {"a": 1, "b": 2}, "words": ["x"]}))
    (tmp_path / "child.json").write_text(json.dumps({"extends": "base", "limits": {"b": 3}, "words": ["y"]}))
    assert files.load_profile(str(tmp_path), "child") == {"limits": {"a": 1, "b": 3}, "words": ["y"]}


def test_stream_equals_batch(spark, tmp_path):
    from palimpsest.streaming import folds

    rows = [(1, c, [f"p{c}"], [f"t{c}"], [f"t{c - 2}"] if c > 2 else []) for c in range(1, 9)]
    schema = "doc long, chunk int, characters array<string>, opened array<string>, resolved array<string>"
    for part in (rows[:4], rows[2:]):  # the second batch repeats two chunks
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = folds.fold_contexts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.filter("accepted and chunk = 8").first()
    batch = states.rolling_context(spark.createDataFrame(rows, schema).withColumnRenamed("doc", "book"), "book").first()
    assert (last.n_characters, last.n_open, last.n_resolved) == (len(batch.characters), len(batch.open_threads), batch.n_resolved)
    assert out.filter("not accepted").count() == 2


def test_log_is_idempotent(spark, tmp_path):
    from palimpsest.streaming import folds

    write = folds.merge_log(str(tmp_path), ["k"], "at")
    first = spark.createDataFrame([(1, datetime(2024, 1, 1), "a"), (1, datetime(2024, 1, 2), "b")], "k int, at timestamp, v string")
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([(2, datetime(2024, 1, 3), "c")], "k int, at timestamp, v string"), 1)
    assert {(r.k, r.v) for r in folds.read_log(spark, str(tmp_path), ["k"], "at").collect()} == {(1, "b"), (2, "c")}


def test_context_keeps_whole_threads_and_scales_with_length(spark, tmp_path):
    from palimpsest.plans.fact_queries import rolling_context_state

    start = "the same first twenty characters and then "
    facts = [(i, 1, i, "foreshadowing", None, f"{start}{i}", None) for i in range(90)] + [(100, 1, 90, "events", None, None, f"{start}89")]
    schema = "fact_id long, book_id long, chunk_index int, kind string, character_name string, description string, event string"
    for name, length, most in (("short", 10, 39), ("long", 2_000_000, 79)):
        spark.createDataFrame(facts, schema).write.parquet(str(tmp_path / name / "chunk_facts.parquet"))
        spark.createDataFrame([(1, "x" * length)], "book_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        row = rolling_context_state(spark, str(tmp_path / name)).first()
        assert (row.n_open, row.n_resolved) == (most, 1)


def test_marks_inside_strings_stay():
    assert repair("｛\"a\"：1，\"text\"：\"他说，走：吧\"｝") == ('{"a": 1, "text": "他说，走：吧"}', "wide")
    assert repair('{"evidence": "他说"这是真的"，随后离开"}') == ('{"evidence": "他说\\"这是真的\\"，随后离开"}', "quotes")
    assert repair('{"a": "x\x07y"}')[0] == '{"a": "xy"}'
    assert repair('ready: {"a": [1, 2,]} done')[0] == '{"a": [1, 2]}'


def test_json_diagnosis():
    assert diagnose(None)[0] == ["content_empty", "content_none"]
    assert diagnose('{"a": "b')[0] == ["json_string_unclosed", "json_unbalanced", "likely_truncated"]
    assert diagnose('```json\n{"a": 1}\n```') == (["code_fence_wrapped"], 20, 0, 0)
    assert diagnose('```{"a": [1}') == (["code_fence_unclosed", "code_fence_wrapped", "json_unbalanced"], 12, 0, 1)
    assert diagnose('{"a": [' + "1, " * 2000)[0] == ["json_unbalanced", "likely_truncated", "near_max_tokens_truncated"]
