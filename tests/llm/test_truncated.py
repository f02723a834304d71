from palimpsest.llm.truncated import Terminality, _aligned_end, ends_early, find_cut


def test_alignment():
    whole = "她把铜钥匙交给了他，转身走进雨里。城门提前落锁，谁也不敢先开口。"
    assert ends_early("她把铜钥匙交给了他，转身走进", whole) == 1
    assert ends_early("她把铜钥匙交给了他，转身走进。", whole) == 1
    assert ends_early("她把铜钥匙交给了他，转身走进雨里", whole) == -1
    assert ends_early("她把铜钥匙交给了他", whole) == 0
    assert ends_early(whole, whole) == 0
    assert ends_early("The glassblower cut the moo", "The glassblower cut the mooring rope. She left.") == 1
    assert ends_early("The glassblower cut the mooring", "The glassblower cut the mooring rope. She left.") == 1


SUBJECTS = ["the tall clerk", "her cousin", "a deaf baker", "the ferryman", "their landlord", "his tutor"]
VERBS = ["cut the mooring rope", "changed the will", "lost heart at once", "kept the receipt", "looked the other way", "locked the gate again"]


def values():
    return [f"{SUBJECTS[i % 6]} {VERBS[(i // 6) % 6]}. {SUBJECTS[(i // 2) % 6]} {VERBS[(i * 5 + 1) % 6]}." for i in range(240)]


def test_terminality_tells_cuts_from_ends():
    model = Terminality(values())
    ends = model.score([f"{s} {v}" for s in SUBJECTS for v in VERBS])
    cuts = model.score([f"{s} {v[:-3]}…" for s in SUBJECTS for v in VERBS])
    assert (ends > 0.3).mean() > 0.95
    assert (cuts[:, None] < ends[None, :]).mean() > 0.9
    assert (cuts < 0.15).mean() > 0.6
    assert len(model.score([""])) == 1


def test_find_cut(spark):
    rows = [(i, v, "s") for i, v in enumerate(values())]
    rows += [(900, values()[7][:-9], "s"), (901, None, "s"), (902, "...", "s"), (903, values()[3].rstrip("."), "s"), (900, values()[7][:-9], "s")]
    df = spark.createDataFrame(rows, "id long, text string, cut string")
    got = {r.id: r.cut for r in find_cut(df, "id", "text").collect()}
    assert got[900] is True and got[903] is False
    assert 901 not in got and 902 not in got
    assert sum(got.values()) <= 4
    assert find_cut(df.limit(0), "id", "text").count() == 0


def test_every_longer_copy_of_a_band_is_met(spark):
    """The longest retelling of a family is changed where the value ends; only a shorter one proves the cut."""
    told = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}ra" for i in range(150))
    value = f"{told} her cousin saw the lantern and said nothing"
    whole = f"{value} to the ferryman."
    edited = [f"{value[:-7]}something before all the other {x} guests that night." for x in ("old", "rich", "loud", "late", "sad", "new", "odd", "shy")]
    rows = [(1, value), (2, whole)] + [(10 + i, x) for i, x in enumerate(edited)] + [(100 + i, v) for i, v in enumerate(values())]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.cut, r.by) for r in find_cut(df, "id", "text").collect()}
    assert got[1] == (True, "copy")


def test_strongly_cut_value_meets_its_copy(spark):
    words = [f"word{i}" for i in range(120)]
    rows = [(i, " ".join([f"{w}x{i}" for w in words]) + ".") for i in range(12)]
    rows += [(100 + i, t[: t.index(" word30x")]) for i, t in rows[:12]]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.cut, r.by) for r in find_cut(df, "id", "text").collect()}
    assert all(got[100 + i] == (True, "copy") for i in range(12))


def test_ends_are_aligned_over_edits():
    whole = "the ferryman kept every receipt in the blue tin and never showed the magistrate any of them again"
    letters = whole.replace(" ", "")
    tail = "keptevryreceiptinthebluetinandnever"[-32:]
    end = _aligned_end(tail, letters)
    assert letters[:end].endswith("never")
    assert _aligned_end("x" * 28 + "ever", letters) == -1
    value = "the ferryman kept every receipt in the blue tin and nevr showed the magi"
    assert ends_early(value, f"{whole}. She left.") == 1


def test_fields_are_kept_apart(spark):
    rows = [(i, "a" if i % 2 else "b", v) for i, v in enumerate(values())] + [(900, "a", values()[7][:-9]), (900, "b", None), (901, None, "alone here.")]
    df = spark.createDataFrame(rows, "id long, field string, text string")
    got = {(r.field, r.id): r.cut for r in find_cut(df, "id", "text", field="field").collect()}
    assert got["a", 900] is True and ("b", 900) not in got and ("", 901) in got
    assert len(got) == 242
