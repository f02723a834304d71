from collections import Counter

from palimpsest.llm.language import Model, analyse, confidence, decide, label_language, language_segments, train, with_languages

SAMPLES = {
    "en": "The old house was dark and nobody in the village knew what they had seen that night. She said that it was not hers.",
    "fr": "La vieille maison était sombre et personne dans le village ne savait ce que les autres avaient vu. Elle disait que non.",
    "de": "Das alte Haus war dunkel und niemand in dem Dorf wusste, was sie in der Nacht gesehen hatte. Sie sagte, es war nicht so.",
    "es": "La casa vieja estaba oscura y nadie en el pueblo sabía lo que habían visto aquella noche. Ella dijo que no era suya.",
    "pt": "A casa velha estava escura e ninguém na aldeia sabia o que eles tinham visto naquela noite. Ela disse que não era sua.",
    "ru": "Старый дом был тёмным, и никто в деревне не знал, что они видели той ночью. Она сказала, что это было не её.",
    "zh": "那座老房子很暗，村里没有人知道他们那天晚上看见了什么。她说那不是她的东西。",
    "ja": "古い家は暗くて、村の誰もその夜に何を見たのか知らなかった。彼女はそれが自分のものではないと言った。",
}


def table(spark):
    rows = [(i * 10 + j, t, lang, 1) for i, (lang, t) in enumerate(SAMPLES.items()) for j in range(5)]
    rows += [(900, SAMPLES["fr"], "en", 1), (901, SAMPLES["zh"] + SAMPLES["en"], None, 1), (902, None, "en", 1), (903, " \n", "", 1), (904, "123 456", "en", 1)]
    rows += [(905, SAMPLES["zh"] * 3 + "他低声说“Hello my friend”。" + SAMPLES["zh"], "zh-CN", 1)]
    return spark.createDataFrame(rows, "id long, text string, label string, lang int")


def test_languages(spark):
    df = table(spark)
    model = train(df, "id", "text", "label")
    found = {}
    for r in with_languages(df.select("id", "text", "label"), "id", "text", model, ["label"]).filter("main or sentences >= 2").collect():
        found.setdefault(r.id, set()).add(r.lang)
        assert 0 < r.confidence <= 1
    for i, lang in enumerate(SAMPLES):
        assert found[i * 10] == {lang}
    assert found[900] == {"fr"}
    assert found[901] == {"zh", "en"}
    assert found[905] == {"zh"}
    assert not {902, 903, 904} & set(found) or found.get(904)
    segments = sorted((r.start, r.end, r.lang) for r in language_segments(df, "id", "text", model).filter("id = 901").collect())
    assert [s[2] for s in segments] == ["zh", "en"]
    assert with_languages(df.limit(0), "id", "text", model).count() == 0


def test_labels(spark):
    rows = [("zh-CN", "zh"), ("EN", "en"), ("en_GB", "en"), ("und", None), (" ", None), (None, None), ("unknown", None), ("xx", "xx")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    assert [r.x for r in df.select(label_language(df.a).alias("x")).collect()] == [b for _, b in rows]


def test_backoff_to_shorter_ngrams():
    model = Model({"fr": Counter({"maisonnette": 50}), "de": Counter({"häuschen": 50})})
    unseen = model.unseen("maisonnettes")
    assert unseen.argmax() == 3
    assert not model.unseen("☃").any()
    (found,) = analyse(model, ["maisonnette et une maisonnettes dans la maisonnette."])
    assert decide(found)[0] == 3
    assert confidence(found[0][3], 3, 40) > 0.5
