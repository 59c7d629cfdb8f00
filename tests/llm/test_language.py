import pytest
from pyspark.sql import functions as F

from quirework.llm import language, queries

EN = "the house stood near the river and when the winter came the old painter closed every window because the wind from the mountain was cold and nobody walked along the road to the market anymore"
DE = "das haus stand an dem fluss und als der winter kam schloss der alte maler jedes fenster weil der wind von den bergen kalt war und niemand mehr auf der strasse zum markt ging"
FR = "la maison se trouvait au bord de la rivière et quand l’hiver arriva le vieux peintre ferma chaque fenêtre parce que le vent de la montagne était froid et personne ne marchait plus sur la route du marché"


@pytest.fixture(scope="module")
def detector():
    return language.Detector([(code, f"{t} {t}") for code, t in (("en", EN), ("de", DE), ("fr", FR)) for _ in range(5)])


def test_whole_and_mixed_texts(detector):
    assert {s[3] for s in detector.segments(EN)} == {"en"}
    mixed = detector.segments(f"{EN}. {EN}. {DE}. {EN}")
    assert [s[3] for s in mixed] == ["en", "de", "en"] and all(0 < s[4] < 1 for s in mixed)
    start, end, n, lang, _ = mixed[1]
    assert end - start == n == len(DE.split()) and start == 2 * len(EN.split())
    assert [s[3] for s in detector.segments(FR.encode().decode("cp1252"))] == ["fr"]  # garbled words keep their language


@pytest.mark.parametrize("text", [None, "", "12 34 — 56", "zxq wvk jjq kkw qqz xxv jkq zzw qxk vvj kqz jxw", "a"])
def test_nothing_to_find(detector, text):
    assert detector.segments(text) == []


def test_short_stretch_is_its_length(detector):
    got = [s for s in detector.segments(f"{EN} {' '.join(DE.split()[:6])} {EN}") if s[3] == "de"]
    assert not got or got[0][2] <= 6


@pytest.mark.parametrize("before", range(24, 24 + language.BLOCK))
def test_stretch_across_blocks_is_found(detector, before):
    words, stretch = EN.split() * 4, DE.split()[8:22]
    got = [s for s in detector.segments(" ".join([*words[:before], *stretch, *words[before:]])) if s[3] == "de"]
    assert len(got) == 1 and got[0][2] >= 12 and before - 1 <= got[0][0] and got[0][1] <= before + len(stretch) + 1


def test_a_text_does_not_depend_on_the_one_before(detector):
    mixed = f"{' '.join(FR.split()[:14])} {EN} {' '.join(DE.split()[:13])} {EN}"
    alone = detector.segments(mixed)
    for other in (EN, DE, FR):
        detector.segments(other)
        assert detector.segments(mixed) == alone


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en_AU": "en", "ger": "de", "Deutsch": "de", "Türkçe": "tr", "pt-BR": "pt", "und": None, "mul": None, "": None, "N/A": None, " French ": "fr", "none": None, None: None, "русский": "ru", "english-ish": None}
    frame = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r[0]: r[1] for r in frame.select("l", language.declared(F.col("l"))).collect()} == cases


def test_column_and_sample(spark, detector):
    frame = spark.createDataFrame([(1, EN, "en"), (1, EN, "en"), (2, None, "en"), (3, "", None), (4, DE * 30, "de")], "id int, text string, label string")
    got = {r.id: [s.lang for s in r.s] for r in frame.select("id", language.segments(F.col("text"), detector).alias("s")).collect()}
    assert got[1] == ["en"] and got[2] == [] and got[3] == [] and "de" in got[4]
    assert [label for label, _ in language.sample(frame.where("char_length(text) > 100").withColumn("text", F.repeat("text", F.lit(2))), frame, "id", "text", "label")] == ["en", "de"]
    assert language.sample(frame.where("false"), frame, "id", "text", "label") == []
    assert language.Detector([]).segments(EN) == []


def test_too_many_common_words_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "COMMON_WORDS_BOUND", 2)
    spark.createDataFrame([(i, i, EN) for i in range(3)], "chapter_uid long, book_id long, content string").write.parquet(f"{tmp_path}/chapters.parquet")
    spark.createDataFrame([(1, None, 1, ["en"])], "book_id long, harvested_at timestamp, harvest_id long, languages array<string>").write.parquet(f"{tmp_path}/epub_metadata.parquet")
    spark.createDataFrame([("en", w) for w in ("the", "and", "was")], "lang string, word string").write.parquet(f"{tmp_path}/common_words.parquet")
    with pytest.raises(ValueError, match="bound"):
        queries.p2_found(spark, str(tmp_path))


def test_every_language_has_its_codes_and_names(spark):
    names = language.language_names()
    cases = {"fi": "fi", "fin": "fi", "finnish": "fi", "suomi": "fi", "alb": "sq", "sqi": "sq", "zh": "zh", "chi": "zh", "zho": "zh", "chinese": "zh", "cymraeg": "cy", "wel": "cy", "dut": "nl", "gre": "el"}
    assert {k: names.get(k) for k in cases} == cases and not {"mul", "und", "zxx", "mis"} & set(names) and len(set(names.values())) > 180


def test_result_does_not_depend_on_partitions(spark, detector):
    texts = [EN, DE, f"{EN} {DE}", f"{FR} {' '.join(DE.split()[:13])} {FR}", "", f"{DE} {EN} {FR}"] * 5
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = [sorted((r.id, str(r.s)) for r in frame.repartition(k).select("id", language.segments(F.col("text"), detector).alias("s")).collect()) for k in (1, 3, 7)]
    assert found[0] == found[1] == found[2]


def test_texts_are_read_once_where_the_result_is_filtered(spark, detector):
    frame = spark.createDataFrame([(1, EN)], "id int, text string").select("id", F.explode(language.segments(F.col("text"), detector)).alias("s")).where("s.n_words > 3")
    assert frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
