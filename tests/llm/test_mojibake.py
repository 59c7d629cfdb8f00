from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.llm import mojibake as m

CLEAN = [
    "Le café est fermé pendant l’été, et la fenêtre reste ouverte à côté de la forêt.", "Der Köhler ging über die Brücke; die Größe des Flusses überraschte ihn – „schön“, sagte er.",
    "Мы были в лесу, когда началась гроза и река вышла из берегов.", "Příběh začíná na břehu řeky, kde stál starý dům a důležitý kůň.", "La niña soñó con montañas y un corazón de azúcar.",
    "São Paulo não é só uma cidade; é um coração que bate no sertão.", "Το σπίτι είναι κοντά στο βουνό και η θάλασσα λάμπει.", "Yağmur yağıyor, çocuklar kış güneşinde oynuyor.", "Zażółć gęślą jaźń, mówiła wdowa nad źródłem.",
]


@pytest.fixture(scope="module")
def counts(spark):
    texts = spark.createDataFrame([(t,) for t in CLEAN for _ in range(200)] + [(None,), ("",), ("plain",)], "text string")
    return m.train(texts)


def read_as(text, wrong, right="utf-8"):
    return "".join(m.byte_to_char(wrong).get(b, chr(b)) if b > 127 else chr(b) for b in text.encode(right))


@pytest.mark.parametrize("wrong", ["cp1252", "cp1251", "cp437", "mac_roman", "cp850"])
@pytest.mark.parametrize("text", CLEAN)
def test_utf8_round_trip(counts, text, wrong):
    garbled = read_as(text, wrong)
    assert m.Model(counts).restore(garbled)[0] == text


@pytest.mark.parametrize(("text", "right"), [(CLEAN[3], "cp1250"), (CLEAN[2], "cp1251"), (CLEAN[6], "cp1253"), (CLEAN[7], "cp1254")])
def test_single_byte_round_trip(counts, text, right):
    garbled = read_as(text, "cp1252", right)
    restored, spans = m.Model(counts).restore(garbled)
    assert spans and sum(a == b for a, b in zip(restored, text)) > 0.9 * len(text)


def test_no_line_is_refused_before_viterbi():
    # so few texts that single tokens give weak evidence
    model, lines = m.Model(Counter(g for t in CLEAN for w in t.split() for g in m.grams(w) for _ in range(20))), 0
    for right, wrong in m.SINGLE_BYTE:
        for text in CLEAN:
            words = [w for w in text.split() if not w.isascii()]
            for n in range(1, len(words) + 1):
                line = "".join(m.byte_to_char(wrong).get(b, "?") if b > 127 else chr(b) for b in " ".join(words[:n]).encode(right, "ignore"))
                restored, spans = model.label(line)
                lines += bool(spans)
                assert model.restore(line) == (restored, [(0, *s) for s in spans])
    assert lines > 100


def test_twice_entities_and_lost(counts):
    model = m.Model(counts)
    twice = read_as(read_as(CLEAN[0], "cp1252"), "cp1252")
    assert model.restore(twice)[0] == CLEAN[0]
    assert model.restore("la caf&Atilde;&copy; est")[0] == "la café est"
    text, spans = model.restore("le caf� est")
    assert text == "le caf� est" and spans[0][3] == "lost"


@pytest.mark.parametrize("text", [*CLEAN, "", None, "ascii only &amp; more", "x ½ ± 3 °C – №", "a" * 100_000, "│ a │ b │\n├───┼───┤"])
def test_clean_text_is_left_alone(counts, text):
    got, spans = m.Model(counts).restore(text)
    assert got == text and (not spans or text and "│" in text)


def test_column(spark, counts):
    frame = spark.createDataFrame([(1, read_as(CLEAN[0], "cp1252")), (2, CLEAN[0]), (3, None), (4, ""), (1, read_as(CLEAN[0], "cp1252"))], "id int, text string")
    got = sorted((r.id, r.r.restored, r.r.n_spans > 0) for r in frame.select("id", m.restored(F.col("text"), counts).alias("r")).collect())
    assert got == [(1, CLEAN[0], True)] * 2 + [(2, None, False), (3, None, False), (4, None, False)]
    assert m.train(frame.where("false")) == {}
    assert m.Model({}).restore("café")[0] == "café"


def test_a_garbled_passage_of_a_clean_text_is_decoded():
    clean = f"{CLEAN[0]} {CLEAN[3]} {CLEAN[4]} " * 20
    assert m.plain(clean) == clean and m.plain(clean + read_as(CLEAN[6], "cp1252")) == clean + CLEAN[6]


def test_only_frequent_trigrams_reach_the_driver(spark, monkeypatch):
    texts = spark.createDataFrame([(t,) for t in CLEAN] + [(CLEAN[0],)] * 500, "text string")
    every, sizes, frame = m.train(texts, min_share=0), [], type(texts)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    got = m.train(texts, min_share=0.01)
    assert got == {g: n for g, n in every.items() if n >= 0.01 * sum(every.values())} and max(sizes) == len(got) <= 100 < len(every)


def test_counts_do_not_depend_on_partitions(spark):
    texts = ["žluťoučký kůň úpěl", "Ã©tÃ© vu", "été été été à la plage", "naïve café", "déjà vu �", None, "", "plain"] * 4
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = [m.train(frame.repartition(k)) for k in (1, 4, 9)]
    assert counts[0] == counts[1] == counts[2] and any("é" in g for g in counts[0]) and not any("Ã" in g or "ã" in g for g in counts[0])
