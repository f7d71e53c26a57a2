import unicodedata

from marquee.llm import lookalikes as L


def model(spark, texts=("Vukovi sa planine", "Балада о мору", "Капетан и лађа", "Robot i zvezda", "Povratak kapetana")):
    return L.train(spark.createDataFrame([(t,) for t in texts], "value string"))


FORMS = {
    "Рovratаk u Turіdote": "Povratak u Turidote", "Ｚｉｍｓｋａ priča": "Zimska priča", "Pis⁠mo za Kov﻿inrku": "Pismo za Kovinrku", "Sestre　Sadjetiro": "Sestre Sadjetiro", "𝐎𝐝𝐦𝐚𝐳𝐝𝐚": "Odmazda", "Ostrvo‑Lim": "Ostrvo-Lim", "ПИCМO ЗА МЕНЕ": "ПИСМО ЗА МЕНЕ", "feǌer": "fenjer",
    "WOLVES OF DEFAVIÐU": "WOLVES OF DEFAVIĐU", "Neđičepe": "Neđičepe", "3𝐃": "3D", "Noć Ⅲ": "Noć III", "nονi svet": "novi svet", "Dramа\xa0": "Drama ", "Dtес̌аnu": "Dtečanu", "4DХ": "4DX",
}
SAME = ["Povratak u Turidote", "ПИСМО ЗА ТЕБЕ", "Film о љубави", "  два  razmaka ", "ZASTO CUTI", "Za�to �uti Lopu�oja", "Ratnici ÄŒobenivo: NoÄ‡ veÅ¡tica", "Å\xa0apat", "Šapat – drugi deo…", "Café Müller", "Αθήνα", "Петербург, ы", "", "\t"]


def test_forms(spark):
    m = model(spark)
    for k, v in FORMS.items():
        assert m.text(k) == v, k
        assert m.text(v) == v
    for s in SAME:
        assert m.text(s) == s, s
    assert m.text(None) is None


def test_long_text_is_read_whole(spark):
    m = model(spark)
    assert m.text("ab " * 100_000 + "Ａ") == "ab " * 100_000 + "A"


def test_held_out_accuracy(spark):
    """Words disguised with look-alikes of the other script come back, for words that the model has not seen."""
    import random

    rnd = random.Random(6)
    make = lambda cs, vs: "".join(rnd.choice(cs) + rnd.choice(vs) for _ in range(4))
    latin = [make("bdfgklmprstvz", "aeiou") for _ in range(400)]
    cyr = [make("бдгклмпрствз", "аеиоу") for _ in range(400)]
    m = model(spark, latin[:200] + cyr[:200])
    to_cyr, to_lat = str.maketrans("aeop", "аеор"), str.maketrans("аеор", "aeop")
    good = n = 0
    for words, table in ((latin[200:], to_cyr), (cyr[200:], to_lat)):
        for w in words:
            d = "".join(c.translate(table) if rnd.random() < 0.5 else c for c in w)
            if d != w and not all(unicodedata.name(c).split()[0] == unicodedata.name(d[0]).split()[0] for c in d):
                n += 1
                good += m.text(d) == w
    assert n > 200 and good / n > 0.98


def test_disguised(spark):
    listing = spark.createDataFrame([(1, "Vuk​", ["Dramа", None, "Drama"], "x", 0), (2, None, None, "y", 1), (3, "Vuk", [], None, None), (1, "Vuk​", ["Dramа", None, "Drama"], "x", 0)], "listing_id bigint, raw_title string, genres array<string>, value string, pos int")
    films = spark.createDataFrame([(7, "Ｖuk", "f"), (8, None, None)], "id bigint, title string, form string")
    got = sorted((r["src"], r["row_id"], r["field"], r["pos"], r["form"]) for r in L.disguised(L.values_of(listing, films)).collect())
    assert got == sorted([("listing", 1, "raw_title", 0, "Vuk"), ("listing", 1, "genres", 0, "Drama")] * 2 + [("title_dim", 7, "title", 0, "Vuk")])


def test_empty(spark):
    listing = spark.createDataFrame([], "listing_id bigint, raw_title string, genres array<string>")
    films = spark.createDataFrame([], "id bigint, title string")
    assert L.disguised(L.values_of(listing, films)).count() == 0


def test_replaces_clashing_column(spark):
    df = spark.createDataFrame([("Ａ", "old")], "value string, form string")
    assert [tuple(r) for r in L.unify(df, model(spark)).collect()] == [("Ａ", "A")]


def test_words_of_a_third_script_stay():
    """Greek titles stay Greek, even of letters that all look Latin; Greek letters inside a Latin title do not."""
    m = L.Model({})
    for t in ("ΝΑΙ", "ΚΑΤΙ", "ΜΑΤΙΑ", "ΤΟ ΟΝΟΜΑ", "Η ζωή είναι ωραία", "ΤΟ ΟΝΟΜΑ film λόγος"):
        assert m.text(t) == t
    assert m.text("ΝΑΙ je film") == "NAI je film" and m.text("Νοć") == "Noć"
