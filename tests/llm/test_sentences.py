import pytest

from marquee.llm import sentences as S


@pytest.fixture(scope="module")
def model(spark, small):
    return S.train(S.scan_documents(spark.read.parquet(f"{small}/documents.parquet")))


def cut(model, text):
    return [text[a:b] for a, b in S.units(model, text)]


CASES = [
    ["Dr. Farubeđi je došao u 19.30 u salu br. 4.", "Posle toga je pala kiša."],
    ["Rekla je: „Vidimo se u 12:45.“", "Kapetan trajekta prodaje karte."],
    ["“Is anyone left in row 18?” asked Elliot.", "The town band borrows a boat."],
    ["Čekali smo... i dočekali pravu zimsku priču.", "Kakva noć!", "Da li je to kraj?"],
    ["これで本当に終わりですか？", "監督は「準備はできた。」と言った。", "なんて夜だ！"],
    ["多么美的夜晚！", "他等了很久……终于等到了雪。", "票价是93.4元。"],
    ["हल्की बारिश हुई।", "क्या रात थी!"],
    ["Υπάρχουν ακόμη θέσεις;", "Τι νύχτα!"],
    ["هل بقيت مقاعد؟", "يا لها من ليلة!"],
    ["정말 끝인가요?", "대단한 밤이었다!"],
    ["(Ulaz je slobodan.)", "Film traje 112 min."],
]


@pytest.mark.parametrize("case", CASES, ids=[c[0][:12] for c in CASES])
def test_cases(model, case):
    sep = "" if case[0][-1] in "。！？" else " "
    assert cut(model, sep.join(case)) == case


def test_layout(model):
    text = "Program za vikend\r\n\r\n* Ulaz B, red 25. Novo!\r\n- Drugi\r\n\n13. Večernji termini\n \nRečenica koja se\nnastavlja. Druga je ovde."
    assert cut(model, text) == ["Program za vikend", "* Ulaz B, red 25. Novo!", "- Drugi", "13. Večernji termini", "Rečenica koja se\nnastavlja.", "Druga je ovde."]
    assert cut(model, "1. Prva stavka\n2. Druga stavka\n3. Treća") == ["1. Prva stavka", "2. Druga stavka", "3. Treća"]


def test_nothing_to_split(model):
    assert S.units(model, None) == S.units(model, "") == S.units(model, " \n\t　 ") == []
    assert cut(model, "x") == ["x"]
    assert cut(model, ".") == ["."]


def test_units_cover_everything(spark, small, model):
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        t = r["text"]
        found = S.units(model, t)
        if t is None:
            assert found == []
            continue
        at = 0
        for a, b in found:
            assert at <= a < b and not t[at:a].strip() and not t[a].isspace() and not t[b - 1].isspace()
            at = b
        assert not t[at:].strip()


def test_long_texts(model):
    text = "Kiša je padala celu noć. " * 5_000
    assert len(S.units(model, text)) == 5_000
    assert S.units(model, "a" * 200_000) == [(0, 200_000)]


def test_forward_backward_equals_enumeration():
    import itertools
    import math
    import random

    rnd = random.Random(4)

    for _ in range(100):
        k = rnd.randint(1, 6)
        odds, words = [rnd.uniform(-2, 2) for _ in range(k)], [rnd.choice([0, 1, 2]) for _ in range(k)]
        post = [0.0] * k
        z = 0.0
        for bits in itertools.product((0, 1), repeat=k):
            w = math.exp(sum(o for o, b in zip(odds, bits) if b) + sum(S.SHORT for i in range(1, k) if bits[i] and bits[i - 1] and words[i] <= 1))
            z += w
            for i, b in enumerate(bits):
                post[i] += w * b
        assert S.decide(odds, words) == [p / z > 0.5 for p in post]


def test_unmarked_texts_have_gaps_between_all_words():
    """Latin, Han and Thai alike; texts with marks have them at the marks only."""
    latin = " ".join("voda teče polako ispod starog mosta pored grada uveče".split() * 5)
    assert len(S.gaps(latin, [(0, len(latin))])) == 44
    han = "今天天气很好我们去看电影了他说这部电影非常有意思大家都很喜欢"
    assert len(S.gaps(han, [(0, len(han))])) == len(han) - 1
    marked = latin + ". " + latin + "."
    assert len(S.gaps(marked, [(0, len(marked))])) == 1


def test_long_ends_and_starts_are_read_whole():
    """The certain start and end of a paragraph do not depend on how long its words are."""
    long = "a" * 500
    text = f"{long} {long} kraj."
    _, start, end = S.scan(text, [(0, len(text))])
    assert start == (long, long) and end == (long, "kraj", ".")


def test_documents(spark, model):
    df = spark.createDataFrame([(1, "Prva. Druga.", 5), (2, None, 5), (3, "", 5), (1, "Prva. Druga.", 5), (None, "Treća.", 5)], "doc_id bigint, text string, sent_start int")
    got = [tuple(r) for r in S.split_documents(S.scan_documents(df), model).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 5), (1, 6, 12)] * 2 + [(None, 0, 6)], key=str)
    none = S.scan_documents(df.where("false"))
    assert S.split_documents(none, S.train(none)).count() == 0
