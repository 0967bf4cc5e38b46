import random

from oppflow.llm import stuffing


def test_salad_and_writing(spark):
    r = random.Random(4)
    syllables = ["ba", "do", "ki", "lo", "mer", "nu", "pas", "rie", "sta", "ver", "wo", "zen"]
    word = lambda: "".join(r.choices(syllables, k=3))
    vocabulary = [word() for _ in range(400)]
    sentences = [" ".join(["de", *r.choices(vocabulary, k=4), "van het", *r.choices(vocabulary, k=3)]) + "." for _ in range(120)]
    sentence = lambda: r.choice(sentences)
    writing = [" ".join(sentence() for _ in range(12)) for _ in range(300)]
    towns, words = [f"stad{chr(97 + i)}{chr(97 + j)}oord" for i in range(12) for j in range(12)], [f"woord{chr(97 + i)}x" for i in range(30)]
    writing[5:8] = [" ".join(f"{k}. {sentences[0]} {sentence()}" for k in range(1, 7)) for _ in range(3)]  # repeats a sentence
    spam = [" ".join(f"{w} {t}" for w, t in zip(r.choices(r.sample(words, 3), k=40), r.choices(towns, k=40))) for _ in range(12)]
    rows = [(i, t, 1) for i, t in enumerate(writing + spam + [spam[0], "", None, "kort stukje", writing[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {x.doc_id: x for x in stuffing.stuffed_documents(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].stuffed for i in range(300, 313))
    assert not any(got[i].stuffed for i in [*range(300), 313, 314, 315, 316])
    assert got[313].mean_npmi is None and got[316].mean_npmi == got[0].mean_npmi
    assert stuffing.stuffed_documents(df.limit(0)).collect() == []


def test_pages_of_the_same_keywords_do_not_vouch(spark):
    r = random.Random(5)
    syllables = ["ba", "do", "ki", "lo", "mer", "nu", "pas", "rie", "sta", "ver", "wo", "zen"]
    word = lambda k=3: "".join(r.choices(syllables, k=k))
    vocabulary = [word() for _ in range(400)]
    sentences = [" ".join(["de", *r.choices(vocabulary, k=4), "van het", *r.choices(vocabulary, k=3)]) + "." for _ in range(120)]
    writing = [" ".join(r.choice(sentences) for _ in range(12)) for _ in range(300)]
    keys = [f"trefwoord{chr(97 + i)}" for i in range(20)]
    near = lambda i: f"{keys[i]} {keys[(i + r.choice((1, 2))) % 20]}"
    spam = [" ".join(f"{near(r.randrange(20))} {r.choice(vocabulary)}" for _ in range(15)) for _ in range(40)]
    plain = [" ".join(keys)]  # all its pairs are those of the others
    df = spark.createDataFrame(list(enumerate(writing + spam + plain)), "doc_id long, text string")
    got = {x.doc_id: x for x in stuffing.stuffed_documents(df).collect()}
    assert all(got[i].stuffed for i in range(300, 340)) and got[340].stuffed, got[340]
    assert not any(got[i].stuffed for i in range(300))


def test_words():
    assert stuffing.words("Zaak2025, de-zaak\u200bA") == ["zaak0", "de", "zaaka"]
