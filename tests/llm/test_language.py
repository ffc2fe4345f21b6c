import math
import random
from collections import Counter

from pyspark.sql import functions as F

from pagelode.llm.language import DIMENSIONS, UNKNOWN, identify, train
from tests.llm.tables import clashing, documents, rows

SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "sho"], "bb": ["eau", "ille", "ont", "que", "ré"]}


def sample(language, seed, count):
    pick = random.Random(seed)
    words = ["".join(pick.choices(SYLLABLES[language], k=pick.randrange(1, 4))) for _ in range(count)]
    return " ".join(words)


def labelled(spark):
    data = [(sample(lang, i, 3 + i % 60), lang) for lang in SYLLABLES for i in range(150)]
    return spark.createDataFrame([*data, (None, "aa"), ("text", None), ("123 !", "bb")], "text string, lang string")


def test_held_out_texts_are_identified(spark):
    model = train(labelled(spark), sample_per_language=80)
    tests = [(sample(lang, 1000 + i, 12), lang) for lang in SYLLABLES for i in range(50)]
    found = identify(spark.createDataFrame(tests, "text string, lang string"), F.col("text"), model)
    assert found.where("language.lang = lang and not language.rejected").count() >= 98


def test_odd_texts(spark):
    model = train(labelled(spark))
    docs = documents(spark)
    found = identify(clashing(docs), F.col("text"), model)
    assert found.count() == docs.count()
    for row in found.select("text", "language.*").collect():
        assert 0 <= row["score"] <= 1
        letters = any(map(str.isalpha, row["text"] or ""))
        assert row["lang"] in (SYLLABLES if letters else {UNKNOWN})
        assert row["rejected"] or letters


def test_foreign_script_is_rejected(spark):
    model = train(labelled(spark))
    docs = documents(spark, ["漢字仮名交じり文" * 20])
    assert identify(docs, F.col("text"), model).first()["language"]["rejected"]


def test_training_is_repeatable(spark):
    found = [train(labelled(spark).repartition(n), sample_per_language=40) for n in (1, 5)]
    assert found[0].languages == found[1].languages
    assert abs(found[0].centroids - found[1].centroids).max() < 1e-5


def test_without_labels_nothing_is_known(spark):
    model = train(spark.createDataFrame([], "text string, lang string"))
    found = identify(documents(spark), F.col("text"), model)
    assert {(r["lang"], r["score"]) for r in found.select("language.*").collect()} == {(UNKNOWN, 0.0)}
    assert rows(identify(documents(spark, []), F.col("text"), model)) == []


def test_foreign_text_longer_than_all_labelled_is_rejected(spark):
    model = train(labelled(spark))
    docs = documents(spark, ["漢字仮名交じり文" * 20_000, sample("aa", 7, 30_000)])
    found = identify(docs, F.col("text"), model).orderBy("doc_id").select("language.rejected").collect()
    assert [r["rejected"] for r in found] == [True, False]
    assert min(floors.min() for floors in model.floors.values()) > 0


def test_copies_of_a_text_do_not_fill_the_sample(spark):
    single = labelled(spark).where("lang = 'aa'")
    first = single.orderBy(F.xxhash64("text")).select("text").first()[0]
    copies = spark.createDataFrame([(first, "aa")] * 600, "text string, lang string")
    models = [train(docs, sample_per_language=100) for docs in (single, single.unionByName(copies))]
    assert [len(model.centroids) for model in models] == [4, 4]


def plain_counts(text):
    """Buckets of the 2- and 3-grams of the letters, worked out one by one."""
    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    found = Counter()
    for size in (2, 3):
        for i in range(len(words) - size + 1):
            mixed = size
            for c in words[i : i + size]:
                mixed = (mixed + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                mixed ^= mixed >> 29
            found[(mixed >> 40) % DIMENSIONS] += 1
    return found


def plain_cosines(text, model):
    counts = plain_counts(text)
    vector = {i: (1 + math.log(n)) * float(model.idf[i]) for i, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in vector.values()))
    cosines = [sum(float(centre[i]) * x / norm for i, x in vector.items()) for centre in model.centroids]
    return cosines, counts.total()


def test_nearest_and_floors_equal_a_plain_version(spark):
    known = labelled(spark)
    model = train(known, sample_per_language=60)
    texts = [sample(lang, 2000 + i, 1 + i) for lang in SYLLABLES for i in range(12)] + ["漢字仮名", "zzz xyx"]
    found = identify(documents(spark, texts), F.col("text"), model).orderBy("doc_id")
    for text, row in zip(texts, found.select("language.*").collect(), strict=True):
        cosines, size = plain_cosines(text, model)
        best = max(cosines)
        lang = model.languages[cosines.index(best)]
        assert row["lang"] == lang and abs(row["score"] - max(0.0, best)) < 1e-4
        floor = model.floors[lang][min(31, size.bit_length() - 1)]
        assert row["rejected"] == (best < floor) or abs(best - floor) < 1e-4
    told = [tuple(r) for r in known.where("text is not null and lang is not null").collect()]
    for lang, floors in model.floors.items():
        near = []
        for text, own in told:
            if own == lang and any(map(str.isalpha, text)):
                cosines, _ = plain_cosines(text, model)
                near.append(max(c for c, name in zip(cosines, model.languages, strict=True) if name == lang))
        assert all(0 < floor <= 0.5 * sorted(near)[len(near) // 2] + 1e-3 for floor in floors)
        assert floors.tolist() == sorted(floors.tolist())


def test_noisy_labels_lower_the_floors_of_their_language_alone(spark):
    noise = [("".join(chr(0x4E00 + (i * 97 + j * 31) % 20_000) for j in range(30)), "bb") for i in range(30)]
    noise = spark.createDataFrame(noise, "text string, lang string")
    clean, noisy = train(labelled(spark)), train(labelled(spark).unionByName(noise))
    assert (noisy.floors["bb"] < 0.9 * clean.floors["bb"]).any()
    assert (noisy.floors["aa"] > 0.8 * clean.floors["aa"]).all()
