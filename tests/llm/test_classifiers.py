"""Quality, language and toxicity: held-out accuracy on made texts, and edge cases."""

import random
import zlib

from pyspark.sql import functions as F

from sondeline.llm import language_id, quality_classifier, toxicity
from sondeline.llm.common import held_out

EDGES = [(None, None), (9001, None), (9002, ""), (9003, "x"), (9004, "word " * 60_000), (9005, "12 34 !?")]


def syllables(rng, parts, n):
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def make(spark, count, text_of):
    rng = random.Random(7)
    rows = [(k, *text_of(rng, k)) for k in range(count)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + EDGES + [rows[0][:2]], "doc_id long, text string")
    return rows, docs


def test_held_out_split(spark):
    got = spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_toxicity(spark):
    parts, insults = ["la", "mo", "ti", "re", "du", "sen"], ["vilewort", "scumword", "nastyterm"]

    def text_of(rng, k):
        words = syllables(rng, parts, 150).split()
        if k % 4 == 0:
            for _ in range(4):
                words[rng.randrange(150)] = rng.choice(insults)
        return " ".join(words), int(k % 4 == 0)

    rows, docs = make(spark, 600, text_of)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (9001, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, where=toxicity.learnable())
    got = toxicity.score(docs, model).collect()
    right = {r.doc_id: r.predicted for r in got}
    test = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(right[k] == y for k, y in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    assert all(right[k] == 0 for k in (None, 9001, 9002, 9003))
    kept = toxicity.remove_toxic(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {k for k, y in right.items() if not y}
    nothing = toxicity.fit(docs, labels.where("toxic = 1"))
    assert nothing is None and {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxic_words_share_no_count(spark):
    """Ratios equal Kneser-Ney counts by word, though far more words than 2 ** 18 are in the corpus."""
    import numpy as np

    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=30) + (["vile"] if k % 3 == 0 else []) + rng.choices("abcdefgh", k=5)) for k in range(200)]
    fill = [(1000 + k, " ".join(f"w{k}x{i}" for i in range(6000))) for k in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)) + fill, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    check = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(4)) == 0).collect()}
    count, follow = {}, ({}, {})
    for k, t in list(enumerate(texts)) + fill:
        for before, w in zip([None, *t.split()], t.split(), strict=False):
            count[w] = count.get(w, 0) + 1
            if k < 200 and k not in check:
                follow[k % 3 == 0].setdefault(w, set()).add(before)
    total, n = sum(count.values()), [sum(map(len, f.values())) for f in follow]
    free = [1 - sum(max(len(s) - 2, 0) for s in f.values()) / m for f, m in zip(follow, n, strict=True)]
    p = lambda y, w: max(len(follow[y].get(w, ())) - 2, 0) / n[y] + free[y] * count[w] / total
    ratios = toxicity.fit(docs, labels).ratios()
    for w in [*"abcdefgh", "vile", "w1x1", "w99x5999"]:
        assert abs(ratios[w.encode()] - np.log(p(1, w) / p(0, w))) < 1e-4
    assert len(count) > 1 << 18


def test_quality(spark):
    parts = ["la", "mo", "ti", "re", "du", "sen"]

    def text_of(rng, k):
        if k % 3 == 0:
            kind = k % 9 // 3
            words = syllables(rng, parts, 80).split()
            junk = [" ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:8] for _ in range(12))]
            return junk[kind], 0
        return syllables(rng, parts, 80), 1

    rows, docs = make(spark, 600, text_of)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, where=~held_out(F.col("doc_id"), 4, 2), sample=300)
    assert len(model.labels) <= 301
    got = quality_classifier.score(docs, model).collect()
    right = {r.doc_id: r.predicted for r in got}
    test = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(right[k] == y for k, y in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.doc_id in (9001, 9002, 9003)} == {0.0}
    assert quality_classifier.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality_classifier.score(docs, None).collect()} == {0.0}


def test_cosines_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, 200, dtype=np.uint8)) for _ in range(40)]
    x = quality_classifier._logs(texts)
    vectors = quality_classifier._unit(x)
    labels = np.array([k % 2 for k in range(40)], np.float32)
    model = quality_classifier.Model(np.ones(quality_classifier.WIDTH, np.float32), np.eye(quality_classifier.WIDTH, dtype=np.float32), vectors, labels)
    got = quality_classifier.vote(model, texts)
    cosines = vectors @ vectors.T
    for k in range(40):
        near = np.argsort(-cosines[k])[: quality_classifier.NEAREST]
        weight = np.maximum(cosines[k][near].astype(float), 0) ** quality_classifier.SHARPNESS
        assert abs(got[k] - (weight * labels[near]).sum() / weight.sum()) < 1e-5


def test_language(spark):
    kinds = {"aa": ["lo", "ma", "ti", "nu"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["éa", "oux", "ment", "qui"]}

    def text_of(rng, k):
        name = list(kinds)[k % 3]
        return syllables(rng, kinds[name], 60), name

    rows, docs = make(spark, 300, text_of)
    langs = spark.createDataFrame([(k, t, g) for k, t, g in rows] + [(9001, None, "aa"), (9002, "", "dd"), (9006, "xyz", None)], "doc_id long, text string, lang string")
    learned = language_id.learn(langs, where=~held_out(F.col("doc_id"), 5, 0))
    assert [n for n, _ in learned] and {n for n, _ in learned} <= {"aa", "bb", "cc"}
    assert all(len(d) <= 2 * language_id.DICTIONARY for _, d in learned)
    got = {r.doc_id: r for r in language_id.identify(docs, learned).collect()}
    test = [(k, g) for k, _, g in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].lang_pred == g for k, g in test) >= 0.97 * len(test)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (None, 9001, 9002, 9005))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs, []).collect()} == {"und"}
    assert language_id.learn(langs.limit(0)) == []
