"""Bounds under repeated rows, ties, clashing columns, and fits held against plain loops."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sondeline.llm import decontaminate, language_id, quality_classifier, simhash, suffix_dedup, toxicity
from sondeline.sources import staging


def words(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_languages_of_long_texts_only_are_learned(spark):
    rng = random.Random(1)
    known = {letters: words(rng, 150, letters).split() for letters in ("zqxjkw", "etaoin")}
    say = lambda n, letters: " ".join(rng.choices(known[letters], k=n))
    rows = [(k, say(3000, "zqxjkw"), "zz") for k in range(6)] + [(10 + k, say(40, "etaoin"), "en") for k in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = dict(language_id.learn(d))
    assert set(learned) == {"zz", "en"} and all(len(x) <= language_id.DICTIONARY for x in learned.values())
    ask = spark.createDataFrame([(1, say(50, "zqxjkw")), (2, say(50, "etaoin"))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(ask, language_id.learn(d)).collect()} == {1: "zz", 2: "en"}


def test_repeated_rows_do_not_grow_dictionaries(spark):
    text = words(random.Random(2), 1500, "abcdef")
    d = spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("aa").alias("lang"))
    ((name, content),) = language_id.learn(d)
    assert name == "aa" and len(content) <= len(text)


def test_languages_with_most_documents_are_learned_beyond_the_bound(spark):
    """Every text is answered, however many languages a table has; of equal ones the names in order are learned."""
    rng = random.Random(8)
    rows = [(100 * g + k, words(rng, 80, "abcdef"), name) for g, (name, n) in enumerate((("dd", 2), ("bb", 2), ("cc", 3), ("aa", 1))) for k in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    before, language_id.LANGUAGES = language_id.LANGUAGES, 2
    try:
        learned = language_id.learn(d)
    finally:
        language_id.LANGUAGES = before
    assert [name for name, _ in learned] == ["cc", "bb"]
    assert {r.lang_pred for r in language_id.identify(d, learned).collect()} <= {"bb", "cc"}


def test_languages_equal_plain_compression(spark):
    """Sizes by the library's plain calls, one dictionary and piece at a time: choice, score, ties and rejection."""
    import zstandard as z

    rng = random.Random(9)
    parts = {"aa": "abcdefg", "bb": "fghijkl", "cc": "opqrstu"}
    learned = [(name, words(rng, 700, letters).encode()) for name, letters in parts.items()]
    learned.append(("twin", learned[0][1]))  # the same dictionary: the first wins, by no margin
    texts = ["", None, "12 !", "x", "É", "ab " * 30_000]
    texts += [words(rng, n, parts[a] + parts[b]) for a in parts for b in parts for n in (1, 3, 20, 9_000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for given in (learned, learned[:3], learned[:1], []):
        got = {r.doc_id: r for r in language_id.identify(d, given).collect()}
        for k, text in enumerate(texts):
            low = (text or "").lower()
            if not given or not re.search(r"[^\W\d_]", low):
                assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0, True)
                continue
            raw, sizes = low.encode(), []
            for _, content in given:
                size = 0
                for at in range(0, len(raw), 16384):
                    made = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                    plain = z.ZstdCompressor(level=6, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)
                    size += len(plain.compress(raw[at : at + 16384]))
                sizes.append(size)
            least = min(sizes)
            share = 1 / sum(2.0 ** (-min(s - least, 60) / 2) for s in sizes)
            others = sorted(sizes)[1:]
            narrow = bool(others) and others[0] - least < 0.01 * len(raw)
            assert got[k].lang_pred == given[sizes.index(least)][0] and abs(got[k].score - share) < 1e-9 and got[k].rejected == narrow, k


def test_neighbours_vote_as_in_plain_loops():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 12)).encode() for _ in range(60)]
    basis = np.linalg.qr(rng.normal(size=(quality_classifier.WIDTH, 8)))[0].astype(np.float32)
    weights = rng.uniform(1, 2, quality_classifier.WIDTH).astype(np.float32)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    vector = lambda t: unit(np.log1p(quality_classifier.counts(t)) * weights @ basis)
    labelled = texts[:50] + texts[:20]  # copies, labelled otherwise
    model = quality_classifier.Model(weights, basis, np.array([vector(t) for t in labelled], np.float32), np.array([k % 2 for k in range(50)] + [(k + 1) % 2 for k in range(20)], np.float32))
    got = quality_classifier.vote(model, [*texts, None, b""])
    for t, found in zip(texts, got, strict=False):
        cosines = [float(vector(t) @ v) for v in model.vectors]
        last = sorted(cosines, reverse=True)[quality_classifier.NEAREST - 1]
        near = [(c, y) for c, y in zip(cosines, model.labels, strict=True) if c >= last - quality_classifier.TIE and c > 0]
        total = sum(c**quality_classifier.SHARPNESS for c, _ in near)
        assert abs(found - sum(y * c**quality_classifier.SHARPNESS for c, y in near) / total) < 1e-3
    assert list(got[-2:]) == [0, 0]
    order = np.random.default_rng(4).permutation(70)
    mixed = quality_classifier.Model(weights, basis, model.vectors[order], model.labels[order])
    assert np.allclose(quality_classifier.vote(mixed, texts), got[:60], atol=1e-6)  # ties don't hang on the order


def test_repeated_ids_are_learned_once(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k % 4, words(rng, 30, "abc" if k % 2 else "xyz")) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)] + [(3, 1), (2, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    assert len(model.labels) == 4 and sorted(model.labels.tolist()) == [0, 0, 1, 1]


def test_toxicity_counts_equal_plain_loops(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary[: 20 + 20 * (k % 2)], k=rng.randrange(0, 60)))) for k in range(120)]
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    chosen = {r.doc_id: r.toxic for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(4)) != 0).collect()}
    count, follows = defaultdict(int), {0: defaultdict(set), 1: defaultdict(set)}
    for k, text in rows:
        before = ""
        for w in text.split():
            count[w] += 1
            if k in chosen:
                follows[chosen[k]][w].add(before)
            before = w
    total = sum(count.values())
    log, other = {}, {}
    for label, seen in follows.items():
        all_pairs = sum(map(len, seen.values()))
        kept = {w: max(len(b) - toxicity.DISCOUNT, 0) / all_pairs for w, b in seen.items()}
        free = 1 - sum(kept.values())
        log[label] = {w: math.log(kept.get(w, 0) + free * count[w] / total) for w in count}
        other[label] = math.log(free)
    assert abs(model.other - (other[1] - other[0])) < 1e-9
    ratios = model.ratios()
    for w in count:
        assert abs(ratios[w.encode()] - (log[1][w] - log[0][w])) < 1e-5, w


def test_clashing_columns_pass(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    names = ["_stay", "_k1", "_c", "_n", "_h1", "_spans", "_items", "_score", "_toxic", "hit_spans", "n_hit", "k1", "f", "component"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names) + ", m map<string,int>"
    rows = [(k, text if k != 2 else "another text of its own", 9, *(f"{n}{k}" for n in names), {"a": k}) for k in (1, 2, 3)]
    d = spark.createDataFrame(rows, schema)
    assert {r.doc_id: (r._stay, r._n, r.m) for r in simhash.deduplicate(d).collect()} == {1: ("_stay1", "_n1", {"a": 1}), 2: ("_stay2", "_n2", {"a": 2})}
    assert sorted((r.doc_id, r._spans, r.n_chars) for r in suffix_dedup.remove_repeats(d, length=50).collect()) == [(1, "_spans1", 0), (2, "_spans2", 9), (3, "_spans3", 0)]
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert sorted((r._score, r._toxic) for r in toxicity.remove_toxic(d, labels).collect()) == [(f"_score{k}", f"_toxic{k}") for k in (1, 2, 3)]
    items = spark.createDataFrame([(1, "another text"), (2, "six seven eight")], "item_id long, text string")
    for shard in (2, 100):
        found = decontaminate.find_spans(d.drop("hit_spans", "n_hit"), items, shard_words=shard).collect()
        assert {r.doc_id: ([(s.start, s.end) for s in r.hit_spans], r.hit_items, r._spans) for r in found} == {1: ([(5, 8)], ["2"], "_spans1"), 2: ([(0, 2)], ["1"], "_spans2"), 3: ([(5, 8)], ["2"], "_spans3")}
    kept = decontaminate.decontaminate(d, items, per_word=2, least_words=2).collect()
    assert {r.doc_id: (r.text, r.n_chars, r.hit_spans) for r in kept} == {2: (" of its own", 11, "hit_spans2"), 1: (text.replace("six seven eight", ""), len(text) - 15, "hit_spans1"), 3: (text.replace("six seven eight", ""), len(text) - 15, "hit_spans3")} or len(kept) < 3


def test_spans_are_united_in_order():
    rng = random.Random(7)
    lists = [[(a := rng.randrange(200), a + rng.randrange(1, 30)) for _ in range(rng.randrange(1, 12))] for _ in range(50)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(50)), pa.array(range(50), pa.int32()), pa.array([[{"start": a, "end": z} for a, z in x] for x in lists], kind)], names=["k1", "k2", "spans"]
    )
    (out,) = suffix_dedup._united([batch.slice(5)])
    for x, got in zip(lists[5:], out.column("spans").to_pylist(), strict=True):
        assert [(s["start"], s["end"]) for s in got] == decontaminate.united(x)
    long = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1], pa.int32()), pa.array([[{"start": 3 * k, "end": 3 * k + 2} for k in range(200_000)]], kind)], names=["k1", "k2", "spans"])
    assert len(next(suffix_dedup._united([long])).column("spans")[0]) == 200_000


def test_tables_of_the_suffix_stage_go_when_released(spark):
    d = spark.createDataFrame([(k, "abcdefghij" * 30) for k in range(3)], "doc_id long, text string")
    held = staging.written_tables()
    before = {t.name for t in spark.catalog.listTables()}
    out = staging.written(suffix_dedup.remove_repeats(d), "out")
    assert {t.name for t in spark.catalog.listTables()} - before
    staging.release(held, keep=(out,))
    assert {t.name for t in spark.catalog.listTables()} == before and out.count() == 3
    assert staging.written_tables() == held + 1
    assert not any(re.search("pass1|cells", p) for _, p, _ in staging._written[held:])
