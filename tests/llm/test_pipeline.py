import random

import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(9)
    parts = ["la", "mo", "ti", "re", "du", "sen", "vor", "kel"]
    text = lambda n: " ".join("".join(rng.choices(parts, k=3)) + str(rng.randrange(100)) for _ in range(n))
    passage, item = text(60), " ".join(f"bench{k}" for k in range(20))
    rows = [(k, text(80)) for k in range(200)]
    for k in range(0, 60, 2):
        rows[k] = (k, f"{rows[k][1]} vileword nastyterm vileword scumword")
    rows[101] = (101, f"{rows[101][1]} {passage}")
    rows[103] = (103, f"{passage} {rows[103][1]}")
    rows[105] = (105, f"{rows[105][1]} {item}")
    rows[107] = (107, rows[109][1])
    docs = [(k, t, "en", "s", len(t)) for k, t in rows] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k < 60 and k % 2 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frames, d = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        d = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {n: {r.doc_id for r in f.collect()} for n, f in frames.items()}
    assert ids["toxicity"] == {k for k in [*range(200), 300, 301] if not (k < 60 and k % 2 == 0)}
    assert ids["simhash_near_dedup"] == ids["toxicity"] - {109, 301}
    cut = {r.doc_id: r.text for r in frames["suffix_array_dedup"].collect()}
    assert passage[10:-10] not in cut[101] and passage[10:-10] not in cut[103] and cut[111] == rows[111][1]
    assert ids["benchmark_decontamination"] == ids["suffix_array_dedup"] - {105}
    last = {r.doc_id: r for r in frames["sentencepiece"].collect()}
    assert set(last) == ids["benchmark_decontamination"] and all(r.parity and r.round_trip for r in last.values())
    ran = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {k: r.n_tokens for k, r in last.items()}
