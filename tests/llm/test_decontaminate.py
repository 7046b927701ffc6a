import hashlib
import random
import re

from sondeline.llm import decontaminate as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w and name is not None else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(name))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


def rows_of(found):
    return [(r.doc_id, r.n_words, r.n_hit, list(r.hit_items)) for r in found.select("doc_id", "n_words", "n_hit", "hit_items").collect()]


def make(spark):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "Été", "d9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 14])))) for k in range(12)]
    items += [(90, None), (91, ""), (None, "a B c d9 a"), (92, items[3][1]), (93, "zebra, ZEBRA")]
    docs = [(k, ", ".join(rng.choices([*vocabulary, "other", "zebra"], k=rng.randrange(0, 60)))) for k in range(80)]
    docs += [(100, None), (101, ""), (102, "?!"), (5, docs[5][1]), (103, "a " * 3000), (104, "Zebra zebra")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, items, d, b = make(spark)
    for window in (4, 13):
        assert sorted(rows_of(m.find_spans(d, b, window=window))) == sorted(brute(docs, items, window))


def test_several_automata_give_the_same(spark):
    docs, items, d, b = make(spark)
    assert sorted(rows_of(m.find_spans(d, b, window=4, shard_words=20))) == sorted(brute(docs, items, 4))


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, hit_items string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(m.find_spans(d, none)) == [(1, 2, 0, [])]
    assert m.find_spans(d.limit(0), none).count() == 0
    assert m.decontaminate(d, none).collect() == d.collect()


def test_coverage_limit_and_cutting(spark):
    item = " ".join(f"w{k}" for k in range(13))
    other = " ".join(f"x{k}" for k in range(400))
    d = spark.createDataFrame([(1, item), (2, f"{other} {item.upper()}. end"), (3, other)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: r.text for r in m.decontaminate(d, b).collect()} == {2: f"{other} {item.upper()}. end", 3: other}
    assert {r.doc_id: r.text for r in m.decontaminate(d, b, least_words=13).collect()} == {2: f"{other} . end", 3: other}


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, " ".join("abcdefghijklmnop")), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, " ".join("abcdefghijklm")), (9, " ".join("bcdefghijklmn"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in m.query(spark, str(tmp_path)).collect()}
    assert got[1] == (16, 14, 2, hashlib.sha256(b"10,9").hexdigest(), True)
    assert got[2] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
