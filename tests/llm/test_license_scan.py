import random
from math import ceil

from sondeline.llm import license_scan as m


def brute(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, base = [], set()
    for phrase, label in m.PHRASES.items():
        parts = phrase.split()
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                starts.append(k)
                base.add(label)
    labels, best = set(base), 1.0 if base else 0.0
    for line in low.split("\n"):
        block = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, template in m.TEMPLATES:
            t = set(m.template_words(template))
            if len(t & block) >= ceil(m.THRESHOLD * len(t) - 1e-9):
                labels.add(label)
                best = max(best, len(t & block) / len(t))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, f"x\n{t}\ny") for k, (_, t) in enumerate(m.TEMPLATES)]
    for k in range(60):
        _, template = rng.choice(m.TEMPLATES)
        words = [w for w in template.split() if rng.random() > 0.08] + rng.choices(["the", "of", "filler"], k=rng.randrange(4))
        rng.shuffle(words)
        rows.append((100 + k, "\n".join([" ".join(words), " ".join(rng.choices(template.split(), k=6))])))
    rows += [(900, None), (901, ""), (902, "MIT License mit LICENSE, apache\nlicense"), (903, "MİT License"), (904, "word " * 50_000 + "general-public license"), (901, "gnu general public license")]
    spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, words string, labels int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in m.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((k, *brute(t)) for k, t in rows), key=str)


def test_main_path_is_native(spark, tmp_path):
    spark.createDataFrame([(1, "Released under the MIT License")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = m.query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert m.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_notices_wrapped_over_lines(spark):
    import textwrap

    rows = []
    for k, (_, notice) in enumerate(m.TEMPLATES):
        for width in (12, 24, 75):
            rows.append((100 * k + width, textwrap.fill(f"some prose before it {notice}, and some prose after", width, break_long_words=False)))
    lacking = m.TEMPLATES[2][1].replace("hereby ", "")
    rows += [(5000, textwrap.fill(f"x y z {lacking} z", 40)), (5001, textwrap.fill(" ".join(reversed(lacking.split())), 40)), (5002, "All\n" + "word " * 50 + "\nrights reserved")]
    got = {r.doc_id: r for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(m.TEMPLATES):
        assert all(label in got[100 * k + width].labels and got[100 * k + width].score == 1 for width in (12, 24, 75))
    n = len(m.template_words(m.TEMPLATES[2][1]))
    assert got[5000].labels == ["mit"] and got[5000].score == (n - 1) / n
    assert got[5001].labels == got[5002].labels == []


def test_places_in_long_texts_are_found_in_linear_time(spark):
    """Places by the ten thousand in one text: no two of them are compared, and each keeps its own windows."""
    import time

    many = "\n".join(f"rights reserved all x y z{k}" for k in range(12_000))
    rows = [(1, many), (2, many + "\nall\nrights reserved"), (3, "all\nrights\n" * 3 + "reserved"), (4, "reserved\nrights\nall\n" * 3)]
    began = time.monotonic()
    got = {r.doc_id: r for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 60
    assert [got[k].labels for k in (1, 2, 3, 4)] == [["all-rights-reserved"]] * 2 + [["all-rights-reserved"], []]
