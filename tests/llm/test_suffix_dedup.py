import hashlib
import random

import pytest

from sondeline.llm import suffix_dedup as m


def brute(texts, length):
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(m, "SLICE", 700)  # texts are cut into pieces that overlap
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abé ") for _ in range(2500)) for _ in range(3)]
    rows = []
    for k in range(70):
        base, a = rng.choice(bases), rng.randrange(1800)
        text = list(base[a : a + rng.randrange(100, 900)])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((k, "".join(text)))
    rows += [(200, None), (201, ""), (202, "ab" * 900), (203, "x" * 600), (203, "x" * 600), (204, "q" * 199), (205, "q" * 200)]
    got = sorted(tuple(r) for r in m.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((k, *x) for (k, _), x in zip(rows, brute([t for _, t in rows], 200), strict=True))


def test_texts_are_cut_and_other_columns_stay(spark):
    passage, rng = "é".join(map(str, range(90))), random.Random(4)
    own = ["".join(rng.choice("klmn") for _ in range(300)) for _ in range(2)]
    rows = [(1, own[0] + passage, 5, "k"), (2, passage + own[1], 6, None), (3, None, 7, "x"), (4, "short", 8, "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, k1 string")
    got = {r.doc_id: tuple(r)[1:] for r in m.remove_repeats(d).collect()}
    assert got == {1: (own[0], 300, "k"), 2: (own[1], 300, None), 3: (None, 7, "x"), 4: ("short", 8, "y")}
    assert m.remove_repeats(d.limit(0)).count() == 0


def test_tables_of_the_passes_go_before_the_result_is_read(spark):
    """What is left on the disk are texts and spans, and not the blocks of each pass; rows of other tables stay."""
    from sondeline.sources import staging

    passage, rng = "".join(map(str, range(150))), random.Random(5)
    other = staging.written(spark.range(5), "other")
    d = spark.createDataFrame([(k, "".join(rng.choice("klmn") for _ in range(300)) + passage * (k < 2)) for k in range(9)], "doc_id long, text string")
    before = staging.written_tables()
    out = m.remove_repeats(d)
    assert [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path, _ in staging._written[before:]] == ["texts", "repeated-spans"]
    assert sorted(len(r.text) for r in out.collect()) == [300] * 9 and other.count() == 5
