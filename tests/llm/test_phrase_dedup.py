import hashlib
import random
import re

import pytest

from sondeline.llm import phrase_dedup as m


def brute(rows, length=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - length + 1) if k is not None else ():
            x = tuple(w[i : i + length])
            least[x] = min(k, least.get(x, k))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1) if k is not None else ():
            if least[tuple(w[i : i + length])] < k:
                gone.update(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return out


def made(seed):
    rng = random.Random(seed)
    bases = [[rng.choice("a b cc d é f".split()) + rng.choice("12345") for _ in range(300)] for _ in range(3)]
    rows = []
    for k in range(150):
        base, a = rng.choice(bases), rng.randrange(250)
        text = base[a : a + rng.randrange(5, 120)]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((rng.randrange(1000), "".join(w + rng.choice([" ", "\n", " \t"]) for w in text)))
    line = " ".join(f"common{j}" for j in range(20))
    rows += [(2000 + k, f"{rng.choice('pqr')}{k} {line} tail{k} and {k % 3} so on") for k in range(40)]
    rows += [(5000, None), (5001, ""), (5002, "u v " * 40), (5003, "u v " * 9), (3, rows[9][1]), (None, rows[9][1]), (None, "u v " * 40), (5004, rows[9][1]), (5004, "x " * 30), (5004, "x " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,shard", [(1, 2000, 10_000), (2, 2000, 30), (3, 3, 20)])
def test_equals_brute_force(spark, seed, hot, shard):
    rows = made(seed)
    d = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, g string, first string").repartition(5)
    got = sorted((tuple(r)[:4] for r in m.removals(d, hot=hot, shard_rows=shard).collect()), key=str)
    assert got == sorted((x[:4] for x in brute(rows)), key=str)
    assert m.removals(d.limit(0)).count() == 0


def test_texts_without_their_passages(spark):
    rows = made(4)
    d = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, spans string, _k1 string")
    want = [(k, " ".join(kept.split()) if n else t) for (k, t), (_, _, n, _, kept) in zip(rows, brute(rows), strict=True)]
    assert sorted(((r.doc_id, r.text) for r in m.deduplicate(d).collect()), key=str) == sorted(want, key=str)
    assert m.deduplicate(d).columns == d.columns


def test_automaton_tells_places_and_sources():
    a = [f"w{k}" for k in range(18)]
    say = lambda w: " ".join(w).encode()
    rows = [(say(a), 0b111111, 5, 5), (say(a[2:16]), 0b11, 9, 9), (say(["q", *a[1:14]]), 0b11, 7, 8), (say(["z"] * 13), 1, 4, 4)]
    assert m.occurrences(rows) == [[(1, 5), (2, 5), (3, 5)], [(0, 5), (1, 5)], [(0, 7), (1, 5)], []]
    assert m.occurrences([(say(a), 0b000010, 5, 5), (say(a), 0b000010, 6, 6)]) == [[(1, 5)], [(1, 5)]]


def test_slices_cut_no_window(monkeypatch):
    texts = [t.encode().split() for _, t in made(5) if t]
    windows = lambda: sorted((int(t), int(s) + i, int(g)) for found in m.blocks_of(texts) for t, s, n, g in zip(*found, strict=True) for i in range(n))
    whole = windows()
    assert len(whole) == sum(max(0, len(w) - m.LENGTH + 1) for w in texts)
    monkeypatch.setattr(m, "SLICE", 40)
    assert windows() == whole


def test_words_are_found_and_hashed_without_their_objects(monkeypatch):
    """Equal words have equal hashes wherever they stand, and places in bytes are those of the words; pieces don't show."""
    texts = [b"", b" \t", *(t.encode() for _, t in made(6) if t), b"x" * 9000 + b" " + b"y" * 5000, b"\xc2\x85 a\x0bb\x1c c"]
    want = [t.split() for t in texts]

    def found():
        hashes, first, last, counts = m.words_of(texts)
        assert counts.tolist() == list(map(len, want))
        ends = counts.cumsum().tolist()
        assert [[t[i:j] for i, j in zip(first[a - n : a].tolist(), last[a - n : a].tolist(), strict=True)] for t, a, n in zip(texts, ends, counts.tolist(), strict=True)] == want
        return hashes.tolist()

    whole = found()
    pairs = set(zip(whole, (w for t in want for w in t), strict=True))
    assert len(pairs) == len(dict(pairs)) == len({w for _, w in pairs})
    monkeypatch.setattr(m, "PIECE", 100)
    assert found() == whole
