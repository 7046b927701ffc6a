import random
import re

import pytest
import xxhash

from sondeline.llm import simhash as m


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_classes(fingerprints):
    parent = list(range(len(fingerprints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fingerprints)):
        for j in range(i):
            if bin(fingerprints[i] ^ fingerprints[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fingerprints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("small", [1, 3, 512])
def test_components_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(m, "SMALL", small)
    rng = random.Random(small)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(0, 3)))
            fps.append(base & (1 << 64) - 1)
    fps = list(dict.fromkeys(fps))
    hashed = spark.createDataFrame([(k, signed(f)) for k, f in enumerate(fps)], "doc_id long, fingerprint long")
    got = {r.fingerprint: r.component_id for r in m.classes(hashed).collect()}
    assert [got[signed(f)] for f in fps] == brute_classes(fps)


def test_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["Ärger", "b", "C", "dd", "e f"], k=rng.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", " \n", "One", "one two", texts[3], texts[3].upper(), "x y z " * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in m.near_duplicates(d).collect()}
    want = [brute_fingerprint(t) for t in texts]
    assert got == {k: (signed(f), c) for k, (f, c) in enumerate(zip(want, brute_classes(want), strict=True))}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 2), (9, None, 3), (8, "", None), (7, "quite another text here", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, fingerprint long")
    kept = sorted(map(tuple, m.deduplicate(d).collect()), key=lambda r: r[0])
    assert kept == [(2, "a b c d", 2), (7, "quite another text here", 5), (8, "", None)]
    assert m.deduplicate(d.limit(0)).count() == 0


def test_repeated_and_null_ids_lose_no_component(spark):
    a, b, c, e = "one two three four", "quite another text here", "some third words stand apart", "the fifth of all texts is this"
    rows = [(None, a), (None, b), (None, b), (5, c), (5, e), (6, e), (7, "x y z w"), (3, "x y z w"), (3, "nothing like the others at all")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, m.deduplicate(d).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (5, c), (5, e), (3, "x y z w"), (3, "nothing like the others at all")], key=str)
    # Id 1 leads one component on one row only; its other row follows id 0 and goes.
    d = spark.createDataFrame([(0, a), (1, a), (1, b)], "doc_id long, text string")
    assert sorted(map(tuple, m.deduplicate(d).collect())) == [(0, a), (1, b)]


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def edited(rng, words, share):
    return " ".join(rng.choice(["quux", "corge", "grault"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words)


def test_signature_and_similarity(monkeypatch):
    rng = random.Random(8)
    for n in (0, 1, 4, 5, 40, 300, 20_000):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(n)).encode()
        assert m.signature(text, 5)[0] == m.fingerprint(text, 5)
        starts = m.passage_starts(m._shingle_hashes(text, 5)) if n else []
        assert all(b - a >= m.LEAST_PASSAGE for a, b in zip(starts, starts[1:]))
    for _ in range(30):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 240))]
        a, b = " ".join(words), edited(rng, words, 0.03)
        want = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert abs(m.similarity_of(*(m.signature(t.encode(), 5)[2] for t in (a, b))) - want) < 1e-9  # exact below SKETCH
    off = []
    for _ in range(20):
        words = [f"w{rng.randrange(9000)}" for _ in range(1500)]
        a, b = " ".join(words), edited(rng, words, 0.02)
        off.append(abs(m.similarity_of(*(m.signature(t.encode(), 5)[2] for t in (a, b))) - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))))
    assert max(off) < 0.12 and sum(off) / 20 < 0.04


def test_edited_copies_go(spark):
    """Of copies with one word in sixty changed nine in ten are found at least, texts alike by less stay, and a passage that all share links nothing."""
    rng = random.Random(9)
    common = " ".join(f"notice{k}" for k in range(25))
    rows, near, apart, k = [], [], [], 0
    for _ in range(120):
        base = [f"w{rng.randrange(20_000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((k, f"{' '.join(base)} {common}"))
        k += 1
        for share, into in ((1 / 60, near), (1 / 8, apart)):
            text = f"{edited(rng, base, share)} {common}"
            alike = len(shingles(rows[-1][1] if into is near else " ".join(base) + " " + common) & shingles(text)) / len(shingles(" ".join(base) + " " + common) | shingles(text))
            if (alike >= 0.8 if into is near else alike < 0.7):
                into.append(k)
                rows.append((k, text))
                k += 1
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in m.deduplicate(d, shingle=5, similarity=0.8).collect()}
    assert len(near) > 60 and sum(x not in kept for x in near) >= 0.9 * len(near)
    assert set(apart) <= kept and {i for i, _ in rows} - set(near) <= kept


def test_links_past_the_leaders_are_found(spark):
    """One passage is shared by many texts, and a pair of them alike has neither a leader of it nor another passage among its least: all links equal brute force."""
    rng = random.Random(12)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(30_000)}" for _ in range(rng.randrange(40, 90))]
        rows += [" ".join(base), " ".join(base[: len(base) // 2] + ["changed"] + base[len(base) // 2 :])]
    rows += [f"{rows[-1]} {' '.join(f'tail{k}x{j}' for j in range(k))}" for k in range(0, 60, 3)]
    signed_rows = [(signed(f), p, bytearray(s)) for f, p, s in (m.signature(t.encode(), 5) for t in dict.fromkeys(rows))]
    d = spark.createDataFrame([(f, [7], s) for f, _, s in signed_rows], "f long, passages array<long>, sketch binary")  # one passage for all
    labels = m.components(m.near_links(d, 0.8))
    got = {r.node: r.component for r in labels.collect()}
    parent = {f: f for f, _, _ in signed_rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (f, _, s) in enumerate(signed_rows):
        for g, _, z in signed_rows[:i]:
            if m.similarity_of(bytes(s), bytes(z)) >= 0.8:
                a, b = sorted((root(f), root(g)))
                parent[b] = a
    assert len({root(f) for f in parent}) < len(parent) - 50
    assert {f: got.get(f, f) for f in parent} == {f: root(f) for f in parent}


def test_blocks_of_a_hash_make_no_pairs_and_lose_no_link(spark, monkeypatch):
    """A hash with many members is met block by block: components equal brute force, and what leaves the tasks is a forest, not every alike pair."""
    rng = random.Random(13)
    monkeypatch.setattr(m, "BLOCK", 8)
    monkeypatch.setattr(m, "GRID", 16)
    base = [f"w{k}" for k in range(150)]
    texts = list(dict.fromkeys(edited(rng, base, share) for share in (0.005, 0.01, 0.02, 0.03) for _ in range(40)))
    rows = [(signed(f), bytearray(s)) for f, _, s in (m.signature(t.encode(), 5) for t in texts)]
    d = spark.createDataFrame([(f, [], s) for f, s in rows], "f long, passages array<long>, sketch binary")
    none = spark.createDataFrame([], "node long, component long")
    found = [(r.u, r.v) for r in m.rest_links(d, 0.8, none).collect()]
    alike = [(f, g) for i, (f, s) in enumerate(rows) for g, z in rows[:i] if m.similarity_of(bytes(s), bytes(z)) >= 0.8]
    assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in alike}
    tree = lambda links: {r.node: r.component for r in m.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert tree(found) == tree(alike) and len({tuple(sorted(x)) for x in found}) < len(alike) / 2
