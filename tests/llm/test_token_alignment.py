import hashlib
import random
from collections import Counter

import public_tokenizers as public
import pytest

from sondeline.llm import token_alignment as m


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def brute(texts, libraries):
    """By the vocabularies' own libraries, and loops over all pairs of tokens."""
    a, b = libraries
    alphabet, seen, docs = m.byte_alphabet(), Counter(), []

    def raw_a(i):
        return bytes(alphabet[c] for c in a.id_to_token(i))

    def raw_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(raw_a, x)) != whole or b"".join(map(raw_b, y)) != whole:
            docs.append(([], Counter()))
            continue
        groups, i, j = [], 0, 0
        while i < len(x):
            ga, gb = [x[i]], [y[j]]
            la, lb = len(raw_a(x[i])), len(raw_b(y[j]))
            i, j = i + 1, j + 1
            while la != lb:
                if la < lb:
                    ga.append(x[i])
                    la += len(raw_a(x[i]))
                    i += 1
                else:
                    gb.append(y[j])
                    lb += len(raw_b(y[j]))
                    j += 1
            groups.append((ga, gb))
        links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        seen.update(links.keys())
        docs.append((groups, links))
    most = {}
    for (p, _), n in seen.items():
        most[p] = max(n, most.get(p, 0))
    out = []
    for groups, links in docs:
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        best = sum(n for (p, q), n in links.items() if seen[p, q] == most[p])
        out.append((
            sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), sum(links.values()), best,
            sum(n * seen[x] for x, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "", said,
        ))
    return out


def made():
    rng = random.Random(3)
    bits = "the of Ärger naïve 漢字 😀 don't <s> <|endoftext|> x1y2 3.14159 ... aaaaaaaaaaaaaaaaaaaaaa   \t\n zzz   qqq été ﬁ ́ \x00 \x85".split(" ") + ["  ", "\n\n", " \n"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "  ", "\n", "▁", "some ▁ marker", texts[0], texts[1], "<s> </s> <unk> <0x41>", "a" * 5000, "the cat " * 900, "ab漢 " * 300]
    return texts


@pytest.mark.parametrize("slice_pairs", [1 << 20, 5])
def test_equals_brute_force(spark, libraries, slice_pairs):
    texts = made()
    d = spark.createDataFrame([(k if k % 7 else None, t, "s", "c") for k, t in enumerate(texts)], "doc_id long, text string, row string, codes string").repartition(3)
    want = brute(texts, libraries)
    got = sorted((tuple(r) for r in m.align(d, slice_pairs=slice_pairs).collect()), key=str)
    assert got == sorted(((k if k % 7 else None, *x[:7]) for k, x in enumerate(want)), key=str)
    if slice_pairs == 5:
        said = [(r.doc_id, r.token_groups, r.row) for r in m.groups(d).collect()]
        assert sorted(said, key=str) == sorted(((k if k % 7 else None, x[7], "s") for k, x in enumerate(want)), key=str)
        assert m.align(d.limit(0)).count() == 0


def test_pathological_groups(spark, libraries):
    text = "ﷺ" * 3000 + " é" * 2000 + "1234567" * 1000
    (got,) = m.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert tuple(got) == (1, *brute([text], libraries)[0][:7])


def test_parts_and_chunks_do_not_show(monkeypatch):
    """In this process, for workers don't see what is patched here."""
    import pyarrow as pa

    from sondeline.llm import sentencepieces

    class Here:
        def __init__(self):
            self.made = m.Aligner(open(public.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(public.path("piece_bpe_32k.model"), "rb").read())

        def aligner(self):
            return self.made

    here, texts = Here(), pa.array(made())
    whole = [x.to_pylist() for x in m._documents(here)[1]()(texts)]
    monkeypatch.setattr(m, "GROUP_CHARS", 300)
    monkeypatch.setattr(sentencepieces, "PART_CHARS", 40)
    monkeypatch.setattr(m, "PAIRS", 6)
    assert [x.to_pylist() for x in m._documents(here)[1]()(texts)] == whole


def test_a_word_is_encoded_once_a_task(libraries):
    """The sentencepiece library meets each distinct word once, and the ids are those of whole texts; texts whose bytes differ are told apart."""
    side, seen = m.Pieces(open(public.path("piece_bpe_32k.model"), "rb").read()), []
    library = side.codec.reference
    side.codec.reference = lambda texts: (seen.extend(texts), library(texts))[1]
    rng = random.Random(8)
    texts = [" ".join(f"{rng.choice('abcdé')}word{rng.randrange(20)}" for _ in range(400)) for _ in range(10)] + ["two  spaces ", "\n \nx ▁ y", " "]
    got = [x for t in texts for x in side.encode([t])]
    assert [x.tolist() for x in got] == [libraries[1].encode(t) for t in texts]
    assert sum(map(len, seen)) < sum(map(len, texts)) / 10
    whole = m.Aligner(open(public.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(public.path("piece_bpe_32k.model"), "rb").read())
    bad, x = whole.align([(0, texts[0]), (1, "a ▁ b"), (2, texts[10])])
    assert bad == {1} and x["texts"].tolist() == [0, 2]
