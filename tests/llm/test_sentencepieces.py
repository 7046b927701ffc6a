import struct

import pytest
import sentencepiece

from sondeline.llm import sentencepieces as m

TEXTS = [None, "", " ", "a  b   c    d", "▁x", "<s> </s> <0x41> 😀\n\t\r", "word " * 40_000, "x" * 70_000, "   " * 9, "Hello, wörld! 你好", "a" + " " * 37 + "b", " lead", "trail "]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def delimited(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_model():
    """A little unigram model with byte fallback, written as protobuf by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.1, 1), ("▁ab", -2.5, 1), ("ab", -3.2, 1), ("aba", -3.9, 1), ("▁b", -4.4, 1)]
    raw = b"".join(delimited(1, delimited(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(t)) for p, s, t in pieces)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    normaliser = delimited(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    return raw + delimited(2, trainer) + delimited(3, normaliser)


def test_round_trip_and_parity(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in m.encode_documents(d).collect()}
    reference = sentencepiece.SentencePieceProcessor(model_file=m.default_model())
    for k, text in enumerate(TEXTS):
        assert list(got[k].token_ids) == reference.encode(text or ""), text
        assert got[k].parity and got[k].round_trip == ("▁" not in (text or ""))
        assert got[k].n_tokens == len(got[k].token_ids)
    back = {r.doc_id: r.text for r in m.decode(m.encode(d, keep_text=False)).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in enumerate(TEXTS))
    assert m.encode_documents(d.limit(0)).count() == 0


def test_unigram_model_has_parity(spark):
    raw = unigram_model()
    texts = ["ab aba b", "abab", "é a", "  a", "", "ab" * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in m.encode_documents(d, raw).collect()}
    reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert [list(got[k].token_ids) for k in range(len(texts))] == [reference.encode(t) for t in texts]
    assert all(r.round_trip and r.parity for r in got.values())


def test_clashing_columns_and_bad_ids(spark):
    d = spark.createDataFrame([(1, "hello there", "mine")], "doc_id long, text string, token_ids string")
    assert m.encode(d).columns == ["doc_id", "text", "token_ids", "n_tokens"]
    odd = spark.createDataFrame([(1, [1 << 30, None, 5]), (2, None)], "doc_id long, token_ids array<int>")
    assert {r.doc_id for r in m.decode(odd).collect()} == {1, 2}


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError, match="only unigram and BPE"):
        m.Model.parse(delimited(2, varint(3 << 3) + varint(4)))


def test_differing_words_are_found(monkeypatch):
    raw = open(m.default_model(), "rb").read()
    codec = m.Codec(raw)
    texts = ["good words here", "one odd word", "", "odd", "x  y"]
    ids = codec.encode(texts)
    assert codec.parity(texts, ids) == [True] * 5
    codec.ids_of.clear()
    right = codec.reference
    monkeypatch.setattr(codec, "reference", lambda t: [[-1] if "odd" in x else y for x, y in zip(t, right(t), strict=True)])
    assert codec.parity(texts, ids) == [True, False, True, False, True]


def test_parity_is_of_each_rows_own_ids():
    codec = m.Codec(open(m.default_model(), "rb").read())
    assert codec.cut and codec.parity(["the same words", ""], [[1, 2, 3], []]) == [False, True]
    texts = [t or "" for t in TEXTS]
    ids = codec.encode(texts)
    assert all(codec.parity(texts, ids))
    for k, row in enumerate(ids):
        if row:  # one id of one row is wrong, or lost
            for bad in (row[:-1], [*row[:-1], row[-1] + 1]):
                assert codec.parity(texts, [*ids[:k], bad, *ids[k + 1 :]]) == [i != k for i in range(len(ids))]


def test_a_word_is_encoded_once_and_texts_are_put_together(monkeypatch):
    monkeypatch.setattr(m, "RUN", 3)
    codec = m.Codec(open(m.default_model(), "rb").read())
    asked = []
    for table in (codec.made_of, codec.ids_of):
        monkeypatch.setattr(table, "encode", lambda texts, encode=table.encode: (asked.extend(texts), encode(texts))[1])
    texts = [t or "" for t in TEXTS] + ["the same words " * 5_000] * 3
    ids, same = codec.checked(texts)
    assert all(same) and sum(map(len, asked)) < 2 * 80_000  # x * 70_000 is one word; the texts have 500,000 characters
    assert codec.encode(texts) == [x.tolist() for x in ids] == codec.reference(texts)


def test_words_are_learned_again_after_a_clearing(monkeypatch):
    monkeypatch.setattr(m, "WORDS", 2)
    codec = m.Codec(open(m.default_model(), "rb").read())
    for texts in (["one two three", "", " "], ["three  four one"], ["two", "a ▁ b"]):
        ids, same = codec.checked(texts)
        assert all(same) and [x.tolist() for x in ids] == codec.reference(texts)
        assert len(codec.numbers) <= 5
