import random

from sondeline.llm import quality_rules as m


def brute_repeats(words, window=8):
    seen = {}
    for k in range(len(words) - window + 1):
        seen.setdefault(tuple(words[k : k + window]), []).append(k)
    return len({j for places in seen.values() if len(places) > 1 for k in places for j in range(k, k + window)})


def test_repeated_words_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        words = [bytes([97 + rng.randrange(2)]) for _ in range(rng.randrange(0, 60))] + [b"q"] * rng.randrange(0, 12)
        assert m.repeated_words(words) == brute_repeats(words)


def test_measures():
    text = "Ab é#1\n\nx y $\nAb é#1\n \nAb é#1"
    assert m.measure(text.encode()) == (8, 2 + 3 + 3 + 1 + 2 + 3 + 2 + 3, 4, 2, 0, 4)
    assert m.measure(None) == m.measure(b"") == (0, 0, 0, 0, 0, 0)


def test_verdicts(spark):
    fine = " ".join(f"w{k}" for k in range(40))
    rows = [(k, "bad" if k < 300 else "good", "spam " * 30 if k < 290 else fine) for k in range(600)]
    rows += [(600, None, fine), (601, "small", "one"), (602, "small", fine), (603, "good", None), (604, "good", ""), (604, "good", "")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.base_failed, r.host_ok, r.kept) for r in m.judge(d, keep_text=False).collect()}
    assert got[0] == (True, False, False) and got[295] == (False, False, False)
    assert got[400] == (False, True, True) and got[600] == (False, True, True)
    assert got[602] == (False, True, True) and got[603] == got[604] == (True, True, False)
    assert m.judge(d.limit(0), keep_text=False).count() == 0
    m_before, m.BROADCAST_HOSTS = m.BROADCAST_HOSTS, 0
    try:
        assert {r.doc_id: (r.base_failed, r.host_ok, r.kept) for r in m.judge(d, keep_text=False).collect()} == got
    finally:
        m.BROADCAST_HOSTS = m_before


def test_hosts_decide_whether_soft_rules_count(spark):
    fine, odd, lines = (" ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}###" for k in range(40)), "\n".join(["one two three"] * 2 + [f"a b c d {k}" for k in range(4)]))
    rows = [(k, "trusted", odd if k < 3 else lines if k == 5 else fine) for k in range(4000)]
    rows += [(5000 + k, "junky", odd if k % 3 == 0 else fine) for k in range(300)] + [(6000, None, odd), (6001, "new", odd), (6002, "new", fine)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in m.judge(d, keep_text=False).collect()}
    assert got[0].fails_symbols and got[0].trusted_symbols and got[0].kept  # an oddity of a clean host
    assert not got[5].fails_dup_lines and got[5].kept  # one line in six
    assert [got[k].kept for k in (5000, 5001, 6000, 6001, 6002)] == [False, True, False, False, True]
    assert got[5001].host_ok and not got[5000].base_failed


def test_clashing_and_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    schema = "doc_id long, source string, text string, host string, host_ok string, _salt int, kept int, extra map<string,int>"
    d = spark.createDataFrame([(1, "a", text, "mine", "x", 7, 9, {"k": 1})], schema)
    for limit in (m.BROADCAST_HOSTS, 0):
        before, m.BROADCAST_HOSTS = m.BROADCAST_HOSTS, limit
        try:
            row = m.judge(d).first()
        finally:
            m.BROADCAST_HOSTS = before
        assert (row.host, row._salt, row.extra, row.host_ok, row.kept, row.text) == ("mine", 7, {"k": 1}, True, True, text)
    assert m.judge(d, host="host").first().kept


def test_no_column_of_the_input_is_lost(spark):
    names = ["__host", "__of", "__salt", "__salt0", "_host", "_of", "_salt", "_own_salt"]
    d = spark.createDataFrame([(1, "a few words of text here", "h", *names)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    (row,) = m.judge(d).collect()
    assert [row[n] for n in names] == names
