import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from sondeline.llm import conversation_repair as m


def brute(rows):
    """The contract over lists; every audit string of each grammar state is compared as a string."""
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        conversations[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, found in conversations.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in found:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, roles, inserts, found=found, kinds=kinds):
            """(cost, audit, lines) of the best way on, given the shape of the roles so far."""
            options = []
            if i == len(found) and roles in ("", "a"):
                options.append((0, "", ()))
            for put in ("u", "a"):
                if inserts < 3 and (roles, put) in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    c, a, lines = best(i, put, inserts + 1)
                    options.append((c + 5, "I" + a, ({"u": "user", "a": "assistant"}[put] + ":", *lines)))
            if i < len(found):
                _, role, text = found[i]
                c, a, lines = best(i + 1, roles, 0)
                options.append((c + 2, "D" + a, lines))
                if kinds[i] not in ("blank", "duplicate"):
                    for label, name, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                        put = name[:1]
                        if (roles, put) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                            c, a, lines = best(i + 1, put, 0)
                            options.append((c + cost + 5 * (kinds[i] == "truncated"), label + a, (f"{name}:{text}", *lines)))
            return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

        cost, audit, lines = best(0, "", 0)
        turns = [t for t, _, _ in found if t is not None]
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(found, found[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def made(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(150), None]:
        for turn in rng.sample(range(14), rng.randrange(0, 9)) + [None] * rng.randrange(2):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "agent", "", None])
            text = rng.choice(["Yes.", "No!", "And so", "What? \n", " \t", "", None, "Ä é.\x0b", "ends.\xa0", "Yes.", "Right, then.", "w " * 40 + "."])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, at string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in m._repair(m.damage(d), False).collect()}
    assert got == brute(rows)
    assert m._repair(m.damage(d.limit(0)), False).count() == 0


def test_sql_says_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = made(3)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = m.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(m.ORACLE_SQL)
    names = [c[0] for c in found.description]
    assert names == got.columns
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_repaired_rows_and_long_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"Line {k}.") for k in range(6000)] + [(2, 0, "user", "Alone."), (3, 0, "system", "Be kind."), (3, 1, "user", "Hi!"), (3, 2, "tool", "Well.")]
    rows += [(4, k, "user", f"u{k}.") for k in range(3)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = {r.conv_id: (r.cost, r.audit) for r in m.repair(d).collect()}
    assert told == {1: (0, "K" * 6000), 2: (2, "D"), 3: (1, "KKR"), 4: (3, "DKR")}
    lines = sorted((r.conv_id, r.position, r.role, r.text, r.edit) for r in m.repaired_rows(d).where("conv_id > 1").collect())
    assert lines == [(3, 0, "system", "Be kind.", "K"), (3, 1, "user", "Hi!", "K"), (3, 2, "assistant", "Well.", "R"), (4, 0, "user", "u1.", "K"), (4, 1, "assistant", "u2.", "R")]
    assert m.repaired_rows(d).where("conv_id = 1").count() == 6000
