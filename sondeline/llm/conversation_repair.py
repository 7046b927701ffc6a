"""Repair of conversations by weighted finite-state composition.

A conversation is a linear acceptor, one arc a row. The edit transducer keeps a row, gives it another role, deletes it or
inserts an empty row; the role grammar accepts an optional system turn and then pairs of user and assistant, or nothing. States of the
composition are (row, inserts since that row, grammar state). They are made only when reached from the start, in order of rows,
and the shortest path to an accepting state is found backwards over that topological order. Weights are pairs of cost and
label string, compared in that order. The grammar is deterministic, so no two arcs of a state have the same label, and the least
string of a state begins with the least label among its arcs of least cost: pointers are enough and no strings are compared.
At no row are more than two inserts of use, for three would return to a grammar state at a higher cost.

Rows are shuffled once, by conversation, and sorted there. Of each conversation, narrow rows come first (role, fault), then
the texts: a task holds one byte a narrow row while it finds the path, and repaired rows stream by. So a conversation of any length
passes in bounded memory but for that byte and the path, though in one task, as the hash over its text asks for.

Defined results: a null role or text is one space; null turns come first and count in no gap; rows of the same turn come in order
of role and text; a null conv_id is a conversation; repeated rows are rows; a role is known by its first letter, and one that is none of s, u and a
can't be kept; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, small_batches, table

#: The role grammar (s?(ua)+)? as an acceptor: arcs by role initial, and its accepting states.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = frozenset({0, 3})
NAMES = {"u": "user", "a": "assistant"}

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5  #: added where a truncated row stays
INSERTS = 2
SPACES = " \t\n\x0b\f\r"

FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
SHORT = 64  #: paths of conversations up to this length are remembered


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and gone of every row: what crc32 of `conv_id:turn` does to it. Dropped rows stay, as gone."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("fault") == 0).alias("gone"))


def _fault() -> Column:
    bare = F.expr(r"trim(TRAILING ' \t\n\u000b\f\r' FROM text)")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("at")) > 1
    return F.when(bare == "", BLANK).when(seen, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Each conversation's rows twice, narrow ones before those with texts; one shuffle."""
    order = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    told = rows.withColumn("at", F.row_number().over(order)).withColumn("fault", _fault())
    tags = F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    twice = told.withColumn("tag", F.explode(tags)).withColumn("text", F.when(F.col("tag") == 1, F.col("text")))
    return twice.select("conv_id", "tag", "at", "turn", "role", "text", "gone", "fault").sortWithinPartitions("conv_id", "tag", "at")


@lru_cache(maxsize=None)
def arcs(initial: str | None, fault: int, inserts: int, state: int) -> tuple[tuple[int, str, str, int, tuple[int, int]], ...]:
    """Arcs (cost, label, role initial put out, rows read, next inserts and grammar state) of a composed state; initial is None at the end."""
    found = []
    following = GRAMMAR[state]
    if inserts < INSERTS:
        found += [(INSERT, "I", r, 0, (inserts + 1, following[r])) for r in NAMES if r in following]
    if initial is not None:
        found.append((DELETE, "D", "", 1, (0, state)))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_OFF else 0
            if initial in following:
                found.append((KEEP + more, "K", initial, 1, (0, following[initial])))
            found += [(REROLE + more, "R", r, 1, (0, following[r])) for r in NAMES if r in following]
    return tuple(sorted(found))


def shortest_path(codes: bytes) -> tuple[int, list[tuple[str, str]]]:
    """Cost and (label, role initial) of each edit. codes: a byte a row, 4 times the place of its initial in 'sua' (3: another) plus its fault."""
    rows = [("suax"[c >> 2], c & 3) for c in codes] + [(None, FINE)]
    layers: list[dict] = [{(0, 0): None}, *({} for _ in codes)]
    for i, row in enumerate(rows):  # states are made when an arc reaches them; within a row, inserts only go up
        waiting = list(layers[i])
        for s in waiting:
            for _, _, _, read, to in arcs(*row, *s):
                layer = layers[i + read]
                if to not in layer:
                    layer[to] = None
                    if not read:
                        waiting.append(to)
    for i in range(len(codes), -1, -1):
        layer, row = layers[i], rows[i]
        for s in sorted(layer, reverse=True):
            best = (0, "", "", 0, None) if row[0] is None and s[1] in ACCEPTING else None
            for cost, label, role, read, to in arcs(*row, *s):
                if (rest := layers[i + read][to]) is not None and (best is None or (cost + rest[0], label) < best[:2]):
                    best = (cost + rest[0], label, role, read, to)
            layer[s] = best
    i, s, path = 0, (0, 0), []
    cost = layers[0][s][0]
    while (step := layers[i][s])[1]:
        path.append((step[1], step[2]))
        i, s = i + step[3], step[4]
    return cost, path


_remembered = lru_cache(maxsize=1 << 15)(shortest_path)


class _Conversation:
    """What a task holds of the conversation that streams by."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.counts = conv_id, bytearray(), [0, 0, 0, 0]
        self.least = self.most = None
        self.distinct = self.illegal = self.lines = self.step = 0
        self.cost, self.path, self.digest = 0, None, hashlib.sha256()

    def narrow(self, turn, role: str, fault: int) -> None:
        place = "sua".find(role[:1]) if role else -1
        place = 3 if place < 0 else place
        if self.codes and (self.codes[-1] >> 2, place) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.codes.append(4 * place + fault)
        self.counts[fault] += 1
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn

    def solve(self) -> None:
        if self.path is None:
            self.cost, self.path = (_remembered if len(self.codes) <= SHORT else shortest_path)(bytes(self.codes))

    def put(self, role: str, text: str, edit: str):
        self.lines += 1
        self.digest.update((("\n" if self.lines > 1 else "") + f"{role}:{text}").encode())
        return self.conv_id, self.lines - 1, role, text, edit

    def inserted(self):
        while self.step < len(self.path) and self.path[self.step][0] == "I":
            self.step += 1
            yield self.put(NAMES[self.path[self.step - 1][1]], "", "I")

    def wide(self, role: str, text: str):
        self.solve()
        yield from self.inserted()
        label, to = self.path[self.step]
        self.step += 1
        if label != "D":
            yield self.put(NAMES[to] if label == "R" else role, text, label)

    def end(self):
        self.solve()
        yield from self.inserted()

    def summary(self):
        gaps = self.most - self.least + 1 - self.distinct if self.most is not None else 0
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost, "".join(x for x, _ in self.path), self.digest.hexdigest())


LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repair(rows: DataFrame, want_rows: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    if want_rows:
        schema = f"conv_id {kind}, position long, role string, text string, edit string"
    else:
        schema = f"conv_id {kind}, " + ", ".join(f"{x} long" for x in LONGS) + ", audit string, repaired_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        now, out, arrow, size = None, [], None, 0

        def batch_of(found):
            columns = list(zip(*found, strict=True))
            kinds = [arrow] + ([pa.int64(), *[pa.string()] * 3] if want_rows else [pa.int64()] * 6 + [pa.string()] * 2)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def finish():
            last = list(now.end())
            return last if want_rows else [now.summary()]

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "tag", "turn", "role", "text", "gone", "fault"))
            for conv_id, tag, turn, role, text, gone, fault in zip(*columns, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out += finish()
                    now = _Conversation(conv_id)
                if tag:
                    size += len(text)
                    if want_rows:
                        out += now.wide(role, text)
                    else:
                        for _ in now.wide(role, text):
                            pass
                elif not gone:
                    now.narrow(turn, role, fault)
                if len(out) >= 4000 or (want_rows and size > 4 << 20 and out):
                    yield batch_of(out)
                    out, size = [], 0
        if now is not None:
            out += finish()
        if out:
            yield batch_of(out)
        now = out = None
        give_back()

    return _sorted_rows(rows).mapInArrow(run, schema)


def _given(conversations: DataFrame) -> DataFrame:
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", "turn", *names, F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit) of every row of the repaired conversations; edit is K, R or I."""
    return _repair(_given(conversations), True)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation as it is."""
    return _repair(_given(conversations), False)


def query(spark, sf_dir: str) -> DataFrame:
    return _repair(damage(table(spark, sf_dir, "conversations")), False)


def _least(row: str, state: int) -> str:
    """SQL: the best of the edits that read a row, from a grammar state on; r is that row and b the states after it."""
    after = GRAMMAR[state]
    more = f"CASE WHEN {row}.fault = {CUT_OFF} THEN {TRUNCATED} ELSE 0 END"
    fine = f"{row}.fault IN ({FINE}, {CUT_OFF})"
    joined = lambda cost, label, rest, role=None: (
        f"{{'cost': {rest}.cost + {cost}, 'audit': '{label}' || {rest}.audit, 'kept': " + (f"list_prepend({role} || ':' || {row}.text, {rest}.kept)" if role else f"{rest}.kept") + "}"
    )
    options = [joined(DELETE, "D", f"b.q{state}")]
    for initial, to in after.items():
        options.append(f"CASE WHEN {fine} AND left({row}.role, 1) = '{initial}' THEN {joined(more, 'K', f'b.q{to}', f'{row}.role')} END")
        if initial in NAMES:
            literal = f"'{NAMES[initial]}'"
            options.append(f"CASE WHEN {fine} THEN {joined(f'{REROLE} + {more}', 'R', f'b.q{to}', literal)} END")
    return f"list_min([{', '.join(options)}])"


def _closed(state: int, inserts: int = INSERTS) -> str:
    """SQL: the best from a grammar state on where up to two inserts come first; w has the best without them."""
    options, at, said = [f"w{state}"], state, []
    for k in range(1, inserts + 1):
        initial = next(r for r in NAMES if r in GRAMMAR[at])
        at = GRAMMAR[at][initial]
        said.append(f"'{NAMES[initial]}:'")
        options.append(f"{{'cost': w{at}.cost + {INSERT * k}, 'audit': '{'I' * k}' || w{at}.audit, 'kept': list_concat([{', '.join(said)}], w{at}.kept)}}")
    return f"list_min([{', '.join(options)}])"


_END = {q: "{'cost': " + ("0" if q in ACCEPTING else "1000000000000") + "::BIGINT, 'audit': '', 'kept': []::VARCHAR[]}" for q in GRAMMAR}
_CRC = (
    "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), "
    "lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))"
)
_STATES = ", ".join(f"q{q}" for q in GRAMMAR)
#: The dynamic programme over rows from the last to the first, a struct of cost, audit and repaired lines for each grammar state.
ORACLE_SQL = f"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
faults AS (SELECT *, xor({_CRC}, 4294967295) % 20 AS f FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM faults WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
told AS (
  SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM placed),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN {BLANK} WHEN seen > 1 THEN {DUPLICATE} WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN {CUT_OFF} ELSE {FINE} END AS fault FROM told),
back AS (
  SELECT conv_id, n + 1 AS pos, {", ".join(f"{_closed(q)} AS q{q}" for q in GRAMMAR)}
  FROM (SELECT DISTINCT conv_id, n, {", ".join(f"{_END[q]} AS w{q}" for q in GRAMMAR)} FROM marked)
  UNION ALL
  SELECT conv_id, pos, {", ".join(f"{_closed(q)} AS q{q}" for q in GRAMMAR)}
  FROM (SELECT r.conv_id, r.pos, {", ".join(f"{_least('r', q)} AS w{q}" for q in GRAMMAR)} FROM back b JOIN marked r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos - 1)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
    count(*) FILTER (fault = {CUT_OFF}) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(q0.cost, 0)::BIGINT AS cost, coalesce(q0.audit, '') AS audit, sha256(coalesce(array_to_string(q0.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN back ON back.conv_id IS NOT DISTINCT FROM o.conv_id AND back.pos = 1"""
