"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items are put into one suffix automaton. Document words are streamed through
it; the length of the longest match that ends at a word tells which benchmark windows end there. A window is
`window` consecutive words of an item, or a whole item that has fewer words.

The automaton is broadcast. Its size is proven before: `shard_words` bounds the words in one automaton, and a larger
benchmark is taken in several passes, each with an automaton of its own, whose spans are united by document.

Defined results: a null or empty text has no words and is clean; items without words, and items whose id is null, are
ignored; equal items all count; repeated rows are scanned one by one; an empty benchmark leaves everything clean;
all columns of the input pass through, except that a column named like an output is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, append_columns, fresh, materialize, texts_of

WINDOW = 13
SHARD_WORDS = 200_000
ADDED = ("n_words", "hit_spans", "hit_items", "n_hit")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items that hold each state's window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, ids in known:
            state = 0
            for w in ids:
                state = self._extend(state, w)
        holders: list[set[str]] = [set() for _ in self.link]
        whole: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for name, ids in known:
            state = 0
            for w in ids:
                state = up = self.next[state][w]
                while up > 0 and self.length[up] >= window and name not in holders[up]:
                    holders[up].add(name)
                    up = self.link[up]
            if len(ids) < window:
                whole[state].append((len(ids), name))
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        #: of each state: the state of its last `window` words, and the short items that are suffixes of its words
        self.at_window, self.short = [0] * len(order), [()] * len(order)
        for s in order[1:]:
            up = self.link[s]
            self.at_window[s] = s if self.length[up] < window <= self.length[s] else self.at_window[up]
            self.short[s] = (*whole[s], *self.short[up])
        self.items = {s: tuple(sorted(holders[s])) for s in set(self.at_window) if holders[s]}
        self.least = min([window, *(len(ids) for _, ids in known)])

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        else:
            self.link[new] = 0
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Half-open word intervals of benchmark windows, in order of their ends, and the items they come from."""
        spans, items, begin = [], set(), 0
        ids = list(map(self.vocabulary.get, words))
        ids.append(None)
        while begin < len(ids):  # only runs of benchmark words can hold a window
            stop = ids.index(None, begin)
            if stop - begin >= self.least:
                self._scan_run(ids, begin, stop, spans, items)
            begin = stop + 1
        return spans, items

    def _scan_run(self, ids, begin, stop, spans, items) -> None:
        state = matched = 0
        for i in range(begin, stop):
            w = ids[i]
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(w, 0)
            matched = matched + 1 if state else 0
            if matched >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                items.update(self.items.get(self.at_window[state], ()))
            for n, name in self.short[state]:
                if n <= matched:
                    spans.append((i + 1 - n, i + 1))
                    items.add(name)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _shards(benchmark: DataFrame, shard_words: int):
    """Item lists of bounded size; rows come from the executors one partition at a time."""
    shard, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    for row in rows.where("i is not null and t is not null").toLocalIterator():
        words = words_of(bytes(row["t"]))
        if shard and size + len(words) > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((row["i"], words))
        size += len(words)
    yield shard


def find_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, keep_text: bool = True) -> DataFrame:
    """Add n_words, hit_spans (disjoint word intervals), n_hit and hit_items (sorted) to every document."""
    spark = docs.sparkSession
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", SPANS),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
    out = docs
    spans_so_far, items_so_far = fresh(docs, "_spans", "_items")
    for k, (shard, last) in enumerate(_with_last(_shards(benchmark, shard_words))):
        if k:
            out = materialize(out.withColumnsRenamed({"hit_spans": spans_so_far, "hit_items": items_so_far}), "decontaminate")
        automaton = spark.sparkContext.broadcast(Automaton(shard, window))

        def make(automaton=automaton):
            def work(column: pa.Array, *before: pa.Array) -> list[pa.Array]:
                found = automaton.value
                n_words, spans, items = [], [], []
                for row, t in enumerate(texts_of(column)):
                    words = words_of(t)
                    s, i = found.scan(words)
                    if before:
                        s += [(x["start"], x["end"]) for x in before[0][row].as_py()]
                        i.update(before[1][row].as_py())
                    n_words.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in united(s)])
                    items.append(sorted(i))
                return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]

            return work

        before = (spans_so_far, items_so_far) if k else ()
        out = append_columns(out, text, fields, make, drop=() if keep_text or not last else (text,), more=before).drop(*before)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.withColumn("n_hit", hit)


def _with_last(source):
    """Each element, and whether it is the last."""
    source = iter(source)
    ahead = next(source)
    for item in source:
        yield ahead, False
        ahead = item
    yield ahead, True


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", per_word: int = 20):
    """At least one word in per_word is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * per_word >= F.col(n_words))


def cut_spans(found: DataFrame, text: str = "text", least_words: int = WINDOW) -> DataFrame:
    """Cut hit spans of at least least_words words out of the text, from their first word's to their last word's byte."""
    import re

    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def cut(raw: bytes | None, spans) -> str | None:
        spans = [(s["start"], s["end"]) for s in spans or () if s["end"] - s["start"] >= least_words]
        if not spans or not raw:
            return None if raw is None else raw.decode("utf-8", "replace")
        at = [m.span() for m in word.finditer(raw)]
        kept, done = [], 0
        for a, b in spans:
            kept.append(raw[done : at[a][0]])
            done = at[b - 1][1]
        return b"".join([*kept, raw[done:]]).decode("utf-8", "replace")

    def make():
        return lambda column, spans: [pa.array([cut(t, s) for t, s in zip(texts_of(column), spans.to_pylist(), strict=True)], pa.string())]

    return append_columns(found, text, [T.StructField(text, T.StringType())], make, more=("hit_spans",))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, per_word: int = 20, least_words: int | None = None, n_chars: str | None = "n_chars") -> DataFrame:
    """Drop documents beyond the coverage limit; with least_words, also cut spans of that length out of the others.

    Returns the columns of docs, with n_chars set anew, where there is one, for texts that lose a span.
    """
    aside = {c: f for c, f in zip(ADDED, fresh(docs, *(f"_own_{c}" for c in ADDED)), strict=True) if c in docs.columns}
    found = find_spans(docs.withColumnsRenamed(aside), benchmark, text, window).where(~contaminated(per_word=per_word))
    if least_words is not None:
        found = cut_spans(found, text, least_words)
        if n_chars in docs.columns and n_chars != text:
            lost = F.exists("hit_spans", lambda s: s["end"] - s["start"] >= least_words)
            found = found.withColumn(n_chars, F.when(lost, F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return found.drop(*ADDED).withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = f"""WITH word_lists AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), text FROM benchmark),
words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM word_lists),
starts AS (
  SELECT id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM words WHERE kind = 'i' AND len(w) > 0),
windows AS (SELECT DISTINCT id AS item, n, list_slice(w, i, i + n - 1) AS x FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE kind = 'd' AND len(w) >= n),
hits AS (SELECT p.id, p.i, p.n, item FROM (SELECT id, n, i, list_slice(w, i, i + n - 1) AS x FROM places) p JOIN windows v ON p.n = v.n AND p.x = v.x),
covered AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY id),
found AS (
  SELECT CAST(id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(names, '') AS names
  FROM words LEFT JOIN covered USING (id) LEFT JOIN items USING (id) WHERE kind = 'd')
SELECT doc_id, n_words, n_hit, n_items, sha256(names) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM found"""
