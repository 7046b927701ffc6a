"""Removal of every byte covered by a LENGTH-byte string that starts at two or more places of the corpus.

Suffixes are ordered only through their first LENGTH bytes, most significant digit first, and only groups that are still
plural go on to the next pass; in the end equal groups are exactly the repeated windows. A pass doesn't move single
suffixes but blocks of neighbouring ones. The first digit cuts the corpus into blocks: the windows that have
the same least 32-byte string (by hash) in them make one block, so equal windows lie at equal places of blocks with
an equal digit. A block has two keys: `g`, the hash of bytes that all its windows share, and `u`, the hash of all
its bytes. Blocks with an unshared g hold no repeated window and are dropped; blocks that share both keys are repeated
as they are; the others are cut into blocks of CELL windows for the second pass, and those into single windows for the third,
where the two keys are two hashes of one window, 128 bits together.

Counts are aggregated before each shuffle and joined back (adaptive skew joins split a hot key); one block stands for
all that share both keys when blocks are cut further. Texts are moved once, to a table of distinct texts that is
bucketed by their hash, and equal texts are one row of it: all their bytes are repeated, and they go no further.
Later passes read that table in place. Each table of a pass is deleted, and its shuffles with it, as soon as the next one
is written, so the disk never holds more than two steps of a pass; only texts and spans are left in the end.

Defined results: a null or empty text has no bytes and loses none; a text shorter than LENGTH loses none; overlapping
repeats count, within one document too; repeated rows repeat each other; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, give_back, materialize, new_path, small_batches, table, texts_of

LENGTH, GRAM, CELL = 200, 32, 8
SLICE = 1 << 18
PLACE = np.uint64((1 << 20) - 1)
SPANS = "array<struct<start:long,end:long>>"


def _random(count: int) -> np.ndarray:
    return np.random.default_rng(200).integers(1 << 63, size=count, dtype=np.uint64) | np.uint64(1)


_BYTE, _FACTORS = _random(256), _random(8)


def _runs(piece: bytes, parts: list[tuple[int, int]], length: int) -> tuple[np.ndarray, ...]:
    """Starts, numbers of windows, places of the anchors and hashes of the anchors of a piece's blocks.

    parts: offset and size of the texts in the piece; windows don't cross them.
    """
    raw = np.frombuffer(piece, np.uint8)
    h, width, k = _BYTE[raw], 1, 0
    while width < GRAM:
        h = h[:-width] * _FACTORS[k] + h[width:]
        width, k = 2 * width, k + 1
    h ^= h >> np.uint64(32)
    h *= _FACTORS[7]
    h ^= h >> np.uint64(29)
    least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, width = length - GRAM + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    anchor = (least & PLACE).astype(np.int64)
    inside, cut = np.zeros(len(anchor), bool), np.ones(len(anchor), bool)
    cut[1:] = anchor[1:] != anchor[:-1]
    for offset, size in parts:
        inside[offset : offset + size - length + 1] = True
        cut[offset] = True
    starts = np.flatnonzero(cut & inside)
    stops = np.r_[np.flatnonzero(cut | ~inside), len(anchor)]
    n = stops[np.searchsorted(stops, starts, "right")] - starts
    return starts, n, anchor[starts], h[anchor[starts]].view(np.int64)


def _blocks_of(texts: list[bytes], length: int):
    """(text number, start, windows, anchor's place less start, g, u) arrays of the texts' blocks, piece by piece."""
    from xxhash import xxh3_64_intdigest as digest

    def close():
        piece = b"".join(held)
        starts, n, anchors, g = _runs(piece, [(o, s) for _, o, _, s in parts], length)
        view = memoryview(piece)
        u = np.array([digest(view[a:b]) for a, b in zip(starts.tolist(), (starts + n + length - 1).tolist(), strict=True)], np.uint64).view(np.int64)
        which = np.searchsorted(np.array([o for _, o, _, _ in parts]), starts, "right") - 1
        text, shift = np.array([t for t, _, _, _ in parts])[which], np.array([b - o for _, o, b, _ in parts])[which]
        return text, starts + shift, n, anchors - starts, g, u

    held, parts, size = [], [], 0
    for t, text in enumerate(texts):
        for begin in range(0, len(text) - length + 1, SLICE):
            part = text[begin : begin + SLICE + length - 1]
            parts.append((t, size, begin, len(part)))
            held.append(part)
            size += len(part)
            if size >= SLICE:
                yield close()
                held, parts, size = [], [], 0
    if held:
        yield close()


def _first_blocks(length: int):
    """Blocks of whole texts; of a text's equal blocks the first stays, counting twice, and the others are hits (g and u null)."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for text, p, n, o, g, u in _blocks_of(texts, length):
                order = np.lexsort((p, u, g, text))
                same = (text[order][1:] == text[order][:-1]) & (g[order][1:] == g[order][:-1]) & (u[order][1:] == u[order][:-1])
                later, twice = np.zeros(len(p), bool), np.zeros(len(p), bool)
                later[order[1:][same]] = True
                twice[order[:-1][same]] = True
                yield _records(k1[text], k2[text], p, n, o, g, u, 1 + (twice & ~later), np.zeros(len(p), bool), later)
        give_back()

    return run


RECORD = "k1 long, k2 int, p int, n int, o int, g long, u long, times int, known boolean"


def _records(k1, k2, p, n, o, g, u, times, known, no_key=None) -> pa.RecordBatch:
    as32 = lambda x: pa.array(np.asarray(x, np.int32))
    columns = [pa.array(k1), as32(k2), as32(p), as32(n), as32(o), pa.array(g, mask=no_key), pa.array(u, mask=no_key), as32(times), pa.array(known)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RECORD.split(", ")])


def _cut_blocks(length: int, cell: int):
    """Cut the blocks listed beside each text into blocks of `cell` windows, aligned on the anchors."""

    def run(batches):
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            out = [[] for _ in range(9)]
            size = 0
            lists = batch.column("blocks")
            for t, text in enumerate(texts_of(batch.column("text"))):
                k1, k2, view = batch.column("k1")[t].as_py(), batch.column("k2")[t].as_py(), memoryview(text)
                for b in lists[t].as_py():
                    p, n, o, known = b["p"], b["n"], b["o"], b["known"]
                    a = p + o
                    for c in range((o - n + 1) // cell, o // cell + 1):
                        far, near = min(o, cell * c + cell - 1), max(o - n + 1, cell * c)
                        if cell > 1:
                            shared, seed = view[a - cell * c : a - cell * (c + 1) + 1 + length], 0
                        else:
                            shared, seed = view[a - far : a - near + length], 1
                        whole = view[a - far : a - near + length]
                        row = (k1, k2, a - far, far - near + 1, far, digest(shared, seed), digest(whole), 1, known)
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                        size += 1
                if size >= 100_000:
                    yield _listed(out)
                    out, size = [[] for _ in range(9)], 0
            if size:
                yield _listed(out)
            out = None
        give_back()

    return run


def _listed(out) -> pa.RecordBatch:
    k1, k2, p, n, o, g, u, times, known = out
    return _records(np.array(k1, np.int64), k2, p, n, o, np.array(g, np.uint64).view(np.int64), np.array(u, np.uint64).view(np.int64), times, np.array(known, bool))


def _pass(records: DataFrame, length: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """Hits (k1, k2, start, end) of a pass, and one block of each pair of keys whose g is shared by several u. The table of the records goes."""
    spark = records.sparkSession
    shared = records.groupBy("g").agg(F.sum("times").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi"))
    shared = materialize(shared.where("m > 1").select("g", (F.col("lo") == F.col("hi")).alias("same")), f"{tag}-shared")
    discard(spark)
    plural = materialize(records.join(shared, "g"), f"{tag}-plural")
    discard(spark, records, shared)
    mixed = plural.where("not same")
    pairs = mixed.groupBy("g", "u").agg(F.sum("times").alias("m"), F.max("known").alias("known"), F.min(F.struct("k1", "k2", "p", "n", "o")).alias("b"))
    pairs = materialize(pairs.select("g", "u", (F.col("m") > 1).alias("twice"), "known", "b"), f"{tag}-pairs")
    again = mixed.join(pairs.where("twice").select("g", "u"), ["g", "u"])
    columns = ["k1", "k2", F.col("p").cast("long").alias("start"), (F.col("p") + F.col("n") + (length - 1)).cast("long").alias("end")]
    hits = materialize(plural.where("same and not known").select(*columns).union(again.where("not known").select(*columns)), f"{tag}-hits")
    discard(spark, plural)
    return hits, pairs.select("b.*", (F.col("twice") | F.col("known")).alias("known"))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the bucketed table k1, k2, copies, text of distinct texts of `length` bytes and more, and k1, k2, spans of those with repeats."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= length)
    keyed = keyed.select(*text_keys("text"), F.col("text").cast("binary").alias("text"))
    distinct = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    name = f"sondeline_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct.write.bucketBy(buckets, "k1", "k2").option("path", new_path(spark, "texts", name)).saveAsTable(name)
    texts = spark.table(name)

    records = materialize(texts.select("k1", "k2", "text").mapInArrow(_first_blocks(length), RECORD), "blocks")
    own = records.where("g is null").select("k1", "k2", F.col("p").cast("long").alias("start"), (F.col("p") + F.col("n") + (length - 1)).cast("long").alias("end"))
    hits = [materialize(own, "own-hits")]
    found, blocks = _pass(records.where("g is not null"), length, "pass1")
    hits.append(found)
    for number, cell in ((2, CELL), (3, 1)):
        listed = blocks.groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "n", "o", "known")).alias("blocks"))  # no more than the text's length
        cut = texts.join(listed, ["k1", "k2"]).select("k1", "k2", "text", "blocks")
        cells = materialize(cut.mapInArrow(_cut_blocks(length, cell), RECORD), f"cells{number}")
        discard(spark, blocks)
        found, blocks = _pass(cells, length, f"pass{number}")
        hits.append(found)
    every = reduce(DataFrame.union, hits).union(texts.where("copies > 1").select("k1", "k2", F.lit(0).cast("long"), F.octet_length("text").cast("long")))
    spans = every.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = materialize(spans.mapInArrow(_united, f"k1 long, k2 int, spans {SPANS}"), "repeated-spans")
    discard(spark, blocks, *hits)
    return texts, spans


def _united(batches):
    """Disjoint intervals of each row's spans, in order."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans, sizes, starts, ends = batch.column("spans"), [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        flat, offsets = spans.flatten(), np.asarray(spans.offsets)
        a, z = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for i, j in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True):
            order = np.argsort(a[i:j], kind="stable")
            begin, far = a[i:j][order], np.maximum.accumulate(z[i:j][order])
            first = np.flatnonzero(np.r_[True, begin[1:] > far[:-1]])
            starts.append(begin[first])
            ends.append(far[np.r_[first[1:] - 1, len(far) - 1]])
            sizes.append(sizes[-1] + len(first))
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], fields=list(kind.value_type))
        made = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), made], names=["k1", "k2", "spans"])


def text_keys(text: str):
    """Two hashes, 96 bits together, by which texts are taken as equal."""
    return F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")


def _without(text: bytes, spans) -> bytes:
    kept, done = [], 0
    for s in spans:
        kept.append(text[done : s["start"]])
        done = s["end"]
    return b"".join([*kept, text[done:]])


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts, spans = repeated_spans(docs, text, length)

    def digest(batches):
        from hashlib import sha256

        for batch in batches:
            shas = [sha256(_without(t, s)).hexdigest() for t, s in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("spans"), pa.array(shas, pa.string())], names=["k1", "k2", "spans", "sha"])

    cut = texts.select("k1", "k2", "text").join(spans, ["k1", "k2"]).mapInArrow(digest, f"k1 long, k2 int, spans {SPANS}, sha string")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    cut = materialize(cut.select("k1", "k2", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "sha"), "cut-texts")
    empty = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(doc_id, *text_keys(text), F.octet_length(empty).cast("long").alias("n_bytes"), F.sha2(empty.cast("binary"), 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return rows.join(cut, ["k1", "k2"], "left").select(
        doc_id, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")
    )


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, n_chars: str | None = "n_chars") -> DataFrame:
    """Cut the repeated bytes out of the texts; the columns of docs come back, with n_chars set anew where there is one.

    What is left of a character that is cut in two is dropped. A text that is all repeats becomes empty; its row stays.
    """
    _, spans = repeated_spans(docs, text, length)
    h1, h2, s1, s2, cuts = fresh(docs, "_h1", "_h2", "_k1", "_k2", "_spans")
    spans = spans.select(F.col("k1").alias(s1), F.col("k2").alias(s2), F.col("spans").alias(cuts))
    k1, k2 = text_keys(text)
    joined = docs.withColumns({h1: k1, h2: k2}).join(spans, (F.col(h1) == F.col(s1)) & (F.col(h2) == F.col(s2)), "left")
    joined = joined.drop(h1, h2, s1, s2)
    names = docs.columns

    def cut(batches):
        for batch in batches:
            found, columns = batch.column(cuts), [batch.column(n) for n in names]
            at = names.index(text)
            kept = [_without(t, s).decode("utf-8", "ignore") if s else None if t is None else t.decode("utf-8", "replace") for t, s in zip(texts_of(columns[at]), found.to_pylist(), strict=True)]
            columns[at] = pa.array(kept, columns[at].type)
            if n_chars in names:
                k = names.index(n_chars)
                lengths = pa.array([x if not s else len(t) for x, s, t in zip(columns[k].to_pylist(), found.to_pylist(), kept, strict=True)], columns[k].type)
                columns[k] = lengths
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


#: Texts as hexadecimal, so that one byte is two characters.
ORACLE_SQL = f"""WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, md5_number(b[i + 1 : i + {LENGTH}]) AS x FROM (SELECT doc_id, b, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM bytes WHERE length(h) >= {2 * LENGTH})),
shared AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
hits AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, true)::INT AS fresh FROM windows SEMI JOIN shared USING (x)),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS z FROM numbered GROUP BY doc_id, k),
kept AS (SELECT doc_id, k, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) || substring(any_value(h), 2 * max(z) + 1) AS rest
  FROM kept JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)"""
