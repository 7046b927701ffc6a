"""Removal of repeated passages with sharded Aho-Corasick automata.

Each word goes that is covered by a window of LENGTH words which also starts in a document with a smaller doc_id.

Every window has an anchor: of the GRAM-word phrases in it the one with the least hash. Equal windows have equal anchors at equal places, so
a passage can only recur around a recurring anchor, and anchors are few, some two in ten words. Anchors are counted over all documents;
around those that two texts share, the texts give segments: the run of windows that have the anchor, 13 to 21 words. Segments are dealt
to shards by anchor. A shard confirms which windows recur, word by word, compiles these into an Aho-Corasick automaton over its own word
numbers, and streams its segments through it; each occurrence is told with the least doc_id that has the window. So all documents
pass through the automata, but each only through those that can know any part of it.

An anchor in more than HOT texts is split by the hashes of its windows over several shards, and equal segments are one before they are
shuffled; so no shard depends on how common a phrase is. Equal texts are one text with its least doc_id: all windows of the other
copies start there. Texts are moved once, to a table bucketed by their hash.

Defined results: a null or empty text has no words; a text of fewer than LENGTH words loses none; a row without doc_id neither takes
words from others nor loses any; rows of one doc_id don't take words from each other; an empty table gives no rows; other columns pass deduplicate() as they are.
"""

from __future__ import annotations

import re
import uuid
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, materialize, new_path, small_batches, table, texts_of
from .decontaminate import united
from .sentencepieces import Numbers

LENGTH, GRAM = 13, 5
HOT = 2_000  #: texts with one anchor beyond which its windows go to several shards
SHARD_ROWS = 10_000  #: segments of a shard, on average, before equal ones are made one
SLICE, PIECE = 1 << 18, 1 << 17
PLACE = np.uint64((1 << 20) - 1)
_FACTORS = np.random.default_rng(13).integers(1 << 63, size=GRAM + 1, dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(14).integers(1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
WHITE = re.compile(rb"[\x20\x09-\x0D]")
_IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE[_IS_WHITE] = 0  # so what follows a word adds nothing to its hash
_PLACES = np.random.default_rng(15).integers(1 << 63, size=1 << 12, dtype=np.uint64) | np.uint64(1)  #: by place in the word, over again after so many
SPANS = "array<struct<start:long,end:long>>"


def _runs(hashes: np.ndarray, parts: list[tuple[int, int]], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and anchors' hashes of the blocks of words; windows don't cross parts (offset, size)."""
    h = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        h += hashes[k : len(hashes) - gram + 1 + k] * _FACTORS[k]
    h ^= h >> np.uint64(32)
    h *= _FACTORS[gram]
    h ^= h >> np.uint64(29)
    least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, width = length - gram + 1, 1
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
    return starts, n, h[anchor[starts]].view(np.int64)


def _pieces(texts: list[bytes]):
    """Lists of (text number, offset, part) of some PIECE bytes; long texts are cut at white space."""
    held, size = [], 0
    for t, text in enumerate(texts):
        at = 0
        while at < len(text):
            found = WHITE.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = found.start() if found else len(text)
            held.append((t, at, text[at:end]))
            size += end - at
            at = end
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def words_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hash of each word, its first byte and its end in the text, and how many words each text has.

    A word's hash is the mixed sum of its bytes' random numbers times factors by place. Other words with an equal hash only make more anchors recur.
    """
    counts, hashes, firsts, lasts = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for held in _pieces(texts):
        raw = np.frombuffer(b" ".join([part for _, _, part in held]) + b" ", np.uint8)
        white = _IS_WHITE[raw]
        edge = np.flatnonzero(np.diff(white, prepend=True))  # by turns a word's first byte and its end
        first, last = edge[::2], edge[1::2]
        if not len(first):
            continue
        h = np.add.reduceat(_BYTE[raw] * _PLACES[_within(first, len(raw)) & (len(_PLACES) - 1)], first)
        h ^= h >> np.uint64(32)
        h *= _FACTORS[0]
        sizes = np.array([len(part) + 1 for _, _, part in held])
        begin = np.cumsum(sizes) - sizes
        which = np.searchsorted(begin, first, "right") - 1
        shift = (np.array([at for _, at, _ in held]) - begin)[which]
        np.add.at(counts, np.array([t for t, _, _ in held]), np.bincount(which, minlength=len(held)))
        hashes.append(h)
        firsts.append(first + shift)
        lasts.append(last + shift)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts), counts


def _within(first: np.ndarray, size: int) -> np.ndarray:
    """Each byte's place after the first byte of its word."""
    return np.arange(size, dtype=np.int32) - np.repeat(np.r_[0, first].astype(np.int32), np.diff(np.r_[0, first, size]))


def _blocks(hashes: np.ndarray, counts: np.ndarray, length: int, gram: int):
    """(text number, start, windows, anchor) arrays of all texts' blocks, slice by slice, from their words' hashes."""
    held, parts, size = [], [], 0

    def close():
        starts, n, anchors = _runs(np.concatenate(held), [(o, s) for _, o, _, s in parts], length, gram)
        which = np.searchsorted(np.array([o for _, o, _, _ in parts]), starts, "right") - 1
        text, shift = np.array([t for t, _, _, _ in parts])[which], np.array([b - o for _, o, b, _ in parts])[which]
        return text, starts + shift, n, anchors

    ends = np.cumsum(counts)
    for t, (a, z) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
        for begin in range(a, z - length + 1, SLICE):
            part = hashes[begin : min(z, begin + SLICE + length - 1)]
            parts.append((t, size, begin - a, len(part)))
            held.append(part)
            size += len(part)
            if size >= SLICE:
                yield close()
                held, parts, size = [], [], 0
    if held:
        yield close()


def blocks_of(texts: list[list[bytes]], length: int = LENGTH, gram: int = GRAM):
    """(text number, start, windows, anchor) arrays of the blocks of all texts, given as words."""
    hashes, _, _, counts = words_of([b" ".join(words) for words in texts])
    return _blocks(hashes, counts, length, gram)


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in texts_of(batch.column("text"))]


def _batch_blocks(batch: pa.RecordBatch, length: int, gram: int):
    hashes, _, _, counts = words_of(_raw(batch))
    return _blocks(hashes, counts, length, gram)


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [t.split() if t else [] for t in texts_of(batch.column("text"))]


def _counted(length: int, gram: int):
    """(g, lo, hi, n) of each slice's anchors: the least and greatest doc_id that have it, and how often."""

    def run(batches):
        for batch in batches:
            first = batch.column("first").to_numpy()
            for text, _, _, g in _batch_blocks(batch, length, gram):
                order = np.argsort(g, kind="stable")
                ids, g = first[text[order]], g[order]
                begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
                if len(begin):
                    n = np.diff(np.r_[begin, len(g)])
                    made = (g[begin], np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin), n)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["g", "lo", "hi", "n"])
        give_back()

    return run


def _listed(length: int, gram: int):
    """(g, k1, k2) of every text's anchors, each once a text and slice."""

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for text, _, _, g in _batch_blocks(batch, length, gram):
                order = np.lexsort((g, text))
                text, g = text[order], g[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
                text, g = text[new], g[new]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(k1[text]), pa.array(k2[text])], names=["g", "k1", "k2"])
        give_back()

    return run


SEGMENT = "k1 long, k2 long, first long, start int, g long, sub int, mask int, words binary"


def _segments(length: int, gram: int):
    """Segments around the anchors listed beside each text; mask has a bit for each window that the row's shard is to judge."""

    def run(batches):
        from xxhash import xxh3_64_intdigest as digest

        names = [x.split()[0] for x in SEGMENT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            texts, out = _raw(batch), []
            hashes, first, last, counts = words_of(texts)
            before = np.cumsum(counts) - counts
            keys = [batch.column(c).to_pylist() for c in ("k1", "k2", "first")]
            wanted = [{x["g"]: x["m"] for x in row} for row in batch.column("anchors").to_pylist()]
            flat = np.unique(np.fromiter((g for row in wanted for g in row), np.int64))
            for text, start, n, g in _blocks(hashes, counts, length, gram):
                some = np.flatnonzero(np.isin(g, flat))
                text, start, n, g = text[some], start[some], n[some], g[some]
                word = before[text] + start
                begin, end = first[word], last[word + n + (length - 2)]
                for t, s, n_, a, i, j in zip(*(x.tolist() for x in (text, start, n, g, begin, end)), strict=True):
                    m = wanted[t].get(a)
                    if m is None:
                        continue
                    words = texts[t][i:j].split()
                    if m == 1:
                        masks = {0: (1 << n_) - 1}
                    else:
                        masks = {}
                        for i in range(n_):
                            sub = digest(b" ".join(words[i : i + length])) % m
                            masks[sub] = masks.get(sub, 0) | 1 << i
                    whole = b" ".join(words)
                    out += [(keys[0][t], keys[1][t], keys[2][t], s, a, sub, mask, whole) for sub, mask in masks.items()]
                if len(out) >= 20_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)
            out = None
        give_back()

    return run


def occurrences(segments: list[tuple[bytes, int, int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """(window's place, least doc_id that has it) of the recurring windows of a shard's segments (words, mask, least and greatest doc_id).

    Windows that are found with two doc_ids or more are confirmed; the automaton of these is built over numbers of the shard's words.
    """
    import ahocorasick

    numbers = Numbers()
    coded = [tuple(map(numbers.__getitem__, words.split(b" "))) for words, _, _, _ in segments]
    seen: dict[tuple[int, ...], tuple[int, int]] = {}
    for ids, (_, mask, lo, hi) in zip(coded, segments, strict=True):
        for i in range(len(ids) - length + 1):
            if mask >> i & 1:
                w = ids[i : i + length]
                before = seen.get(w)
                seen[w] = (lo, hi) if before is None else (min(lo, before[0]), max(hi, before[1]))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, (lo, hi) in seen.items():
        if lo < hi:
            automaton.add_word(w, lo)
    seen.clear()
    if not len(automaton):
        return [[] for _ in segments]
    automaton.make_automaton()
    out = []
    for ids, (_, mask, _, _) in zip(coded, segments, strict=True):
        out.append([(end - length + 1, lo) for end, lo in automaton.iter(ids) if mask >> (end - length + 1) & 1])
    return out


def _automata(length: int):
    """Rows (shard, u1, u2, sub, words, mask, lo, hi) in order of shards: (u1, u2, sub, found) of segments with recurring windows."""
    kind = pa.list_(pa.struct([("place", pa.int32()), ("source", pa.int64())]))

    def judged(keys, segments):
        rows = [(*key, [{"place": p, "source": s} for p, s in found]) for key, found in zip(keys, occurrences(segments, length), strict=True) if found]
        if rows:
            u1, u2, sub, found = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u1), pa.array(u2), pa.array(sub, pa.int32()), pa.array(found, kind)], names=["u1", "u2", "sub", "found"])

    def run(batches):
        shard, keys, segments = None, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "u1", "u2", "sub", "words", "mask", "lo", "hi"))
            for s, u1, u2, sub, words, mask, lo, hi in zip(*columns, strict=True):
                if s != shard:
                    if segments:
                        yield from judged(keys, segments)
                    shard, keys, segments = s, [], []
                keys.append((u1, u2, sub))
                segments.append((words, mask, lo, hi))
        if segments:
            yield from judged(keys, segments)
        keys = segments = None
        give_back()

    return run


def text_keys(text: str = "text") -> list:
    """k1 and k2, 128 bits that tell texts apart; null is as empty."""
    given = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(given).alias("k1"), F.xxhash64(given, F.lit(13)).alias("k2")]


def _cut(batches):
    """n_words, n_removed, spans and hashes of each text, beside the places of its removed windows."""
    names = ["k1", "k2", "first", "n_words", "n_removed", "spans", "kept_sha256", "whole_sha256"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        made = [[] for _ in range(5)]
        for words, places, length in zip(_words(batch), batch.column("places").to_pylist(), batch.column("length").to_pylist(), strict=True):
            spans = united([(p, p + length) for p in places or ()])
            whole = kept = sha256(b" ".join(words)).hexdigest()
            if spans:
                rest, done = [], 0
                for a, z in spans:
                    rest += words[done:a]
                    done = z
                kept = sha256(b" ".join(rest + words[done:])).hexdigest()
            for column, x in zip(made, (len(words), sum(z - a for a, z in spans), [{"start": a, "end": z} for a, z in spans], kept, whole), strict=True):
                column.append(x)
        kinds = [pa.int64(), pa.int64(), kind, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=names)
    give_back()


def _judged_texts(docs: DataFrame, text: str, doc_id: str, length: int, gram: int, hot: int, shard_rows: int) -> DataFrame:
    """(k1, k2, first, n_words, n_removed, spans, kept_sha256, whole_sha256) of every distinct text, as its least doc_id has it."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*text_keys(text), F.col(doc_id).cast("long").alias("first"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    name, buckets = f"sondeline_phrases_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.first("text").alias("text"))
    distinct.write.bucketBy(buckets, "k1", "k2").option("path", new_path(spark, "phrase-texts", name)).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    known = texts.where("first is not null")

    counted = known.select("first", "text").mapInArrow(_counted(length, gram), "g long, lo long, hi long, n long")
    anchors = counted.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi")
    anchors = materialize(anchors.select("g", F.ceil(F.col("n") / hot).cast("int").alias("m")), "anchors")
    listed = known.select("k1", "k2", "text").mapInArrow(_listed(length, gram), "g long, k1 long, k2 long")
    listed = listed.join(anchors, "g").groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "m")).alias("anchors"))  # no more than the text's length
    around = texts.join(listed, ["k1", "k2"]).select("k1", "k2", "first", "text", "anchors")
    segments = materialize(around.mapInArrow(_segments(length, gram), SEGMENT), "segments")

    u = [F.xxhash64("words").alias("u1"), F.xxhash64("words", F.lit(13)).alias("u2")]
    once = segments.groupBy("g", "sub", "mask", "words").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    shards = max(1, -(-segments.count() // shard_rows))
    dealt = once.select(F.pmod(F.xxhash64("g", "sub"), F.lit(shards)).alias("shard"), *u, "sub", "words", "mask", "lo", "hi")
    dealt = dealt.repartition(max(1, min(shards, buckets)), "shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(_automata(length), "u1 long, u2 long, sub int, found array<struct<place:int,source:long>>")
    found = materialize(found, "occurrences")
    places = segments.select("k1", "k2", "first", "start", *u, "sub").join(found, ["u1", "u2", "sub"]).select("k1", "k2", "first", "start", F.inline("found"))
    places = places.where("source < first").groupBy("k1", "k2").agg(F.collect_set(F.col("start") + F.col("place")).alias("places"))
    joined = texts.join(places, ["k1", "k2"], "left").select("k1", "k2", "first", "text", "places", F.lit(length).alias("length"))
    return materialize(joined.mapInArrow(_cut, f"k1 long, k2 long, first long, n_words long, n_removed long, spans {SPANS}, kept_sha256 string, whole_sha256 string"), "judged-texts")


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row; spans are the half-open word intervals that go."""
    judged = _judged_texts(docs, text, doc_id, length, gram, hot, shard_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_keys(text)).join(judged, ["k1", "k2"])
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= length)
    free = F.col("doc_id").isNull()
    nothing = F.lit(sha256(b"").hexdigest())
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return rows.select(
        F.col("doc_id").alias(doc_id),
        "n_words",
        F.when(copy, F.col("n_words")).when(free, F.lit(0).cast("long")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, nothing).when(free, F.col("whole_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, whole).when(free, F.array().cast(SPANS)).otherwise(F.col("spans")).alias("spans"),
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """docs without the repeated passages. A text that loses words has its other words joined by one space; others stay as they are."""
    k1, k2, first, gone, n, kept = fresh(docs, "_k1", "_k2", "_first", "_spans", "_n", "_kept")
    judged = _judged_texts(docs, text, doc_id, length, GRAM, HOT, SHARD_ROWS)
    judged = judged.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("first").alias(first), F.col("spans").alias(gone), F.col("n_words").alias(n))
    keyed = docs.withColumns(dict(zip((k1, k2), text_keys(text), strict=True))).join(judged, [k1, k2], "left")
    copy = F.coalesce(F.col(doc_id) > F.col(first), F.lit(False)) & (F.col(n) >= length)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rest = F.filter(words, lambda w, i: ~F.exists(gone, lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.when(copy, "").when((F.size(gone) > 0) & F.col(doc_id).isNotNull(), F.array_join(rest, " ")).otherwise(F.col(text))
    return keyed.withColumn(kept, cut).select(*(F.col(kept).alias(c) if c == text else F.col(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents")).drop("spans")


ORACLE_SQL = f"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + {LENGTH - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM words)),
least AS (SELECT x, min(doc_id) AS m FROM windows GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS p FROM windows JOIN least USING (x) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""
