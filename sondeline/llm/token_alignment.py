"""Alignment of two tokenizers over the same bytes, and how usual each aligned pair of tokens is in the corpus.

Side A is a byte-level BPE, side B a SentencePiece model; both encode the text after one space. The byte offsets where tokens of both
sides end cut them into groups, and two tokens that share a group are linked. A pair's count is the number of documents that hold it.

Each document becomes a row of its figures and of its pairs with their multiplicities, packed by shards of side A's ids, and is
written once. Counts are summed before they are shuffled. Then the postings of a shard meet its counts: a shard has as many slices as
its postings need, postings are dealt to the slices by document, counts go to each, and within a partition all is in order
of shard, slice and counts first (Spark's sort spills). A task reads the counts of one shard, takes the maximum of each id of side A,
and lets the postings stream by; what it sends on are sums by document, which are then summed over shards. A slice has at least
four times as many postings as its shard has counts, so sending counts to all slices costs a quarter at most; an id in every
document is only a shard with more slices. No task holds more than one shard's counts, which the two vocabularies bound.

Long texts are encoded in parts that begin at a single space between other characters, where tokens of both sides begin anyway.

Defined results: null and empty texts, and texts whose bytes aren't those of either side's tokens (such as those with U+2581), have no
tokens, zeros and an empty groups_sha256; strings of special tokens are plain text; repeated rows count as documents of their
own; a null doc_id passes; an empty table gives no rows; columns other than the text pass groups() as they are.
"""

from __future__ import annotations

import json
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, give_back, materialize, new_path, small_batches, table
from .sentencepieces import BYTE, GROUP_CHARS, MARKER, NORMAL, UNUSED, Codec

PAIRS = 1 << 21  #: token pairs that are laid out at once
SHARDS = 64  #: of side A's ids
SLICE_PAIRS = 1 << 20  #: postings of a slice, at least
VOCABULARY = 1 << 22  #: a larger vocabulary is refused: keys of pairs have 64 bits


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for their bytes, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Side A, read from a file of the tokenizers library; tiktoken encodes, which joins by rank: a vocabulary whose ids don't follow its merges is refused."""

    def __init__(self, raw: str):
        import tiktoken
        from public_tokenizers import PATTERN

        found = json.loads(raw)
        special = {x["content"] for x in found["added_tokens"]}
        ids = {t: i for t, i in found["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in found["model"]["merges"]]
        order = [ids[a + b] for a, b in merges]
        if found["model"]["type"] != "BPE" or order != sorted(order):
            raise ValueError("side A must be a byte-level BPE whose ids are in the order of its merges")
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in ids.items()}
        self.encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for t, i in ranks.items():
            self.bytes[i] = t

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + p) for p in parts]


class Pieces:
    """Side B: a SentencePiece model, which puts the space before a text itself."""

    def __init__(self, raw: bytes):
        self.codec = Codec(raw, threads=1)
        pieces = self.codec.model.pieces
        self.size = len(pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARKER, " ").encode() if k in (NORMAL, UNUSED) else b"" for p, _, k in pieces]

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """The sentencepiece library's ids; where the model allows it, the library encodes each distinct word once a task."""
        return self.codec.referenced(parts)


class Aligner:
    """One task's tokenizers and tables."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        if max(self.a.size, self.b.size) > VOCABULARY:
            raise ValueError(f"a vocabulary of more than {VOCABULARY} ids can't be aligned")
        self.lengths = [np.array(list(map(len, side.bytes)), np.int64) for side in (self.a, self.b)]
        self.flat = [np.frombuffer(b"".join(side.bytes), np.uint8) for side in (self.a, self.b)]
        self.first = [np.cumsum(n) - n for n in self.lengths]
        self.said = [b"%d%c" % (i, c) for side, ends in ((self.a, b",|"), (self.b, b",;")) for c in ends for i in range(side.size)]

    def chunks(self, texts: list[str | None]):
        """Lists of (text number, part) of bounded size."""
        held, size = [], 0
        for t, text in enumerate(texts):
            for part in self.b.codec.parts(text) if text else ():
                if held and size + len(part) > GROUP_CHARS:
                    yield held
                    held, size = [], 0
                held.append((t, part))
                size += len(part)
        if held:
            yield held

    def same(self, side: int, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
        """Whether each part's tokens have its bytes."""
        every = np.concatenate(ids)
        n = self.lengths[side][every]
        sizes = np.array(list(map(len, ids)))
        ends = np.r_[0, np.cumsum(n)][np.cumsum(sizes)]
        found = np.diff(ends, prepend=0) == np.array(list(map(len, raw)))
        if found.all():
            at = np.repeat((self.first[side][every] - np.cumsum(n) + n).astype(np.int32), n)
            at += np.arange(len(at), dtype=np.int32)
            if np.array_equal(self.flat[side][at], np.frombuffer(b"".join(raw), np.uint8)):
                return found
        for k, (x, said) in enumerate(zip(ids, raw, strict=True)):
            found[k] = b"".join(map((self.a, self.b)[side].bytes.__getitem__, x.tolist())) == said
        return found

    def align(self, chunk: list[tuple[int, str]]) -> tuple[set[int], dict | None]:
        """Numbers of texts whose bytes differ, and the tokens and groups of the other parts."""
        parts = [p for _, p in chunk]
        raw = [(" " + p).encode() for p in parts]
        texts, bad = np.array([t for t, _ in chunk], np.int64), set()
        sides = [[np.asarray(ids, np.int64) for ids in side.encode(parts)] for side in (self.a, self.b)]
        right = np.logical_and(*(self.same(k, ids, raw) for k, ids in enumerate(sides)))
        if not right.all():
            bad = set(texts[~right].tolist())
            kept = np.flatnonzero(right).tolist()
            texts, raw, sides = texts[kept], [raw[k] for k in kept], [[ids[k] for k in kept] for ids in sides]
        if not len(texts):
            return bad, None
        sizes = np.array([list(map(len, x)) for x in (*sides, raw)], np.int64).T
        a, b = map(np.concatenate, sides)
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        shared = np.zeros((2, ends_a[-1] + 1), bool)  # by byte: whether tokens of either side end there
        shared[0, ends_a] = shared[1, ends_b] = True
        shared = shared[0] & shared[1]
        common = np.flatnonzero(shared)
        before = np.cumsum(shared) - shared
        ga, gb = before[ends_a], before[ends_b]
        na, nb = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
        of = texts[np.searchsorted(np.cumsum(sizes[:, 2]), common)]
        return bad, {"a": a, "b": b, "ga": ga, "gb": gb, "na": na, "nb": nb, "of": of, "texts": texts, "sizes": sizes}

    def pairs(self, x: dict) -> tuple[np.ndarray, np.ndarray]:
        """(key, links) of each text's distinct pairs in a chunk, in order; the key is text, shard of a, a within the shard, and b."""
        width = -(-self.a.size // SHARDS)
        a = ((x["a"] % SHARDS) * width + x["a"] // SHARDS) * self.b.size
        text = x["of"] * (SHARDS * width * self.b.size)
        na, nb = x["na"], x["nb"]
        sa, sb, n = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
        keys, links = [], []

        def add(found, weights=None):
            k, inverse = np.unique(found, return_inverse=True)
            keys.append(k)
            links.append(np.bincount(inverse, weights).astype(np.int64) if weights is None else np.bincount(inverse, weights.astype(np.float64)).astype(np.int64))

        small = np.flatnonzero(n <= PAIRS)
        total = np.cumsum(n[small])
        begin = 0
        while begin < len(small):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            g = small[begin:stop]
            which = np.repeat(g, n[g])
            k = np.arange(len(which)) - np.repeat(np.cumsum(n[g]) - n[g], n[g])
            add(text[which] + a[sa[which] + k // nb[which]] + x["b"][sb[which] + k % nb[which]])
            begin = stop
        for g in np.flatnonzero(n > PAIRS):  # a group without common ends for long: by its distinct ids
            (ua, ca), (ub, cb) = (np.unique(v[s : s + m], return_counts=True) for v, s, m in ((a, sa[g], na[g]), (x["b"], sb[g], nb[g])))
            for k in range(len(ua)):
                keys.append(text[g] + ua[k] + ub)
                links.append(ca[k] * cb)
        if len(keys) == 1:
            return keys[0], links[0]
        return _merged(keys, links)

    def said_groups(self, x: dict):
        """(text number, `a1,a2|b1;a3|b2,b3`) of each text of a chunk."""
        na, nb = x["na"], x["nb"]
        after_a, after_b = np.cumsum(na), np.cumsum(nb)
        order = np.empty(len(x["a"]) + len(x["b"]), np.int64)
        place = np.arange(len(x["a"]))
        order[place + (after_b - nb)[x["ga"]]] = x["a"] + self.a.size * (place == after_a[x["ga"]] - 1)
        place = np.arange(len(x["b"]))
        order[place + after_a[x["gb"]]] = 2 * self.a.size + x["b"] + self.b.size * (place == after_b[x["gb"]] - 1)
        ends = np.cumsum(x["sizes"][:, 0] + x["sizes"][:, 1])
        last = np.flatnonzero(np.r_[x["texts"][1:] != x["texts"][:-1], True])
        begin = 0
        for t, end in zip(x["texts"][last].tolist(), ends[last].tolist(), strict=True):
            yield t, b"".join(map(self.said.__getitem__, order[begin:end].tolist()))[:-1]
            begin = end


def _merged(keys: list[np.ndarray], links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, with their links summed."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(links)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(n, begin) if len(begin) else n


def _packed(links: np.ndarray) -> bytes:
    """One byte each where all fit, else eight."""
    return links.astype(np.uint8 if links.max() < 256 else np.uint64).tobytes()


COUNTED = ("n_a", "n_b", "n_groups", "n_links")


class _Shipped:
    def __init__(self, spark: SparkSession, a: str | None, b: str | None):
        """The vocabulary files' contents; by default the public ones, where the package that holds them is installed."""
        if a is None or b is None:
            import public_tokenizers as public
        with open(a or public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            side_a = f.read()
        with open(b or public.path("piece_bpe_32k.model"), "rb") as f:
            side_b = f.read()
        self.sent = spark.sparkContext.broadcast((side_a, side_b))

    def aligner(self) -> Aligner:
        return Aligner(*self.sent.value)


def _documents(shipped: _Shipped):
    """Each text's figures, and by shard its pairs (4 bytes each: a within the shard, and b) and their links."""

    def make():
        aligner = shipped.aligner()
        width = -(-aligner.a.size // SHARDS)
        local = width * aligner.b.size
        kind = np.uint32 if local < 1 << 32 else np.uint64

        def work(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            figures, bad = np.zeros((4, len(texts)), np.int64), set()
            digests: dict[int, object] = {}
            keys, links = [], []
            for chunk in aligner.chunks(texts):
                wrong, x = aligner.align(chunk)
                bad |= wrong
                if x is None:
                    continue
                for row, at, by in ((0, x["texts"], x["sizes"][:, 0]), (1, x["texts"], x["sizes"][:, 1]), (2, x["of"], None), (3, x["of"], x["na"] * x["nb"])):
                    np.add.at(figures[row], at, 1 if by is None else by)
                for t, said in aligner.said_groups(x):
                    if t in digests:
                        digests[t].update(b";" + said)
                    else:
                        digests[t] = sha256(said)
                k, n = aligner.pairs(x)
                keys.append(k)
                links.append(n)
            key, n = _merged(keys, links) if len(keys) > 1 else (keys[0], links[0]) if keys else _merged([], [])
            of, rest = np.divmod(key, SHARDS * local)
            if bad:
                figures[:, list(bad)] = 0
                good = ~np.isin(of, list(bad))
                of, rest, n = of[good], rest[good], n[good]
            shard, code = np.divmod(rest, local)
            code = code.astype(kind)
            begin = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (shard[1:] != shard[:-1])]) if len(of) else np.zeros(0, np.int64)
            stop = np.r_[begin[1:], len(of)].astype(np.int64)[: len(begin)]
            cells, wide, raw = list(zip(begin.tolist(), stop.tolist(), strict=True)), code.itemsize, code.tobytes()
            few = n.astype(np.uint8).tobytes() if len(n) and n.max() < 256 else None
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(of[begin], minlength=len(texts)))], pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(x, t))
                for x, t in ((shard[begin], pa.int32()), ([raw[wide * i : wide * j] for i, j in cells], pa.binary()), ([few[i:j] if few else _packed(n[i:j]) for i, j in cells], pa.binary()))
            ]
            hashes = ["" if t in bad or t not in digests else digests[t].hexdigest() for t in range(len(texts))]
            return [*(pa.array(f) for f in figures), pa.array(hashes, pa.string()), *lists]

        return work

    fields = [*(T.StructField(c, T.LongType()) for c in COUNTED), T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField(c, T.ArrayType(t)) for c, t in (("shards", T.IntegerType()), ("codes", T.BinaryType()), ("links", T.BinaryType()))]
    return fields, make


def _code_bytes(aligner_sizes: tuple[int, int]) -> int:
    return 4 if -(-aligner_sizes[0] // SHARDS) * aligner_sizes[1] < 1 << 32 else 8


def _numbers(cells: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each cell has."""
    cells = cells.cast(pa.binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    raw = np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), np.uint32 if size == 4 else np.uint64).astype(np.int64), np.diff(offsets) // size


def _links(cells: pa.Array, counts: np.ndarray) -> np.ndarray:
    raw = cells.to_pylist()
    if all(len(x) == n for x, n in zip(raw, counts.tolist(), strict=True)):
        return np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    return np.concatenate([np.frombuffer(x, np.uint8 if len(x) == n else np.uint64).astype(np.int64) for x, n in zip(raw, counts.tolist(), strict=True)])


def _counting(size: int):
    """(shard, code, n): in how many documents of a batch each pair is."""

    def run(batches):
        for batch in batches:
            shards, cells = batch.column("shards").flatten().to_numpy(zero_copy_only=False), batch.column("codes").flatten()
            if not len(shards):
                continue
            code, each = _numbers(cells, size)
            found, n = np.unique(code * SHARDS + np.repeat(shards, each), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found % SHARDS, pa.int32()), pa.array(found // SHARDS), pa.array(n)], names=["shard", "code", "n"])
        give_back()

    return run


def pair_counts(aligned: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(shard, code, n): the number of documents of each pair."""
    return aligned.select("shards", "codes").mapInArrow(_counting(_code_bytes(sizes)), "shard int, code long, n long").groupBy("shard", "code").agg(F.sum("n").alias("n"))


def _meeting(size: int, size_b: int):
    """Rows in order of shard, slice and kind: of each shard first its counts, then postings; (row, n_best, count_sum) of the postings."""

    def run(batches):
        at, codes, counts, best = None, [], [], None
        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy() for c in ("shard", "slice", "kind"))
            if not len(kind):
                continue
            cut = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(kind)], strict=True):
                if at != (shard[i], part[i]):
                    at, codes, counts, best = (shard[i], part[i]), [], [], None
                if kind[i] == 0:
                    codes.append(batch.column("code").slice(i, j - i).to_numpy())
                    counts.append(batch.column("n").slice(i, j - i).to_numpy())
                    continue
                if best is None:
                    codes, counts = np.concatenate(codes), np.concatenate(counts)
                    order = np.argsort(codes)
                    codes, counts = codes[order], counts[order]
                    begin = np.flatnonzero(np.r_[True, codes[1:] // size_b != codes[:-1] // size_b])
                    best = counts == np.repeat(np.maximum.reduceat(counts, begin), np.diff(np.r_[begin, len(codes)]))
                code, each = _numbers(batch.column("codes").slice(i, j - i), size)
                links = _links(batch.column("links").slice(i, j - i), each)
                where = np.searchsorted(codes, code)
                starts = np.cumsum(each) - each
                made = (np.add.reduceat(links * best[where], starts), np.add.reduceat(links * counts[where], starts))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), *map(pa.array, made)], names=["row", "n_best", "count_sum"])
        codes = counts = best = None
        give_back()

    return run


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", a: str | None = None, b: str | None = None, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row. a and b: paths of the vocabulary files."""
    spark = docs.sparkSession
    shipped = _Shipped(spark, a, b)
    aligner = shipped.aligner()
    sizes = (aligner.a.size, aligner.b.size)
    fields, make = _documents(shipped)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    made = append_columns(rows, "text", fields, make, drop=("text",))
    path = new_path(spark, "aligned")
    made.write.option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(made.schema).parquet(path)

    counts = materialize(pair_counts(aligned, sizes), "pair-counts")
    each = counts.groupBy("shard").agg(F.sum("n").alias("postings"), F.count("*").alias("pairs")).collect()  # one row a shard
    slices = [1] * SHARDS
    for r in each:
        slices[r["shard"]] = -(-r["postings"] // max(slice_pairs, 4 * r["pairs"]))
    slices_of = F.element_at(F.array(*map(F.lit, slices)), F.col("shard") + 1)
    told = counts.select("shard", F.explode(F.sequence(F.lit(0), slices_of - 1)).alias("slice"), F.lit(0).alias("kind"), "code", "n")
    told = told.withColumns({"row": F.lit(None).cast("long"), "codes": F.lit(None).cast("binary"), "links": F.lit(None).cast("binary")})
    postings = aligned.select("row", F.inline(F.arrays_zip("shards", "codes", "links"))).withColumnRenamed("shards", "shard")
    postings = postings.withColumns({"slice": F.pmod(F.xxhash64("row"), slices_of).cast("int"), "kind": F.lit(1), "code": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
    dealt = told.unionByName(postings).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind")
    sums = dealt.mapInArrow(_meeting(_code_bytes(sizes), sizes[1]), "row long, n_best long, count_sum long")
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = aligned.select("doc_id", "row", *COUNTED, "groups_sha256").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return found.select(F.col("doc_id").alias(doc_id), *COUNTED, "n_best", "count_sum", "groups_sha256")


def groups(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """docs with their groups as one string each, `a1,a2|b1;a3|b2,b3` in ids of both sides, in `token_groups`; no shuffle."""
    shipped = _Shipped(docs.sparkSession, a, b)

    def make():
        aligner = shipped.aligner()

        def work(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            said: list[list[bytes]] = [[] for _ in texts]
            bad: set[int] = set()
            for chunk in aligner.chunks(texts):
                wrong, x = aligner.align(chunk)
                bad |= wrong
                for t, part in aligner.said_groups(x) if x else ():
                    said[t].append(part)
            return [pa.array(["" if t in bad else b";".join(s).decode() for t, s in enumerate(said)], pa.string())]

        return work

    return append_columns(docs, text, [T.StructField("token_groups", T.StringType())], make)


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return align(table(spark, sf_dir, "documents"))
