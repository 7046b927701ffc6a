"""SimHash near-duplicates, found through deletion-variant signatures.

A fingerprint has 64 bits, a bit being 1 if it is set in over half of the hashes of the text's word shingles. Two
fingerprints link at DISTANCE = 2 or fewer differing bits. The 64 bits are cut into two segments, so that of a linked
pair one segment differs by at most one bit. Each segment is indexed with each of its 32 bits left out in turn: 64
keys a fingerprint, and linked fingerprints share a key. Rows are dealt and sorted by key, and only distinct
fingerprints are indexed.

The members of a key are verified where they meet. Up to SMALL members are compared with each other inside the task,
and only a forest of links leaves it. The members of a larger key are not gathered: they are dealt out again by
signatures that leave out one or two more bits, on which equality alone proves a distance of 2 or less, and each
is linked to the least member of its signature. No pairs are made there, nothing is capped, and both ways give the same components.

A distance of 2 is far less than near copies have: at a similarity of 0.8 of their sets of shingles some 10 of 64 bits differ. deduplicate() with a
`similarity` therefore takes fingerprints of passages too. A text is cut where hashes of its shingles say so, each passage gets a fingerprint of
its own shingles, and the PASSAGES least of these find candidates by equality: a changed word changes one passage or two and leaves the others.
Of the texts that share a passage each meets the LEADERS whose passages are shared most, which are those that the others were copied from. Pairs
are verified by the similarity of their sets of shingles, told from each set's SKETCH least hashes (exact up to that size), and link fingerprints beside
those of 2 bits. What that leaves apart is joined by a prefix filter over the sketches, which caps nothing: every two texts with that similarity of sketches
end in one component. Members of a hash are compared in tasks, block by block, and only links that join components leave these.

Defined results: a null text, an empty text and one without words have fingerprint zero, which links like any other;
a text with fewer words than a shingle is one shingle; repeated rows are rows of their own; a null doc_id never is the
least one, except that a component of null ids alone has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, materialize, small_batches, table, texts_of
from .components import components

SHINGLE, SEED, SMALL = 3, 42, 512
PASSAGES, LEADERS, SKETCH = 6, 3, 256
LEAST_PASSAGE, CUT = 6, 8  #: shingles of a passage at least, and of how many one begins a passage on average
SPREAD = 64  #: parts in which a passage's leaders are sought first
BLOCK, GRID = 128, 512  #: members of a hash that meet at once, on average: at first, and then on each side


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """As an unsigned number. bytes.lower() changes A-Z only and bytes.split() splits at exactly the six ASCII spaces."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - shingle + 1))


def passage_starts(hashes: np.ndarray) -> np.ndarray:
    """Where passages begin: at the first shingle, and at shingles whose hash says so, LEAST_PASSAGE or more after the one before."""
    out = [0]
    for i in np.flatnonzero(hashes % np.uint64(CUT) == 0).tolist():
        if i - out[-1] >= LEAST_PASSAGE:
            out.append(i)
    if len(out) > 1 and len(hashes) - out[-1] < LEAST_PASSAGE:
        out.pop()
    return np.array(out)


def signature(text: bytes | None, shingle: int) -> tuple[int, list[int], bytes]:
    """The text's fingerprint, the least fingerprints of its passages (by a mixed order), and the least 32-bit hashes of its set of shingles."""
    hashes = _shingle_hashes(text, shingle)
    if not len(hashes):
        return 0, [], b""
    starts = passage_starts(hashes)
    ones = np.zeros((len(starts), 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        first = int(np.searchsorted(starts, at, "right")) - 1
        inner = starts[first + 1 : np.searchsorted(starts, at + len(part))] - at
        sums = np.add.reduceat(part, np.r_[0, inner], axis=0, dtype=np.int64)
        ones[first : first + len(sums)] += sums
    sizes = np.diff(np.r_[starts, len(hashes)])
    made = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    whole = int(np.packbits(2 * ones.sum(0) > len(hashes), bitorder="little").view(np.uint64)[0])
    made = np.unique(made)
    order = np.argsort(made * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    return whole, made[order[:PASSAGES]].view(np.int64).tolist(), np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SKETCH].tobytes()


def similarity_of(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets by their least hashes; exact where neither set is cut off."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.union1d(x, y)
    for z in (x, y):
        if len(z) == SKETCH:
            both = both[both <= z[-1]]
    common = np.intersect1d(x, y, assume_unique=True)
    return float((common <= both[-1]).sum() / len(both)) if len(both) else 1.0


def signatures(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """fingerprints(), with passages and sketch beside, and without the text."""
    fields = [T.StructField(out, T.LongType()), T.StructField("passages", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            found = [signature(t, shingle) for t in texts_of(column)]
            whole = np.array([f for f, _, _ in found], np.uint64)
            return [pa.array(whole.view(np.int64)), pa.array([p for _, p, _ in found], pa.list_(pa.int64())), pa.array([s for _, _, s in found], pa.binary())]

        return work

    return append_columns(docs, text, fields, make, drop=(text,))


def near_links(signed: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that span the components of fingerprints (column f, with passages and sketch) of texts whose sets of shingles have that similarity or more.

    Pairs with leaders of passages come first, as they are few and join most; rest_links() finds every link between what these leave apart.
    """
    first = materialize(leader_links(signed, similarity), "leader-links")
    return first.union(rest_links(signed, similarity, components(first)))


def _verified(pairs: DataFrame, signed: DataFrame, key: str, similarity: float) -> DataFrame:
    """The pairs (u, v) of keys whose sketches are that similar."""
    side = lambda name: signed.select(F.col(key).alias(name), F.col("sketch").alias(f"sketch_{name}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "sketch_u", "sketch_v")

    def run(batches):
        for batch in batches:
            keep = [similarity_of(a, b) >= similarity for a, b in zip(batch.column("sketch_u").to_pylist(), batch.column("sketch_v").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "u long, v long")


def _tokens(batches):
    """(t, k, size): each hash of the sketch of key k, and how many there are."""
    for batch in batches:
        sketches = [np.frombuffer(x, np.uint32) for x in batch.column("sketch").to_pylist()]
        sizes = np.array([len(x) for x in sketches], np.int32)
        if sizes.sum():
            arrays = [np.concatenate(sketches).view(np.int32), np.repeat(batch.column("k").to_numpy(), sizes), np.repeat(sizes, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["t", "k", "size"])


def rest_links(signed: DataFrame, similarity: float, labels: DataFrame) -> DataFrame:
    """(u, v): links that join all fingerprints of different components (labels: node, component) with such sketches, without a cap.

    Similar sketches share `similarity` of the larger one's hashes at least, cut off or not. In any common order of hashes, here rare ones first, such
    a pair then has a hash in common among the first size - similarity * size + 1 of each. Hashes that no other sketch has can't be that one.

    The members of a hash meet in blocks of some BLOCK, where two of one component aren't compared. Of hashes with more members, most of whose components that has
    joined, each member outside the largest component then meets all others, in blocks of some GRID.
    """
    rows = materialize(signed.select("f", "sketch").withColumn("k", F.xxhash64("f", "sketch")), "sketches")
    held = rows.select("k", "sketch").mapInArrow(_tokens, "t int, k long, size int")
    held = held.withColumn("n", F.count("*").over(Window.partitionBy("t"))).where("n > 1")
    mine = Window.partitionBy("k")
    ordered = held.withColumns({"place": F.row_number().over(mine.orderBy("n", "t")), "shared": F.count("*").over(mine)})
    prefix = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - F.lit(1e-9)) + 1
    first = ordered.where(F.col("place") + F.col("size") - F.col("shared") <= prefix).select("t", "k")
    part = rows.select("k", "f").join(labels, F.col("f") == F.col("node"), "left").select("k", "f", F.coalesce("component", "f").alias("c"))
    members = materialize(first.join(part, "k"), "prefixes")
    groups = members.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high")
    sketches = rows.select("k", "sketch")
    members = materialize(members.join(groups.select("t", "n"), "t").join(sketches, "k"), "mixed")
    place = lambda n, size: F.pmod(F.xxhash64("k"), F.ceil(n / size))
    every = lambda n, size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / size) - 1))
    columns = ["t", "f", "c", "sketch"]
    met = members.select(*columns, place(F.col("n"), BLOCK).alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"))
    met = materialize(_meet_sketches(met, similarity), "met-sketches")

    now = components(met.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    members = members.where(F.col("n") > BLOCK).join(now, F.col("c") == F.col("node"), "left").select("t", "k", "f", "sketch", F.coalesce("component", "c").alias("c"))
    parts = members.groupBy("t", "c").agg(F.count("*").alias("m"))
    groups = parts.groupBy("t").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("n"), (F.sum("m") - F.max("m")).alias("rare")).where("rare > 0")
    members = materialize(members.join(groups, "t"), "apart")
    # A grid of blocks: those outside the largest component by rows, all members by columns.
    left = members.where("c != main").select(*columns, place(F.col("rare"), GRID).alias("i"), every(F.col("n"), GRID).alias("j"), F.lit(0).alias("side"))
    right = members.select(*columns, every(F.col("rare"), GRID).alias("i"), place(F.col("n"), GRID).alias("j"), F.lit(1).alias("side"))
    return met.union(_meet_sketches(left.union(right), similarity)).select("u", "v")


def _meet_sketches(dealt: DataFrame, similarity: float) -> DataFrame:
    """(u, v, cu, cv): links between members (f, c, sketch) of a block (t, i, j) that join its components; side 0 meets side 1, or itself where there is none."""
    small_batches(dealt.sparkSession)
    keys = ["t", "i", "j"]
    rows = dealt.select(*keys, "side", "f", "c", "sketch").repartition(*keys).sortWithinPartitions(*keys, "side", "f")

    def run(batches):
        held, key = ([], []), None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            out = []
            for t, i, j, side, f, c, sketch in zip(*columns, strict=True):
                if (t, i, j) != key:
                    out += block_links(*held, similarity)
                    held, key = ([], []), (t, i, j)
                held[side].append((f, c, np.frombuffer(sketch, np.uint32)))
            yield _links_of(out)
        yield _links_of(block_links(*held, similarity))

    return rows.mapInArrow(run, "u long, v long, cu long, cv long")


def _links_of(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([],) * 4)], names=["u", "v", "cu", "cv"])


def block_links(left: list, right: list, similarity: float) -> list[tuple[int, int, int, int]]:
    """Links (u, v, cu, cv) that join the components of two lists of (f, c, sketch), or of one: members of a component aren't compared."""
    right = right or left
    if len(left) * len(right) < 2:
        return []
    one, many = (np.array([c for _, c, _ in x], np.int64) for x in (left, right))
    sizes = np.array([len(x) for _, _, x in right])
    ends = np.array([x[-1] if len(x) == SKETCH else 0xFFFFFFFF for _, _, x in right], np.uint32)
    out = []
    for a, (f, c, x) in enumerate(left):
        alike = np.minimum(sizes, len(x)) >= similarity * np.maximum(sizes, len(x)) - 1e-9
        rest = np.flatnonzero((many != one[a]) & alike)
        if not len(rest):
            continue
        # similarity_of() for all of them at once
        values, n = np.concatenate([right[b][2] for b in rest.tolist()]), sizes[rest]
        ended = np.minimum(ends[rest], x[-1]) if len(x) == SKETCH else ends[rest]
        inside = values <= np.repeat(ended, n)
        begins = np.r_[0, np.cumsum(n)[:-1]]
        common = np.add.reduceat(inside & (x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values), begins, dtype=np.int64)
        both = np.searchsorted(x, ended, "right") + np.add.reduceat(inside, begins, dtype=np.int64) - common
        for b in rest[common / both >= similarity].tolist():
            if many[b] != one[a]:
                out.append((f, right[b][0], c, right[b][1]))
                gone, stays = many[b], one[a]
                one[one == gone] = stays
                many[many == gone] = stays
    return out


def leader_links(signed: DataFrame, similarity: float) -> DataFrame:
    """(u, v): of such links those with a leader of a passage."""
    signed = signed.dropDuplicates(["f"])
    members = materialize(signed.select("f", F.explode("passages").alias("p")), "passages")
    shared = members.groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(shared, "p"), "shared-passages")
    weight = members.groupBy("f").agg(F.sum(F.log2("n")).alias("weight"))
    rated = members.join(weight, "f").withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(SPREAD)))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "f"))
    leaders = rated.withColumn("place", best("p", "salt")).where(F.col("place") <= LEADERS).withColumn("place", best("p")).where(F.col("place") <= LEADERS)
    pairs = members.select("p", "f").join(leaders.select("p", F.col("f").alias("leader")), "p").where("f <> leader")
    pairs = pairs.select(F.greatest("f", "leader").alias("u"), F.least("f", "leader").alias("v")).distinct()
    return _verified(pairs, signed, "f", similarity)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """Add the fingerprint as a signed long."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            made = np.array([fingerprint(t, shingle) for t in texts_of(column)], np.uint64)
            return [pa.array(made.view(np.int64))]

        return work

    return append_columns(docs, text, [T.StructField(out, T.LongType())], make, drop=() if keep_text else (text,))


def _variants(fps: DataFrame) -> DataFrame:
    """64 rows (key, f) a fingerprint: the key is the number of the left-out bit and the other 31 bits of its segment."""
    rows = fps.select("f", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    segment = F.when(F.col("k") < 32, F.col("f")).otherwise(F.expr("shiftrightunsigned(f, 32)")).bitwiseAND(0xFFFFFFFF)
    bit = F.expr("shiftleft(1L, k % 32)")
    return rows.select(F.expr("shiftleft(cast(k as bigint), 32)").bitwiseOR(segment.bitwiseAND(F.bitwise_not(bit))).alias("key"), "f")


def _forest(f: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a key's members; f: their signed fingerprints, in order."""
    parent = list(range(len(f)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u, links = f.view(np.uint64), []
    for i in range(len(u) - 1):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 2) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(f[i]), int(f[j])))
    return links


def _meet(batches):
    """Rows (key, f) sorted by both, as a stream: links of small keys, and (key, f, null) rows of the larger ones."""
    key, held = None, []

    def close():
        if len(held) > SMALL or len(held) < 2:
            return []
        return [(None, u, v) for u, v in _forest(np.array(held, np.int64))]

    for batch in batches:
        keys, fs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        plural = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
        rows = []
        for s, e in zip(starts[plural].tolist(), ends[plural].tolist(), strict=True):
            if keys[s] != key:
                rows += close()
                key, held = int(keys[s]), []
            if len(held) <= SMALL:
                held += fs[s:e].tolist()
                if len(held) > SMALL:
                    rows += [(key, f, None) for f in held]
                    held = held[: SMALL + 1]
            else:
                rows += [(key, f, None) for f in fs[s:e].tolist()]
        yield from _rows(rows)
    yield from _rows(close())


def _rows(rows):
    if rows:
        key, u, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["key", "u", "v"])


def _signatures(large: DataFrame) -> DataFrame:
    """(s1, s2, f) of members of large keys: equal signatures differ in the left-out bits only, of which there are at most two.

    The key's own segment without its bit and the other segment without one bit; or, once for each fingerprint and
    segment, that whole segment and the other one without two bits.
    """
    base = large.select("key", F.col("u").alias("f"), F.expr("cast(shiftright(key, 32) as int)").alias("k"))
    low, high = F.col("f").bitwiseAND(0xFFFFFFFF), F.expr("shiftrightunsigned(f, 32)")
    base = base.select("key", "f", F.when(F.col("k") < 32, low).otherwise(high).alias("own"), F.when(F.col("k") < 32, high).otherwise(low).alias("other"), (F.col("k") >= 32).cast("int").alias("side"))
    without = lambda *bits: F.expr(f"other & ~({' | '.join(f'shiftleft(1L, {b})' for b in bits)})")
    one = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(31)))).select(
        F.col("key").alias("s1"), F.expr("shiftleft(cast(j as bigint), 32)").bitwiseOR(without("j")).alias("s2"), "f"
    )
    pairs = F.array(*(F.lit(32 * i + j) for i in range(32) for j in range(i)))
    two = base.select("f", "own", "other", "side").distinct().withColumn("p", F.explode(pairs))
    two = two.select(
        F.expr("shiftleft(cast(side + 64 as bigint), 32) | own").alias("s1"),
        F.expr("shiftleft(cast(p + 32 as bigint), 32)").bitwiseOR(without("cast(p div 32 as int)", "(p % 32)")).alias("s2"),
        "f",
    )
    return one.union(two)


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links that span the components of the distinct fingerprints in column f."""
    spark = fps.sparkSession
    small_batches(spark)
    spread = _variants(fps).repartition("key").sortWithinPartitions("key", "f")
    met = materialize(spread.mapInArrow(_meet, "key long, u long, v long"), "met")
    large = _signatures(met.where("v is null"))
    least = large.groupBy("s1", "s2").agg(F.min("f").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = large.join(least, ["s1", "s2"]).where("f > v").select(F.col("f").alias("u"), "v")
    return met.where("v is not null").select("u", "v").union(stars).distinct()


def classes(hashed: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint", more: DataFrame | None = None) -> DataFrame:
    """(fingerprint, component_id, component): the least doc_id of all fingerprints reachable, and the least of these fingerprints. hashed has a row per document; more has further links (u, v)."""
    nodes = materialize(hashed.groupBy(F.col(fingerprint).alias("f")).agg(F.min(doc_id).alias("least")), "fingerprints")
    found = links(nodes.select("f"))
    labels = components(found if more is None else found.union(more))
    joined = nodes.join(labels, nodes["f"] == labels["node"], "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    joined = materialize(joined, "classes")
    ids = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    return joined.join(ids, "c").select(F.col("f").alias(fingerprint), "component_id", F.col("c").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    hashed = materialize(fingerprints(docs.select(doc_id, text), text, shingle, keep_text=False), "simhash")
    return hashed.join(classes(hashed, doc_id), "fingerprint").select(doc_id, "fingerprint", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """Keep one row of each component: of those with its least doc_id the one with the least text; returns the columns of docs.

    With a similarity, texts whose sets of shingles are that alike are linked as well.
    """
    keyed = docs.select(F.col(doc_id).alias("_stay"), F.xxhash64(text).alias("_k1"), F.hash(text).alias("_k2"), F.col(text).alias("_text"))
    if similarity is None:
        hashed, more = materialize(fingerprints(keyed, "_text", shingle, "_f", keep_text=False), "simhash"), None
    else:
        hashed = materialize(signatures(keyed, "_text", shingle, "_f"), "simhash")
        signed = hashed.select(F.col("_f").alias("f"), "passages", "sketch").dropDuplicates(["f", "sketch"])
        more = near_links(materialize(signed, "signed"), similarity)
        hashed = hashed.drop("passages", "sketch")
    found = hashed.join(classes(hashed, "_stay", "_f", more), "_f").where(F.col("_stay").eqNullSafe(F.col("component_id")))
    # A doc_id, null too, may stand on rows of several components: ids alone don't tell which of them a row belongs to.
    found = materialize(found.groupBy("_stay", "_k1", "_k2", "component").agg(F.count("*").alias("_rows")), "near-duplicates")
    many = found.groupBy("component").agg(F.sum("_rows").alias("_n"))
    stay_id, k1, k2, component, n = fresh(docs, "_stay", "_k1", "_k2", "_c", "_n")
    stay = found.join(many, "component").select(F.col("_stay").alias(stay_id), F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("component").alias(component), F.col("_n").alias(n))
    stay = materialize(stay, "stay")
    same = F.col(doc_id).eqNullSafe(F.col(stay_id)) & (F.xxhash64(text) == F.col(k1)) & (F.hash(text) == F.col(k2))
    kept = docs.join(stay, same)
    once = kept.where(F.col(n) == 1).select(*docs.columns)
    if stay.where(F.col(n) > 1).isEmpty():
        return once
    # Several rows of the least doc_id in one component: the one with the least text stays. Maps can't be ordered, so a row goes as it is.
    again = kept.where(F.col(n) > 1).select(F.col(component).alias("c"), F.col(text).alias("t"), F.struct(*docs.columns).alias("row"))
    first = again.groupBy("c").agg(F.min_by("row", F.coalesce("t", F.lit(""))).alias("first"))
    return once.union(first.select("first.*"))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
