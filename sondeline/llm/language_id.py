"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of its sample texts. A text, in lower case, is encoded with every language's
dictionary, and the language in whose dictionary it becomes smallest is chosen. Long texts are encoded in pieces of PIECE
bytes, each with the dictionary anew, for otherwise a text's own beginning takes the dictionary's place. Where the two
smallest sizes lie closer than MARGIN of the text's own size, the choice is marked as rejected.

A language's dictionary is made of at most DICTIONARY bytes, and all together of at most ALL_BYTES, which is what is broadcast: pieces of
distinct documents chosen by a hash, each a whole text or, of one longer than an eighth of the dictionary, a part that begins where a hash says.
So a language that has long texts only, or few, is learned like any other. Where a table has more than LANGUAGES languages, those with most documents
are learned, by name where these are equal, and every text is answered by one of them. Every text is encoded whole.

Defined results: `und` with score 0 for a null text and for one without a letter, and everywhere if nothing can be
learned; the language with more documents wins a tie, then the name; null languages and ids aren't learned from; repeated
rows are learned once and answered alike; an empty table gives no rows; other columns pass, but for those named as an added one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, held_out, table, texts_of

DICTIONARY, ALL_BYTES, PIECE, LANGUAGES, LEVEL = 100 << 10, 20 << 20, 16 << 10, 2000, 6
SAMPLE = 400  #: documents of a language at most
MARGIN = 0.01


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", where: Column | None = None) -> list[tuple[str, bytes]]:
    """Dictionaries of each language, those with most documents first."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.octet_length(text) > 0))
    rows = rows.where(where) if where is not None else rows
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("h"), F.col(text).cast("binary").alias("t"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).orderBy(F.desc("n"), "lang")
    counted = counts.limit(LANGUAGES).collect()
    if not counted:
        return []
    most = min(DICTIONARY, ALL_BYTES // len(counted))
    # A hash below a language's share leaves a few times SAMPLE distinct documents of it, however many it has.
    shares = docs.sparkSession.createDataFrame([(r["lang"], 4.0 * SAMPLE / max(r["d"], 1)) for r in counted], "_lang string, _share double")
    few = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(F.pmod("h", F.lit(1 << 40)) < F.col("_share") * (1 << 40))
    size, piece = F.octet_length("t"), most // 8
    begin = F.pmod(F.xxhash64("h"), F.greatest(size - piece, F.lit(0)) + 1).cast("int")
    few = few.select("lang", "h", F.substring(F.col("t"), begin + 1, F.lit(piece)).alias("t")).groupBy("lang", "h").agg(F.min("t").alias("t"))
    order = Window.partitionBy("lang").orderBy("h")
    ranked = few.select("lang", "h", "t", F.row_number().over(order).alias("r"), F.sum(F.octet_length("t") + 1).over(order).alias("total"))
    texts: dict[str, list] = {}
    for r in ranked.where((F.col("r") <= SAMPLE) & (F.col("total") <= most)).select("lang", "h", "t").collect():  # at most ALL_BYTES
        texts.setdefault(r["lang"], []).append((r["h"], bytes(r["t"])))
    named = [r["lang"] for r in counted if r["lang"] in texts]
    return [(name, b"\n".join(t.decode("utf-8", "ignore").lower().encode() for _, t in sorted(texts[name]))) for name in named]


class Identifier:
    """The languages' compressors of one task."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import regex
        import zstandard as z

        self.letter = regex.compile(r"\p{L}")
        self.names = [name for name, _ in dictionaries]
        options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.compressors = []
        for _, content in dictionaries:
            made = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.compressors.append(z.ZstdCompressor(level=LEVEL, dict_data=made, **options))

    def __call__(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is narrow."""
        text = text.decode("utf-8", "replace").lower() if text else ""
        if not self.names or not self.letter.search(text):
            return "und", 0.0, True
        raw = text.encode()
        pieces = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors], float)
        best = int(sizes.argmin())
        # Every two bytes that a language needs more halve its share.
        share = float(1 / np.exp2(-np.minimum(sizes - sizes[best], 60) / 2).sum())
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
        return self.names[best], share, bool(second - sizes[best] < MARGIN * len(raw))


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred, score and rejected to every document."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        of = Identifier(sent.value)

        def work(column: pa.Array) -> list[pa.Array]:
            got = [of(t) for t in texts_of(column)]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return append_columns(docs, text, fields, make, drop=() if keep_text else (text,))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs, where=~held_out(F.col("doc_id"), 5, 0))
    found = identify(docs.select("doc_id", "text"), dictionaries, keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "rejected")
