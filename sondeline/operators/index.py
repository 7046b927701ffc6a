"""A stored inverted index of a report log: built once, asked many times.

Each segment, a range of reports, keeps its postings in order of their terms, so that a question's terms are found by the row groups' ranges. Reports are taken in blocks
of BLOCK neighbouring numbers, and each term has the greatest weight of its postings in a block. A question first scores the blocks that promise most; their k-th
score is a bound, and only blocks that can reach it are scored besides. Texts are read last, by number, for the hits alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Retrieval
from ..sources.staging import new_path
from .search import Filters, boosts, candidates, expanded, inferred, postings, rated_terms, saturation, scored, segmented, shift_of, shown

BLOCK = 1 << 14  #: report numbers of a block
FIRST = 8  #: blocks that are scored to get a bound


@dataclass
class Index:
    """Tables below one folder: postings (term, block, idx, tf, len), bounds (term, block, top), terms (term, df) and one row of totals (n, avg_len)."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def build(docs: DataFrame, path: str | None = None, block: int = BLOCK, cfg: Retrieval = Retrieval()) -> Index:
    """Write the index of docs (idx, body); without a path in the shared folder, until the process ends. Runs jobs; texts are tokenised once.

    Texts are shuffled by ranges of idx, and each range writes a segment: its own postings in order of their terms. No posting is shuffled or sorted
    beyond its segment, and segments grow in number with the texts, not in size.
    """
    spark = docs.sparkSession
    made = Index(spark, path or new_path(spark, "index"))
    found = postings(segmented(docs), cfg=cfg).select("term", F.floor(F.col("idx") / block).cast("long").alias("block"), "idx", "tf", "len").sortWithinPartitions("term", "block", "idx")
    found.write.mode("overwrite").option("parquet.block.size", 1 << 20).option("compression", "zstd").parquet(f"{made.path}/postings")
    stored = made.table("postings")
    lengths = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all"))
    totals = docs.agg(F.count("*").alias("n"), F.count("body").alias("texts")).join(F.broadcast(lengths))
    totals = totals.select("n", (F.col("all") / F.when(F.col("texts") > 0, F.col("texts"))).alias("avg_len"))
    totals.write.mode("overwrite").parquet(f"{made.path}/totals")
    tops = stored.join(F.broadcast(made.table("totals"))).groupBy("term", "block").agg(F.max(saturation(cfg, F.col("len") / F.col("avg_len"))).alias("top"), F.count("*").alias("n"))
    tops.sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{made.path}/bounds")
    made.table("bounds").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{made.path}/terms")
    return made


def search(index: Index, docs: DataFrame, query: str, given: Filters = Filters(), limit: int = 8, cfg: Retrieval = Retrieval(), first: int = FIRST) -> DataFrame:
    """search.search() by the index. Runs jobs: the k-th score of the first blocks and the numbers of the hits, `limit` at most, come to the driver."""
    spark = docs.sparkSession
    terms, filters, shift = expanded(query, cfg), inferred(query, given, cfg.wells), shift_of(query)
    boost = boosts(filters, query, cfg)
    asked = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, place int")
    mine = F.col("term").isin(*terms)  # reaches the scans of postings and bounds
    used = rated_terms(asked, index.table("terms").where(mine), index.table("totals"), cfg)
    promised = index.table("bounds").where(mine).join(F.broadcast(used), "term").groupBy("block").agg(F.sum(F.col("idf") * F.col("top")).alias("sum"), F.count("*").alias("m"), F.first("asked").alias("asked"))
    promised = promised.select("block", (F.col("sum") * F.sqrt(F.col("m") / F.col("asked")) * (cfg.problem_boost if boost else 1.0)).alias("bound")).where("bound > 0")

    def hits(blocks: DataFrame) -> DataFrame:
        mine_in = index.table("postings").where(mine).join(blocks.select("block"), "block", "left_semi").select("idx", "term", "tf", "len")
        return candidates(docs, scored(mine_in, used, cfg), filters, shift, boost, cfg).orderBy(F.desc("score"), "start", "idx").limit(limit)

    best = promised.orderBy(F.desc("bound"), "block").limit(first).collect()  # `first` rows
    seen = spark.createDataFrame([(r["block"],) for r in best], "block long")
    found = hits(F.broadcast(seen)).collect() if best else []
    least = found[-1]["score"] if len(found) == limit else 0.0
    rest = promised.where(F.col("bound") >= F.lit(least) - 0.001).join(F.broadcast(seen), "block", "left_anti")  # scores are rounded to three places
    found += hits(rest).collect()
    top = sorted(found, key=lambda r: (-r["score"], r["start"], r["idx"]))[:limit]
    shape = spark.createDataFrame([(r["idx"], r["score"], r["matched"]) for r in top], "idx long, score double, matched array<string>")
    return shown(docs.where(F.col("idx").isin([r["idx"] for r in top])).join(F.broadcast(shape), "idx"))
