"""BM25 retrieval with hard filters over a report log, in set-based form."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions.scalars import in_shift, snippet, stamp, tokens
from ..sources.staging import written


SEGMENT = 1 << 23  #: characters of a segment


def _segments(docs: DataFrame, text: str, size: int) -> int:
    """Into how many parts texts go. Runs a job: the sum of the lengths."""
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // size))


def segmented(docs: DataFrame, text: str = "body", key: str = "idx", size: int = SEGMENT) -> DataFrame:
    """Key and text in ranges of the key, which grow in number with the texts and not in size. Runs a job."""
    return docs.select(key, text).repartitionByRange(_segments(docs, text, size), key)


def dealt(docs: DataFrame, text: str = "body", key: str = "idx", size: int = SEGMENT) -> DataFrame:
    """segmented() by hashes of the key, for where no order is asked for: postings() of it shuffles texts once, and no posting. Runs a job."""
    return docs.select(key, text).repartition(_segments(docs, text, size), key)


def postings(docs: DataFrame, text: str = "body", key: str = "idx", cfg: Retrieval = Retrieval()) -> DataFrame:
    """(key, term, tf, len): term frequencies and the document's length in tokens; documents without a token have none."""
    terms = docs.select(key, tokens(text, cfg).alias("terms")).select(key, F.size("terms").cast("long").alias("len"), F.explode_outer("terms").alias("term"))
    terms = terms.where("term is not null")  # the outer form, as the plain one has the planner tokenise once more in a filter
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def frequencies_of(docs: DataFrame, text: str = "body", cfg: Retrieval = Retrieval()) -> DataFrame:
    """document_frequencies() of texts: each text's distinct tokens, counted in one shuffle."""
    return document_frequencies(docs.select(F.explode(F.array_distinct(tokens(text, cfg))).alias("term")))


def asked_for(docs: DataFrame, terms: list[str], text: str = "body", cfg: Retrieval = Retrieval()) -> tuple[DataFrame, DataFrame]:
    """(postings of the given terms, one row with the number of documents and their mean length), from one pass over the texts.

    What is written in between has a row a document: its length, and its tokens among the terms.
    """
    lengths = docs.select("idx", tokens(text, cfg).alias("t")).select("idx", F.size("t").cast("long").alias("len"), F.filter("t", lambda w: w.isin(*terms)).alias("held"))
    lengths = written(lengths, "asked")
    hits = lengths.select("idx", "len", F.explode("held").alias("term")).groupBy("idx", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    return hits, lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def query_tokens(query: str, cfg: Retrieval = Retrieval()) -> list[str]:
    """tokens() of a query, on the driver."""
    words = (re.sub(r"^[.'-]+|[.'-]+$", "", w) for w in re.sub(r"[^a-z0-9./'-]+", " ", query.lower()).split())
    return list(dict.fromkeys(w for w in words if 2 <= len(w) <= 24 and w not in cfg.stop))


def expanded(query: str, cfg: Retrieval = Retrieval()) -> list[str]:
    """Query terms with synonyms: of phrases that the query contains, then of every term so far, once."""
    terms = dict.fromkeys(query_tokens(query, cfg))
    phrases = [s for p, s in cfg.synonyms.items() if " " in p and p in query.lower()]
    terms.update(dict.fromkeys(w for s in phrases for w in s))
    terms.update(dict.fromkeys(w for t in list(terms) for w in cfg.synonyms.get(t, ())))
    return list(terms)


@dataclass(frozen=True)
class Filters:
    well: str | None = None
    rig: str | None = None
    activity: str | None = None
    phase: str | None = None
    hole_size: str | None = None
    npt_only: bool = False
    begin: datetime | None = None
    end: datetime | None = None
    depth_min: float | None = None
    depth_max: float | None = None


# How questions name shifts, wells and rigs. A well's name is taken only where `wells` lists it.
NIGHT = re.compile(r"\bnights?\b|after midnight|overnight")
DAY = re.compile(r"\bday shift\b|\bdaytime\b|\bdays\b")
WELL = re.compile(r"\bSEBL[_\s-]?0*(\d+)\b", re.I)
RIG = re.compile(r"\bPHR[_\s-]?0*(\d+)\b", re.I)


def shift_of(query: str) -> str | None:
    text = query.lower()
    return "night" if NIGHT.search(text) else "day" if DAY.search(text) else None


def inferred(query: str, given: Filters = Filters(), wells: tuple[str, ...] = Retrieval().wells) -> Filters:
    """A known well, or a rig, named in the question is a filter, unless one is given."""
    found = dict(vars(given))
    if not given.well and (m := WELL.search(query)) and (name := f"SEBL_{m[1].zfill(3)}") in wells:
        found["well"] = name
    if not given.rig and (m := RIG.search(query)):
        found["rig"] = f"PHR-0{m[1]}"
    return Filters(**found)


def condition(f: Filters, shift: str | None = None) -> Column:
    """The filters as one predicate, which reaches the scan. Interval ends count as inside; a missing depth is 0."""
    depth = F.coalesce("depth_ft", F.lit(0.0))
    tests = [
        *(F.col(c) == v for c, v in (("well", f.well), ("rig", f.rig), ("activity", f.activity), ("hole_size", f.hole_size)) if v),
        *([(F.col("phase1") == f.phase) | (F.col("phase2") == f.phase)] if f.phase else []),
        *([F.col("npt_hrs") > 0] if f.npt_only else []),
        *([F.col("end") >= f.begin] if f.begin is not None else []),
        *([F.col("start") <= f.end] if f.end is not None else []),
        *([depth >= f.depth_min] if f.depth_min is not None else []),
        *([depth <= f.depth_max] if f.depth_max is not None else []),
        *([in_shift("start", shift)] if shift else []),
    ]
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def search(docs: DataFrame, query: str, given: Filters = Filters(), limit: int = 8, cfg: Retrieval = Retrieval(), index: DataFrame | None = None) -> DataFrame:
    """Top hits: the rows of docs with score, matched terms and a snippet, best first, report order in ties.

    docs: idx, start, end, body (searched), comment (shown) and the filters' columns. Frequencies and lengths are those of the whole log, not of
    the candidates. Terms in more than cfg.common of the documents are dropped, unless all are.
    """
    terms, filters, shift = expanded(query, cfg), inferred(query, given, cfg.wells), shift_of(query)
    spark = docs.sparkSession
    asked = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, place int")
    if index is None:
        hits, total = asked_for(docs, terms, cfg=cfg)
    else:
        hits = index.where(F.col("term").isin(*terms))  # a query's terms
        total = docs.agg(F.count("*").alias("n")).join(F.broadcast(index.agg(F.sum("tf").alias("all")))).select("n", (F.coalesce("all", F.lit(0)) / F.col("n")).alias("avg_len"))
    hits = hits.join(F.broadcast(asked), "term")
    used = rated_terms(asked, hits.groupBy("term").agg(F.count("*").alias("df")), total, cfg)
    rows = candidates(docs, scored(hits.drop("place"), used, cfg), filters, shift, boosts(filters, query, cfg), cfg)
    top = rows.orderBy(F.desc("score"), "start", "idx").limit(limit)
    return shown(docs.join(F.broadcast(top.select("idx", "score", "matched")), "idx"))  # no more than `limit` rows


def rated_terms(asked: DataFrame, known: DataFrame, total: DataFrame, cfg: Retrieval) -> DataFrame:
    """(term, place, idf, avg_len, asked) of the terms that count. known: their df; total: one row n, avg_len."""
    rated = asked.join(known, "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long"))).join(F.broadcast(total))
    rare = F.when(F.col("df") <= F.lit(cfg.common) * F.col("n"), 1).otherwise(0)
    count = rated.agg(F.sum(rare).alias("rare"), F.count("*").alias("every"))
    used = rated.withColumn("is_rare", rare).join(F.broadcast(count)).where((F.col("is_rare") == 1) | (F.col("rare") == 0))
    used = used.withColumn("asked", F.when(F.col("rare") > 0, F.col("rare")).otherwise(F.col("every")))
    idf = F.greatest(F.lit(0.0), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return used.select("term", "place", idf.alias("idf"), "avg_len", "asked")


def saturation(cfg: Retrieval, length: Column) -> Column:
    """A posting's weight but for its term's idf; length in mean lengths."""
    return (F.col("tf") * (cfg.k1 + 1)) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * length))


def scored(hits: DataFrame, used: DataFrame, cfg: Retrieval) -> DataFrame:
    """(idx, score, matched) of postings (idx, term, tf, len): weights summed up, by the share of the terms that were met."""
    weighed = hits.join(F.broadcast(used), "term")  # a query's terms
    weight = F.col("idf") * saturation(cfg, F.col("len") / F.col("avg_len"))
    found = weighed.groupBy("idx").agg(F.sum(weight).alias("raw"), F.array_sort(F.collect_list(F.struct("place", "term"))).alias("m"), F.first("asked").alias("asked"))
    return found.where("raw > 0").select("idx", (F.col("raw") * F.sqrt(F.size("m") / F.col("asked"))).alias("score"), F.col("m.term").alias("matched"))


def boosts(filters: Filters, query: str, cfg: Retrieval) -> bool:
    """Whether the question is about lost time, so that reports that book some count for more."""
    return bool(filters.npt_only or re.search(cfg.problem, query, re.I))


def candidates(docs: DataFrame, found: DataFrame, filters: Filters, shift: str | None, boost: bool, cfg: Retrieval) -> DataFrame:
    """(idx, start, score, matched) of scored rows that meet the filters; of docs only the columns that filters and order need."""
    rows = docs.where(condition(filters, shift)).select("idx", "start", "npt_hrs").join(found, "idx")
    score = F.when(F.col("npt_hrs") > 0, F.col("score") * cfg.problem_boost).otherwise(F.col("score")) if boost else F.col("score")
    return rows.select("idx", "start", F.round(score, 3).alias("score"), "matched")


def shown(top: DataFrame) -> DataFrame:
    """Hits in order, with snippets and without the searched text."""
    return top.orderBy(F.desc("score"), "start", "idx").withColumn("snippet", snippet("comment", F.col("matched"))).drop("body")


def answer(hits: DataFrame) -> DataFrame:
    """One row: a text made of the hits' own fields. hits: a top-k result, so a bounded number of rows."""
    order = F.struct((-F.col("score")).alias("s"), "start", "idx")
    booked = F.col("npt_hrs") > 0
    facts = hits.agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set("well")), " and ").alias("wells"),
        F.array_join(F.array_sort(F.collect_set("activity")), ", ").alias("acts"),
        F.min("start").alias("a"),
        F.max("end").alias("b"),
        F.count_if(booked).alias("k"),
        F.coalesce(F.sum(F.when(booked, F.col("npt_hrs"))), F.lit(0.0)).alias("hours"),
        F.min_by(F.struct("npt_hrs", "start", "activity"), F.when(booked, order)).alias("top"),
    )
    found = F.format_string("I found %d report lines on %s, from %s to %s (rig time), under %s.", "n", "wells", stamp("a"), stamp("b"), "acts")
    npt = F.format_string(" %d of those book non-productive time, %.2f hours in all; the first booked %.2f on %s, under %s.", "k", "hours", "top.npt_hrs", stamp("top.start"), "top.activity")
    none = F.lit("Nothing in the reports matches that. Try an activity code, a well, a hole size or a depth range.")
    return facts.select(F.when(F.col("n") == 0, none).otherwise(F.concat(found, F.when(F.col("k") > 0, npt).otherwise(""))).alias("answer"))
