"""Quality rules with host-level verdicts.

Every document is measured by rules; rule failures are summed by host (the column `source`, or any other), each
host's failure rate of each rule is shrunk towards the rate of all hosts by a beta prior that is fitted to the hosts'
rates by their moments, and the host's verdict goes back to its documents. The base rules always count. For the others the host decides:

* A host is rejected, with all its documents, where the shrunk rate of a rule less Z posterior standard deviations still
  exceeds HOST_LIMIT, so that small hosts and chance don't condemn clean documents.
* A host is trusted in one of SOFT where the shrunk rate and Z deviations stay below TRUST: a document that breaks the rule
  there is an oddity among clean ones (a formula, a table) and stays. In every other host such a document goes.

Defined results: a null or empty text has no words and fails the base rule; a null host is neither rejected nor trusted;
repeated rows count as often as they occur; an empty table gives no rows; other columns pass, but for those named as
an added one (ADDED), which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, materialize, table, texts_of

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
SYMBOL_PERCENT, DUP_LINE_PERCENT = 10, 30
HOST_LIMIT, TRUST, Z = 0.5, 0.02, 3.0
#: Hosts up to this number are broadcast (some MB at most); beyond it they are joined with salted keys.
BROADCAST_HOSTS, SALTS = 50_000, 64
SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])  # white space and UTF-8 continuation bytes
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("short", "repetitive", "symbols", "dup_lines")
SOFT = ("symbols", "dup_lines")
ADDED = (*MEASURES, *(f"fails_{r}" for r in RULES), "base_failed", "host_ok", *(f"trusted_{r}" for r in SOFT), "kept")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Windows are ranked by doubling, so equality is exact."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        rank = np.unique(rank[: len(rank) - step] * (len(words) + 1) + rank[step:], return_inverse=True)[1]
        width += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of one text. bytes.split() splits at exactly the six ASCII white space characters."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text.translate(None, NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measures(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the columns MEASURES."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            rows = np.array([measure(t) for t in texts_of(column)], np.int64).reshape(-1, len(MEASURES))
            return [pa.array(rows[:, k]) for k in range(len(MEASURES))]

        return work

    fields = [T.StructField(n, T.LongType()) for n in MEASURES]
    return append_columns(docs, text, fields, make, drop=() if keep_text else (text,))


def rules(measured: DataFrame) -> DataFrame:
    """Add a boolean fails_<rule> for each of RULES, and base_failed."""
    short = F.col("n_words") < LEAST_WORDS
    repetitive = F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT
    return measured.withColumns(
        {
            "fails_short": short,
            "fails_repetitive": repetitive,
            "fails_symbols": F.col("n_symbols") * 100 > F.col("word_chars") * SYMBOL_PERCENT,
            "fails_dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * DUP_LINE_PERCENT,
            "base_failed": short | repetitive,
        }
    )


def host_verdicts(ruled: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures and shrunk rates of each rule, host_ok and trusted_<rule>. A fixed number of columns goes to one row for the prior."""
    counts = (
        ruled.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("host_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"host_{r}") for r in RULES))
    )
    counts = materialize(counts, "hosts")
    prior = counts.agg(
        F.sum("host_docs").alias("docs"),
        F.count("*").alias("hosts"),
        F.avg(F.lit(1.0) / F.col("host_docs")).alias("inverse"),
        *(F.sum(f"host_{r}").alias(f"sum_{r}") for r in RULES),
        *(F.avg(F.pow(F.col(f"host_{r}") / F.col("host_docs"), 2)).alias(f"square_{r}") for r in RULES),
        *(F.avg(F.col(f"host_{r}") / F.col("host_docs")).alias(f"rate_{r}") for r in RULES),
    )
    out = counts.crossJoin(F.broadcast(prior))  # the prior is one row
    ok = F.lit(True)
    for r in RULES:
        mean = F.least(F.greatest(F.col(f"sum_{r}") / F.col("docs"), F.lit(1e-6)), F.lit(1 - 1e-6))
        spread = F.col(f"square_{r}") - F.pow(F.col(f"rate_{r}"), 2) - mean * (1 - mean) * F.col("inverse")
        # The prior's strength by moments, from 1 (hosts differ utterly) to 1000 (hosts are alike).
        strength = F.least(F.greatest(mean * (1 - mean) / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1000.0))
        rate = (F.col(f"host_{r}") + mean * strength) / (F.col("host_docs") + strength)
        deviation = F.sqrt(rate * (1 - rate) / (F.col("host_docs") + strength + 1))
        out = out.withColumn(f"shrunk_{r}", rate)
        ok = ok & (rate - deviation * Z <= HOST_LIMIT)
        if r in SOFT:
            out = out.withColumn(f"trusted_{r}", rate + deviation * Z < TRUST)
    shrunk = [f"shrunk_{r}" for r in RULES]
    return out.withColumn("host_ok", ok).select("host", "host_docs", *(f"host_{r}" for r in RULES), *shrunk, "host_ok", *(f"trusted_{r}" for r in SOFT))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep_text: bool = True) -> DataFrame:
    """Add ADDED to every document.

    With keep_text the texts are measured twice, once for the hosts' sums; without, measures are written and read again.
    """
    given_host, of, salt, own_salt = fresh(docs, "_host", "_of", "_salt", "_own_salt")
    docs = docs.withColumn(given_host, F.col(host)).drop(*(c for c in ADDED if c != text))
    ruled = rules(measures(docs, text, keep_text))
    if not keep_text:
        ruled = materialize(ruled, "quality-measures")
    given = ["host_ok", *(f"trusted_{r}" for r in SOFT)]
    verdicts = materialize(host_verdicts(ruled, given_host), "host-verdicts").select(F.col("host").alias(of), *given)
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = ruled.join(F.broadcast(verdicts), F.col(given_host) == F.col(of), "left")
    else:
        salted = verdicts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = ruled.withColumn(own_salt, F.pmod(F.xxhash64(*MEASURES), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, (F.col(given_host) == F.col(of)) & (F.col(own_salt) == F.col(salt)), "left").drop(salt, own_salt)
    joined = joined.withColumn("host_ok", F.coalesce("host_ok", F.lit(True)))
    kept = ~F.col("base_failed") & F.col("host_ok")
    for r in SOFT:
        joined = joined.withColumn(f"trusted_{r}", F.coalesce(f"trusted_{r}", F.lit(False)))
        kept = kept & (~F.col(f"fails_{r}") | F.col(f"trusted_{r}"))
    return joined.withColumn("kept", kept).drop(given_host, of)


def query(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return found.select("doc_id", *MEASURES, "base_failed", "host_ok", *(f"trusted_{r}" for r in SOFT), "kept")


def _sql() -> str:
    measured = f"""
words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
spread AS (SELECT doc_id, i, md5_number(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS x FROM (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM words WHERE len(w) >= {WINDOW})),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM spread),
repeated AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM windows WHERE c > 1) GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS BIGINT) AS n_lines
  FROM words LEFT JOIN repeated USING (doc_id)),
ruled AS (
  SELECT *, n_words < {LEAST_WORDS} AS fails_short, n_repeat_words * 100 > n_words * {REPEAT_PERCENT} AS fails_repetitive,
    n_symbols * 100 > word_chars * {SYMBOL_PERCENT} AS fails_symbols, n_dup_lines * 100 > n_lines * {DUP_LINE_PERCENT} AS fails_dup_lines
  FROM measured),
hosts AS (
  SELECT source AS host, count(*)::DOUBLE AS docs, {", ".join(f"sum(fails_{r}::INT)::DOUBLE AS f_{r}" for r in RULES)}
  FROM ruled WHERE source IS NOT NULL GROUP BY source),
prior AS (
  SELECT avg(1e0 / docs) AS inverse, {", ".join(f"least(greatest(sum(f_{r}) / sum(docs), 1e-6), 1 - 1e-6) AS m_{r}, avg(pow(f_{r} / docs, 2)) - pow(avg(f_{r} / docs), 2) AS v_{r}" for r in RULES)}
  FROM hosts),
strong AS (
  SELECT hosts.*, {", ".join(f"m_{r}, least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * inverse, 1e-9) - 1, 1e0), 1e3) AS k_{r}" for r in RULES)}
  FROM hosts, prior),
shrunk AS (SELECT *, {", ".join(f"(f_{r} + m_{r} * k_{r}) / (docs + k_{r}) AS p_{r}" for r in RULES)} FROM strong),
verdicts AS (
  SELECT host, {" AND ".join(f"p_{r} - {Z:g} * sqrt(p_{r} * (1 - p_{r}) / (docs + k_{r} + 1)) <= {HOST_LIMIT:g}" for r in RULES)} AS host_ok,
    {", ".join(f"p_{r} + {Z:g} * sqrt(p_{r} * (1 - p_{r}) / (docs + k_{r} + 1)) < {TRUST:g} AS t_{r}" for r in SOFT)} FROM shrunk)"""
    return f"""WITH {measured}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, fails_short OR fails_repetitive AS base_failed,
  coalesce(host_ok, true) AS host_ok, {", ".join(f"coalesce(t_{r}, false) AS trusted_{r}" for r in SOFT)},
  NOT (fails_short OR fails_repetitive) AND coalesce(host_ok, true) AND {" AND ".join(f"(NOT fails_{r} OR coalesce(t_{r}, false))" for r in SOFT)} AS kept
FROM ruled LEFT JOIN verdicts ON source = host"""


ORACLE_SQL = _sql()
