"""The feed from samples to events, and the read API over it. Every method returns a DataFrame and runs nothing by itself."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, FINDING_RANK, SEVERITY_RANK, DetectorConfig, Retrieval, StateThresholds
from ..functions.scalars import phase_label, tick_start, truncated
from ..operators import detect, index, intervals, joins, quality, rollup, search, segments, state
from ..sources.feeds import BadQuery


def parse_time(value: str | int | None) -> datetime | None:
    """Epoch milliseconds or ISO text as a naive UTC time; None stays None, anything else that doesn't parse is refused."""
    if value is None or value == "":
        return None
    text = str(value)
    try:
        if re.fullmatch(r"\d+", text):
            return datetime.fromtimestamp(int(text) / 1000, UTC).replace(tzinfo=None)
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise BadQuery("not a time", text) from e
    return found.astimezone(UTC).replace(tzinfo=None) if found.tzinfo else found


def whole(name: str, value, low: int, high: int) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError) as e:
        raise BadQuery(f"{name} must be a whole number", str(value)) from e
    if not low <= number <= high:
        raise BadQuery(f"{name} must be from {low} to {high}", str(value))
    return number


@dataclass
class Engine:
    """Silver and gold tables of one feed. `step` is the bucket in minutes."""

    minutes: DataFrame  #: classified, with hole sizes
    reports: DataFrame
    offsets: DataFrame
    step: int = 1
    detectors: DetectorConfig = field(default_factory=DetectorConfig)
    retrieval: Retrieval = field(default_factory=Retrieval)
    counters: DataFrame | None = None
    index: index.Index | None = None  #: of the reports, for repeated questions

    @classmethod
    def build(cls, samples: DataFrame, reports: DataFrame, offsets: DataFrame, step: int = 1, thresholds: StateThresholds | None = None, counters: DataFrame | None = None) -> Engine:
        made = rollup.rollup(samples, step)
        classified = state.apply_states(made, thresholds or StateThresholds())
        return cls(joins.hole_sizes(classified, reports), reports, offsets, step, counters=counters)

    def spans(self) -> DataFrame:
        return segments.state_spans(self.minutes, self.step)

    def gaps(self) -> DataFrame:
        return segments.feed_gaps(self.minutes, self.step)

    def events(self) -> DataFrame:
        return detect.detect_all(self.minutes, self.offsets, self.detectors, self.step)

    def window(self) -> DataFrame:
        """The first and the last bucket of each rig."""
        return self.minutes.groupBy("rig_id").agg(F.min("t").alias("t_from"), F.max("t").alias("t_to"))

    def health(self) -> DataFrame:
        """One row: what the data set holds."""
        counts = [df.agg(F.count("*").alias(n)) for n, df in (("minutes", self.minutes), ("reports", self.reports), ("offsets", self.offsets))]
        return reduce(lambda a, b: a.join(F.broadcast(b)), counts, self.minutes.agg(F.min("t").alias("t_from"), F.max("t").alias("t_to")))

    def wells(self) -> DataFrame:
        """Each rig's well by overlap, with coverage and summary."""
        well = joins.busiest_overlap(self.window(), self.reports)
        meta = rollup.feed_meta(self.minutes).select("rig_id", "covered", "rows", "n_min", "n_p50", "n_max", "n_mean")
        return intervals.summary(self.minutes, self.reports, self.step).join(meta, "rig_id").join(well.select("rig_id", "well"), "rig_id")

    def agreement(self) -> DataFrame:
        return joins.agreement(self.minutes, self.reports, self.step).orderBy(F.desc("ddr_minutes"), "activity", "rig_id")

    def quality(self) -> DataFrame:
        if self.counters is None:
            raise BadQuery("quality needs the raw feed's counters")
        return quality.findings(self.counters, self.minutes, self.gaps())

    def state(self, begin=None, end=None) -> tuple[DataFrame, DataFrame]:
        """(spans that overlap the window, their minutes by state); the spans aren't cut."""
        found = intervals.overlapping_spans(self.spans(), parse_time(begin), parse_time(end))
        return found.orderBy("t_from", "rig_id"), intervals.state_totals(found)

    def state_at(self, at) -> DataFrame:
        when = parse_time(at)
        if when is None:
            raise BadQuery("at is missing")
        return intervals.point_lookup(self.spans(), self.minutes, F.lit(when).cast("timestamp_ntz"), self.step)

    def aggregates(self, interval: str = "1h") -> DataFrame:
        lengths = {"1h": 60, "4h": 240, "1d": 1440}
        if interval not in lengths:
            raise BadQuery("unknown interval", ", ".join(lengths))
        return intervals.intervals(self.minutes, lengths[interval] // self.step, self.step).orderBy("rig_id", "t_from")

    def timeseries(self, channels: list[str], begin=None, end=None, resolution: int = 5) -> DataFrame:
        """Points of each channel, with the channel's name; buckets of `resolution` minutes on the epoch."""
        known = (*CHANNELS, *intervals.VIRTUAL)
        unknown = [c for c in channels if c not in known]
        if unknown or not channels:
            raise BadQuery("unknown channels", ", ".join(unknown) or ", ".join(known))
        length = whole("resolution", resolution, 1, 240)
        low, high = parse_time(begin), parse_time(end)
        rows = self.minutes if low is None else self.minutes.where(F.col("t") >= low)
        rows = rows if high is None else rows.where(F.col("t") <= high)
        points = [intervals.resample(rows, c, max(1, length // self.step), self.step).withColumn("channel", F.lit(c)) for c in channels]
        return reduce(DataFrame.unionByName, points).orderBy("channel", "rig_id", "t")

    def anomalies(self, kind: str | None = None, min_severity: str | None = None, begin=None, end=None, sort: str | None = None, descending: bool = True) -> DataFrame:
        """Events that overlap the window, ends included, of a type and of a severity or above; in order of a column, if asked for."""
        if min_severity is not None and min_severity not in SEVERITY_RANK:
            raise BadQuery("unknown severity", ", ".join(SEVERITY_RANK))
        found = filtered_events(self.events(), kind, min_severity, parse_time(begin), parse_time(end))
        return found if sort is None else ordered(found, sort, descending, ("t_from", "rig_id", "id"))

    def anomaly_counts(self) -> DataFrame:
        return self.events().groupBy("type").agg(F.count("*").alias("events"))

    def alert_at(self, t) -> DataFrame:
        """Each rig's first stick-slip alarm that holds the time, its ends included."""
        return alarm_at(self.events(), parse_time(t))

    def offset_envelope(self) -> tuple[DataFrame, DataFrame]:
        """(each offset row against live maxima, exceedance events)."""
        return joins.envelope(self.offsets, self.minutes), detect.envelope_exceedance(self.minutes, self.offsets, self.detectors, self.step)

    def ddr(self, well: str | None = None, activity: str | None = None, npt_only: bool = False, full_comment: bool = False, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """(a page of report rows, totals of all rows that meet the filters)."""
        page, totals = report_page(self.reports, well, activity, npt_only, whole("limit", limit, 1, 600), whole("offset", offset, 0, 1 << 31))
        return (page if full_comment else page.withColumn("comment", truncated("comment"))), totals

    def ddr_query(self, query: str, given: search.Filters = search.Filters(), limit: int = 8) -> tuple[DataFrame, DataFrame]:
        """(citations, an answer made of them)."""
        if not isinstance(query, str) or not 1 <= len(query.strip()) <= 500:
            raise BadQuery("a question has 1 to 500 characters")
        most = min(whole("limit", limit, 1, 1 << 30), 25)
        if self.index is None:
            hits = search.search(self.reports, query.strip(), given, most, self.retrieval)
        else:
            hits = index.search(self.index, self.reports, query.strip(), given, most, self.retrieval)
        return hits.withColumn("phase", phase_label("phase1", "phase2")), search.answer(hits)

    def cockpit(self) -> DataFrame:
        """The dashboard's row of each bucket, rounded; nothing known is 0."""
        return self.minutes.select("rig_id", "t", *(F.round(F.coalesce(c, F.lit(0.0)), d).alias(n) for n, c, d in cockpit_columns()), "state", "hole_size")

    def payload(self) -> dict[str, DataFrame]:
        """The dashboard's tables."""
        return {
            "cockpit": self.cockpit().orderBy("rig_id", "t"),
            "scatter": intervals.every_nth(intervals.scatter(self.minutes), ["rig_id", "t"], F.struct("rig_id", F.to_date("t").alias("day"))),
            "series": intervals.standard_series(self.minutes, 5, self.step),
            "spans": self.spans(),
            "totals": intervals.state_totals(self.spans()),
            "events": self.events(),
            "envelope": joins.envelope(self.offsets, self.minutes, unmatched=False),
            "dominant": intervals.dominant(self.minutes),
            "gaps": self.gaps().orderBy(F.desc("missing"), "t_from").limit(15),
        }


def cockpit_columns():
    """(name, column, digits) of the cockpit's projection."""
    means = {"wob": "WOB", "rpm": "RPM", "spp": "SPP", "hookload": "HKLA", "flow": "MFIA", "back": "MFOP"}
    return [
        *((n, F.col(f"{c}.mean"), 1) for n, c in means.items()),
        ("torque", F.coalesce("torque_median", "TORQUE.mean"), 0),
        ("rop", F.col("rop_calc"), 1),
        ("hole", F.col("hole_depth"), 1),
        ("bit", F.col("bit_depth"), 1),
    ]


def filtered_events(events: DataFrame, kind: str | None = None, min_severity: str | None = None, begin: datetime | None = None, end: datetime | None = None) -> DataFrame:
    out = events if kind is None else events.where(F.col("type") == kind)
    if min_severity is not None:
        out = out.where(F.col("severity").isin([s for s, r in SEVERITY_RANK.items() if r >= SEVERITY_RANK[min_severity]]))
    out = out if begin is None else out.where(F.col("t_to") >= begin)
    return out if end is None else out.where(F.col("t_from") <= end)


def report_page(reports: DataFrame, well: str | None = None, activity: str | None = None, npt_only: bool = False, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    out = reports if well is None else reports.where(F.col("well") == well)
    out = out if activity is None else out.where(F.col("activity") == activity.upper())
    out = out.where("npt_hrs > 0") if npt_only else out
    totals = out.agg(F.count("*").alias("total"), F.round(F.coalesce(F.sum("npt_hrs"), F.lit(0.0)), 2).alias("npt_hours"), F.round(F.coalesce(F.sum("duration_hrs"), F.lit(0.0)), 2).alias("hours"))
    return out.orderBy("start", "idx").offset(offset).limit(limit), totals


def alarm_at(events: DataFrame, when: datetime) -> DataFrame:
    held = events.where((F.col("type") == "STICK_SLIP") & (F.col("severity") == "ALARM") & (F.col("t_from") <= when) & (F.col("t_to") >= when))
    return first_of_rig(held)


def ordered(df: DataFrame, key: str, descending: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """In order of a column that the user chose, severities by rank; nulls last, ties by further columns."""
    if key not in df.columns:
        raise BadQuery("unknown sort key", ", ".join(df.columns))
    by = F.col(key)
    if key == "severity":
        by = F.coalesce(*(F.when(F.col(key) == name, F.lit(rank)) for name, rank in (SEVERITY_RANK | FINDING_RANK).items()))
    return df.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), *ties)


def distinct_values(reports: DataFrame, columns: tuple[str, ...] = ("well", "rig"), order: str = "idx") -> DataFrame:
    """(kind, value, first): the different values of each column, and the least `order` at which each is met; one pass with partial aggregates."""
    pairs = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))
    flat = reports.select(F.col(order).alias("first"), F.explode(pairs).alias("x"))
    return flat.groupBy("x.kind", "x.value").agg(F.min("first").alias("first"))


def first_of_rig(events: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("rig_id").orderBy("t_from", "id"))
    return events.withColumn("place", place).where("place = 1").drop("place")


def observed_days(minutes: DataFrame) -> DataFrame:
    """Day spine from the first to the last observed day."""
    ends = minutes.agg(F.min("t").cast("date").alias("a"), F.max("t").cast("date").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("day"))


def spine(minutes: DataFrame, length: int, step: int = 1) -> DataFrame:
    """Starts of the epoch-aligned buckets of `length` ticks from first to last, for axis ticks and the like."""
    slot = F.floor(F.col("tick") / length).cast("long")
    ends = minutes.agg(F.min(slot).alias("a"), F.max(slot).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("slot")).select(tick_start(F.col("slot") * length, step).alias("t"))
