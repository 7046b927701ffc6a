"""The five detectors over a stream of classified buckets, with what they compare against kept in state.

Buckets of a rig may come late and in any order up to the watermark. A bucket is final when the watermark has passed it, and is judged in order of
time once the rows after it that its context asks for are final too. The state of a rig holds the last buckets (for trailing medians and
the context of trips), the peaks of the segment's trip, the flagged buckets of runs that are still open, and how many events each detector has had. A run
closes with the first judged bucket that doesn't go on with it; a timer closes runs of a rig that has been silent for long, as at the end of a
feed. Closed runs leave as their flagged buckets, and the batch detectors' own code makes events of them, so both have the same rows.
An event's key is rig, detector and start: a batch that is run again replaces its own files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import ENVELOPE_LIMITS, MAKING_HOLE, PUMPS_ON, DetectorConfig
from ..functions.scalars import tick_start
from ..operators import detect
from ..operators.joins import last_envelopes

SILENCE = 6 * 3600  #: seconds after which a silent rig's feed counts as ended

#: What a bucket brings: name, and where it comes from.
FIELDS = {
    "state": "state", "hole_depth": "hole_depth", "bit_depth": "bit_depth", "off_bottom": "off_bottom", "torque_nmad": "torque_nmad", "torque_median": "torque_median",
    "torque_valid": "cast(torque_valid as double)", "torque_zero_fill": "cast(torque_zero_fill as double)", "rpm": "RPM.mean", "rpm_sd": "RPM.sd", "wob": "WOB.mean", "wob_sd": "WOB.sd",
    "spp": "coalesce(SPP.mean, 0D)", "flow": "coalesce(MFIA.mean, 0D)", "back": "coalesce(MFOP.mean, 0D)", "hookload": "HKLA.max", "section": "section",
    **{f"p90_{c}": f"{c}.p90" for c in ENVELOPE_LIMITS}, **{f"ceiling_{c}": f"cast({limit} as double)" for c, limit in ENVELOPE_LIMITS.items()},
}
#: What the detectors add to a flagged bucket.
ADDED = ("base_spp", "drop_pct", "base_back", "drift", "base", "over", "value", "ceiling")
_TEXT = ("state", "section")
_OUT = "rig_id string, detector int, place int, channel string, ordinal int, tick long, " + ", ".join(f"{c} {'string' if c in _TEXT else 'double'}" for c in FIELDS) + ", " + ", ".join(f"{c} double" for c in ADDED)
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _quantile(values: list[float], q: float) -> float | None:
    if not values:
        return None
    values = sorted(values)
    at = (len(values) - 1) * q
    low, high = int(at), min(int(at) + 1, len(values) - 1)
    return values[low] if low == high else (high - at) * values[low] + (at - low) * values[high]


def _held(x) -> bool:
    return x is not None


class Feed:
    """One rig's state between batches. Buckets are dicts of FIELDS with their tick."""

    def __init__(self, cfg: DetectorConfig, said: str | None = None):
        self.cfg = cfg
        known = json.loads(said) if said else {}
        self.waiting: list[dict] = known.get("waiting", [])  #: not final
        self.line: list[dict] = known.get("line", [])  #: final, in order; the first `judged` of them are judged
        self.judged: int = known.get("judged", 0)
        self.peaks: list[float] = known.get("peaks", [])
        self.trips: int = known.get("trips", 0)
        self.runs: dict[str, list[dict]] = known.get("runs", {})
        self.counts: dict[str, int] = known.get("counts", {})

    def said(self) -> str:
        return json.dumps({k: v for k, v in vars(self).items() if k != "cfg"})

    def advance(self, final: int, ended: bool) -> Iterator[tuple[str, int, list[dict]]]:
        """Judge what can be judged once ticks below `final` are final; with ended, all. Closed runs: (detector's key, ordinal, buckets)."""
        self.waiting.sort(key=lambda b: b["tick"])
        for b in [b for b in self.waiting if ended or b["tick"] < final]:
            if not self.line or b["tick"] > self.line[-1]["tick"]:
                self.line.append(b)
        self.waiting = [b for b in self.waiting if not ended and b["tick"] >= final]
        ahead = 0 if ended else self.cfg.overpull_context
        while self.judged + ahead < len(self.line):
            yield from self._judge(self.judged)
            self.judged += 1
        if ended:
            for key in list(self.runs):
                yield from self._close(key)
        gone = max(0, self.judged - max(self.cfg.flow_baseline, self.cfg.washout_baseline, self.cfg.overpull_context))
        self.line, self.judged = self.line[gone:], self.judged - gone

    def _median(self, i: int, field: str, rows: int) -> float | None:
        if i < rows or self.line[i]["tick"] - self.line[i - rows]["tick"] != rows:
            return None
        return _quantile([b[field] for b in self.line[i - rows : i] if b[field] > 0], 0.5)

    def _judge(self, i: int):
        cfg, b = self.cfg, self.line[i]
        if i == 0 or b["tick"] - self.line[i - 1]["tick"] != 1:
            self.peaks, self.trips = [], 0
        flags = {}
        if self._sticks(b):
            flags["0"] = b
        pumping = b["state"] in PUMPS_ON and b["flow"] >= cfg.min_flow
        if pumping and b["spp"] >= cfg.washout_min_spp:
            spp, flow = (self._median(i, f, cfg.washout_baseline) for f in ("spp", "flow"))
            if _held(spp) and _held(flow) and spp >= cfg.washout_min_spp and flow >= cfg.min_flow:
                drop = (spp - b["spp"]) / spp * 100
                if drop >= cfg.washout_drop_pct and abs(b["flow"] - flow) / flow * 100 <= cfg.washout_flow_pct:
                    flags["1"] = b | {"base_spp": spp, "drop_pct": drop}
        near = self.line[max(0, i - cfg.overpull_context) : i + cfg.overpull_context + 1]
        if self.trips >= cfg.overpull_least and _held(b["hookload"]) and _held(b["off_bottom"]) and b["off_bottom"] > cfg.on_bottom_ft and any(x["state"] == "TRIPPING_OUT" for x in near):
            base = _quantile(self.peaks, cfg.overpull_quantile)
            if base >= cfg.overpull_min_base and b["hookload"] - base >= cfg.overpull_klb:
                flags["2"] = b | {"base": base, "over": b["hookload"] - base}
        if pumping and b["back"] > 0:
            back, flow = (self._median(i, f, cfg.flow_baseline) for f in ("back", "flow"))
            if _held(back) and _held(flow) and flow >= cfg.min_flow and abs(b["flow"] - flow) / flow * 100 <= cfg.flow_steady_pct:
                drift = (b["back"] - back) / back * 100
                if abs(drift) >= cfg.flow_drift_pct:
                    flags["3"] = b | {"base_back": back, "drift": drift}
        for c in ENVELOPE_LIMITS if b["state"] in MAKING_HOLE else ():
            value, ceiling = b[f"p90_{c}"], b[f"ceiling_{c}"]
            if _held(value) and ceiling and value > ceiling:
                flags[f"4{c}"] = b | {"value": value, "ceiling": ceiling}
        if b["state"] == "TRIPPING_OUT" and _held(b["hookload"]):
            self.peaks, self.trips = [*self.peaks, b["hookload"]][-cfg.overpull_baseline :], self.trips + 1
        for key, run in list(self.runs.items()):
            if key not in flags or run[-1]["tick"] != b["tick"] - 1:
                yield from self._close(key)
        for key, x in flags.items():
            self.runs.setdefault(key, []).append(x)

    def _sticks(self, b: dict) -> bool:
        cfg = self.cfg
        if not all(_held(b[f]) for f in ("rpm", "off_bottom", "wob_sd", "rpm_sd", "torque_median", "torque_valid", "torque_nmad")):
            return False
        steady = b["rpm"] >= cfg.stick_min_rpm and b["off_bottom"] <= cfg.on_bottom_ft and b["wob_sd"] <= cfg.stick_max_wob_sd and b["rpm_sd"] / b["rpm"] <= cfg.stick_max_rpm_cov
        return steady and b["torque_median"] >= cfg.stick_min_torque and b["torque_valid"] >= cfg.stick_min_valid and b["torque_nmad"] >= cfg.stick_watch

    def _close(self, key: str):
        cfg = self.cfg
        run = self.runs.pop(key)
        least = (cfg.stick_min_minutes, cfg.washout_min_minutes, cfg.overpull_min_minutes, cfg.flow_min_minutes, cfg.envelope_min_minutes)[int(key[0])]
        if len(run) >= least:
            self.counts[key] = self.counts.get(key, 0) + 1
            yield key, self.counts[key], run


class Detectors(StatefulProcessor):
    def __init__(self, cfg: DetectorConfig, step: int, silence: int):
        self.cfg, self.step, self.silence = cfg, step, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.feed = handle, handle.getValueState("feed", "said string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        feed = self._feed()
        feed.waiting += [{c: r[c] for c in ("tick", *FIELDS)} for r in rows]
        yield from self._out(key, feed, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._out(key, self._feed(), timerValues, True)

    def close(self) -> None:
        return

    def _feed(self) -> Feed:
        return Feed(self.cfg, self.feed.get()[0] if self.feed.exists() else None)

    def _out(self, key, feed: Feed, timers, timed: bool) -> Iterator[Row]:
        """Advance to the watermark, and set the timer to when the next waiting bucket is final, or else to when the rig has been silent for long."""
        now, bucket = timers.getCurrentWatermarkInMs(), 60_000 * self.step
        last = max((b["tick"] for b in (*feed.waiting, *feed.line)), default=None)
        quiet = None if last is None else (last + 1) * bucket + 1000 * self.silence
        ended = timed and quiet is not None and now >= quiet
        for name, ordinal, run in feed.advance(now // bucket, ended):
            channel = name[1:] or None
            place = list(ENVELOPE_LIMITS).index(channel) if channel else 0
            for b in run:
                found = {"rig_id": key[0], "detector": int(name[0]), "place": place, "channel": channel, "ordinal": ordinal} | b
                yield Row(**{c: found.get(c) for c in _NAMES})
        self.feed.update((feed.said(),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if feed.waiting:
            self.handle.registerTimer(max(now + 1, (min(b["tick"] for b in feed.waiting) + 1) * bucket))
        elif quiet is not None and not ended:
            self.handle.registerTimer(max(now + 1, quiet))


def flagged(minutes: DataFrame, offsets: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1, late: str = "30 minutes", silence: int = SILENCE) -> DataFrame:
    """A stream of closed runs' flagged buckets from a stream of classified buckets (rig_id, tick, BUCKET columns) with hole sizes.

    The session needs the RocksDB state store. Offsets are a static table.
    """
    ceilings = last_envelopes(offsets).select("hole_size", "section", *ENVELOPE_LIMITS.values())
    rows = minutes.withColumn("ts", tick_start("tick", step).cast("timestamp")).withWatermark("ts", late).join(ceilings, "hole_size", "left")
    narrow = rows.select("rig_id", "tick", "ts", *(F.expr(x).alias(c) for c, x in FIELDS.items()))
    return narrow.groupBy("rig_id").transformWithState(Detectors(cfg, step, silence), _OUT, "Append", "eventTime")


def events(closed: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1) -> DataFrame:
    """The events of closed runs, by the batch detectors' own aggregates, with their keys."""
    parts = lambda **c: F.struct(*(F.col(x).alias(n) for n, x in c.items()))
    rows = closed.withColumns({"pressure": F.col("spp"), "RPM": parts(mean="rpm", sd="rpm_sd"), "WOB": parts(mean="wob", sd="wob_sd"), "HKLA": parts(max="hookload")})

    def find(flags, least, aggregates, keys=()):
        return flags.groupBy("rig_id", *keys, "ordinal").agg(F.min("tick").alias("tick_from"), F.max("tick").alias("tick_to"), F.count("*").alias("minutes"), *aggregates)

    made = [f(rows.where(F.col("detector") == k), cfg, step, find) for k, f in enumerate(detect.EVENTS_OF)]
    return detect.in_order(made).withColumn("key", event_key())


def event_key() -> Column:
    """rig, detector (and its channel) and start."""
    return F.concat_ws("/", "rig_id", "type", F.col("evidence")["channel"], F.date_format("t_from", "yyyyMMdd'T'HHmm"))


def write_events(closed: DataFrame, path: str, checkpoint: str, cfg: DetectorConfig = DetectorConfig(), step: int = 1):
    """Append events to a Parquet table as their runs close; a batch that is run again replaces its own files."""

    def put(batch: DataFrame, number: int) -> None:
        events(batch, cfg, step).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
