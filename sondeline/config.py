"""Names, thresholds and small tables of the telemetry domain, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

# The feed's channel codes, in the order of its columns.
CHANNELS = ("DBTM", "DMEA", "BPOS", "ROP", "HKLA", "WOB", "TORQUE", "RPM", "SPP", "MFOP", "MFIA")

STATES = ("DRILLING", "SLIDING", "REAMING", "CIRCULATING", "TRIPPING_IN", "TRIPPING_OUT", "CONNECTION", "STATIC", "NO_DATA")
MAKING_HOLE = ("DRILLING", "SLIDING")
PUMPS_ON = ("DRILLING", "SLIDING", "CIRCULATING")
SEVERITY_RANK = {"WATCH": 0, "WARN": 1, "ALARM": 2}
FINDING_RANK = {"info": 0, "warn": 1, "critical": 2}

# The detected states that a reported activity code agrees with.
ACTIVITY_STATES = {
    "DRLROT": ("DRILLING",),
    "DRLDD": ("DRILLING", "SLIDING"),
    "DRLRS": ("DRILLING", "SLIDING"),
    "DRLSLD": ("SLIDING",),
    "DRLCMT": ("DRILLING", "SLIDING"),
    "TIH": ("TRIPPING_IN",),
    "TOH": ("TRIPPING_OUT",),
    "CSGPULL": ("TRIPPING_OUT",),
    "CC": ("CIRCULATING",),
    "CLNOUT": ("CIRCULATING", "REAMING"),
    "EQRPR": ("STATIC",),
    "OPSUS": ("STATIC",),
    "WOC": ("STATIC",),
    "BHAPU": ("STATIC",),
    "BHAPU/LD": ("STATIC",),
    "TSTSURFEQ": ("STATIC", "CIRCULATING"),
    "DPP/U": ("STATIC",),
    "FIT": ("STATIC", "CIRCULATING"),
}

# Which ceiling of the reference well each channel is held against.
ENVELOPE_LIMITS = {"SPP": "max_spp", "MFIA": "max_flow_rate", "TORQUE": "max_torque", "WOB": "max_wob"}


@dataclass(frozen=True)
class StateThresholds:
    """Defaults of the state machine; lengths in ft, windows in rows to either side."""

    making_hole_ft: float = 1.0
    hole_rows: int = 3
    on_bottom_ft: float = 3.0
    tripping_ft: float = 30.0
    trip_rows: int = 7
    rotating_rpm: float = 20.0
    pumping_gpm: float = 200.0
    connection_bpos_ft: float = 10.0
    connection_off_bottom_ft: float = 120.0
    reaming_ft: float = 0.5
    vote_rows: int = 3
    min_run: int = 3


@dataclass(frozen=True)
class DetectorConfig:
    """Default thresholds of the five detectors."""

    on_bottom_ft: float = 3.0
    stick_watch: float = 0.95
    stick_warn: float = 1.1
    stick_alarm: float = 1.21
    stick_min_rpm: float = 40.0
    stick_max_wob_sd: float = 3.0
    stick_max_rpm_cov: float = 0.15
    stick_min_torque: float = 300.0
    stick_min_valid: int = 10
    stick_min_minutes: int = 3
    washout_drop_pct: float = 8.0
    washout_warn_pct: float = 13.0
    washout_alarm_pct: float = 20.0
    washout_flow_pct: float = 3.0
    washout_min_minutes: int = 5
    washout_min_spp: float = 400.0
    washout_baseline: int = 20
    min_flow: float = 300.0
    overpull_klb: float = 10.0
    overpull_warn_klb: float = 15.0
    overpull_alarm_klb: float = 25.0
    overpull_baseline: int = 30
    overpull_least: int = 10
    overpull_quantile: float = 0.75
    overpull_min_base: float = 50.0
    overpull_context: int = 10
    overpull_min_minutes: int = 1
    flow_drift_pct: float = 25.0
    flow_warn_pct: float = 50.0
    flow_steady_pct: float = 5.0
    flow_baseline: int = 30
    flow_min_minutes: int = 10
    envelope_min_minutes: int = 5
    envelope_warn_pct: float = 25.0


@dataclass(frozen=True)
class Retrieval:
    """BM25 parameters. k1, b, the common-term limit, the boost, `problem`, stop words, synonyms and wells."""

    k1: float = 0.8
    b: float = 0.85
    common: float = 0.35
    wells: tuple[str, ...] = ("SEBL_001", "SEBL_002")
    problem_boost: float = 1.6
    stop: frozenset[str] = frozenset(
        "the and for with that this from was were are have has had not but all any can will his her its "
        "out off per via due you our their what when which how why did does into onto over under after before "
        "during while then than there here been being also "
        "of on to in at is it as by or we do up no if so an be he my me us am "
        "summarize summarise tell show find give about shift happened caused cause some more most went wrong "
        "get got put made make they them".split()
    )
    synonyms: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "stuck": ("drag", "overpull", "tight", "stuck", "backream", "packoff", "bridge"),
            "stuck pipe": ("drag", "overpull", "tight", "stuck", "backream", "packoff"),
            "npt": ("eqrpr", "opsus", "repair", "suspended", "waiting", "breakdown", "trouble"),
            "downtime": ("eqrpr", "opsus", "repair", "suspended", "waiting"),
            "torque": ("torque", "tq", "stall", "rotate", "rotary"),
            "stick slip": ("torque", "stall", "vibration", "oscillat"),
            "washout": ("washout", "leak", "pressure", "spp", "drop"),
            "pump": ("pump", "mp", "liner", "stroke", "spm", "seat", "valve"),
            "mud": ("mud", "mw", "ppg", "ecd", "viscosity", "lcm", "sweep"),
            "losses": ("loss", "losses", "lcm", "seepage", "lost"),
            "kick": ("kick", "influx", "gain", "shut", "flow", "check"),
            "bit": ("bit", "pdc", "tfa", "nozzle", "dull"),
            "bha": ("bha", "motor", "agitator", "stabilizer", "mwd", "steerable"),
            "casing": ("casing", "csg", "shoe", "cement", "cmt", "liner"),
            "trip": ("tih", "toh", "pooh", "trip", "run"),
            "survey": ("survey", "inc", "azi", "mwd", "directional"),
            "cement": ("cement", "cmt", "woc", "slurry", "toc"),
            "weather": ("rain", "weather", "lightning", "storm", "swa"),
            "safety": ("swa", "pjsm", "hse", "drill", "jsa", "toolbox"),
            "night": ("midnight", "night"),
            "bop": ("bop", "boptst", "accumulator", "choke", "annular", "ram"),
        }
    )
    problem: str = "npt|problem|issue|delay|lost|fail|wrong|broke|repair|damage|trouble|stuck|downtime|suspend"
