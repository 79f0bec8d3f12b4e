"""Settings: metrics, devices, calibrations, rules; read from a dict, JSON or YAML, checked as a whole."""

from __future__ import annotations

import json
import zoneinfo
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.functions import expression
from gaugeworks.functions.durations import parse_duration
from gaugeworks.functions.units import dimension

INTERPOLATIONS = ("none", "linear", "previous")
POLICIES = ("null", "recent", "skip")
RULE_TYPES = ("threshold", "duration", "rate", "absence", "composite")
SEVERITIES = ("info", "warning", "critical")


class ConfigError(ValueError):
    """Every fault of the settings, joined."""


@dataclass(frozen=True)
class Metric:
    id: str
    canonical_unit: str
    input_units: tuple[str, ...]
    valid_min: float | None = None
    valid_max: float | None = None
    expected_period_us: int | None = None
    jitter_us: int = 0
    max_gap_us: int | None = None
    interpolation: str = "none"


@dataclass(frozen=True)
class Device:
    id: str
    timezone: str = "UTC"
    metrics: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Segment:
    device: str
    metric: str
    min: float
    max: float
    slope: float
    intercept: float
    reject_unmatched: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    trigger: str
    recovery: str | None = None
    type: str = "threshold"
    severity: str = "warning"
    duration_us: int = 0
    cooldown_us: int = 0
    merge_interval_us: int = 0
    device_tags: dict[str, str] = field(default_factory=dict)
    version: int = 1


@dataclass(frozen=True)
class DerivedMetric:
    id: str
    expression: str
    missing_policy: str = "null"
    max_input_age_us: int = 0


@dataclass(frozen=True)
class Settings:
    metrics: tuple[Metric, ...] = ()
    devices: tuple[Device, ...] = ()
    calibrations: tuple[Segment, ...] = ()
    rules: tuple[Rule, ...] = ()
    derived: tuple[DerivedMetric, ...] = ()
    windows: tuple[int, ...] = (60, 300, 3600)
    allowed_lateness_us: int = 300_000_000
    history_range_us: int = 7 * 86_400_000_000
    max_error_rate: float = 0.1
    error_rate_min_records: int = 100
    batch_size: int = 1000
    ambiguous_earlier: bool = True
    late_correction: bool = True
    retention_days: dict[str, int] = field(default_factory=dict)
    unknown_keys: tuple[str, ...] = ()

    def version(self) -> int:
        """FNV-1a of the settings' canonical JSON, wrapped to a signed long."""
        h = 0xCBF29CE484222325
        for b in json.dumps(asdict(self), sort_keys=True).encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h


def _known(found: dict, known: str, where: str, unknown: list[str]) -> dict:
    unknown += [f"{where}.{k}" for k in found if k not in known.split()]
    return found


def from_dict(raw: dict[str, Any]) -> Settings:
    """Settings; ConfigError with every fault found."""
    faults: list[str] = []
    unknown: list[str] = []

    def duration(value: Any, where: str, default: int | None = None) -> int | None:
        if value is None:
            return default
        try:
            return parse_duration(value, bare_seconds=True)
        except ValueError as e:
            faults.append(f"{where}: {e}")
            return default

    if raw.get("schema_version") != 1:
        faults.append("schema_version must be 1")
    _known(raw, "schema_version server directories database pipeline windows log metrics devices calibrations derived_metrics rules retention", "", unknown)
    p = _known(raw.get("pipeline") or {}, "workers queue_capacity batch_size allowed_lateness scan_interval quiet_period max_error_rate error_rate_min_records shutdown_timeout history_range ambiguous_time_policy late_correction", "pipeline", unknown)
    batch, rate = p.get("batch_size", 1000), p.get("max_error_rate", 0.1)
    if not isinstance(batch, int) or not 1 <= batch <= 100_000:
        faults.append("pipeline.batch_size must be 1..100000")
    if not 0 <= float(rate) <= 1:
        faults.append("pipeline.max_error_rate must be 0..1")
    if p.get("ambiguous_time_policy", "earlier") not in ("earlier", "later"):
        faults.append("pipeline.ambiguous_time_policy must be earlier or later")
    sizes = tuple(raw.get("windows", (60, 300, 3600)))
    if any(not isinstance(w, int) or not 1 <= w <= 86_400 for w in sizes) or len(set(sizes)) != len(sizes):
        faults.append("windows must be distinct sizes of 1..86400 s")
    metrics = []
    for m in raw.get("metrics") or []:
        where = f"metric {m.get('id')}"
        _known(m, "id canonical_unit input_units valid_min valid_max expected_period jitter max_gap interpolation", where, unknown)
        units = tuple(m.get("input_units") or ())
        dims = {dimension(u) for u in (m.get("canonical_unit"), *units)}
        if None in dims:
            faults.append(f"{where}: unknown unit")
        elif len(dims) > 1:
            faults.append(f"{where}: units of different dimensions")
        low, high, how = m.get("valid_min"), m.get("valid_max"), m.get("interpolation", "none")
        if low is not None and high is not None and low >= high:
            faults.append(f"{where}: valid_min must be below valid_max")
        if how not in INTERPOLATIONS:
            faults.append(f"{where}: unknown interpolation {how}")
        elif how != "none" and m.get("expected_period") is None:
            faults.append(f"{where}: interpolation needs expected_period")
        metrics.append(Metric(m.get("id"), m.get("canonical_unit"), units, low, high, duration(m.get("expected_period"), where), duration(m.get("jitter"), where, 0), duration(m.get("max_gap"), where), how))
    ids = [m.id for m in metrics]
    devices = []
    for d in raw.get("devices") or []:
        where = f"device {d.get('id')}"
        _known(d, "id timezone metrics tags", where, unknown)
        try:
            zoneinfo.ZoneInfo(d.get("timezone", "UTC"))
        except (zoneinfo.ZoneInfoNotFoundError, ValueError):
            faults.append(f"{where}: unknown time zone {d.get('timezone')}")
        faults += [f"{where}: unknown metric {m}" for m in d.get("metrics") or () if m not in ids]
        devices.append(Device(d.get("id"), d.get("timezone", "UTC"), tuple(d.get("metrics") or ()), dict(d.get("tags") or {})))
    segments = []
    for c in raw.get("calibrations") or []:
        where = f"calibration {c.get('device')}/{c.get('metric')}"
        if c.get("device") not in [d.id for d in devices] or c.get("metric") not in ids:
            faults.append(f"{where}: unknown device or metric")
        mine = sorted((Segment(c.get("device"), c.get("metric"), float(s["min"]), float(s["max"]), float(s["slope"]), float(s["intercept"]), bool(c.get("reject_unmatched", False))) for s in c.get("segments") or ()), key=lambda s: s.min)
        faults += [f"{where}: segment min must be below max" for s in mine if s.min >= s.max]
        faults += [f"{where}: segments overlap" for a, b in zip(mine, mine[1:], strict=False) if b.min < a.max]
        segments += mine
    derived = [DerivedMetric(x.get("id"), x.get("expression", ""), x.get("missing_policy", "null"), duration(x.get("max_input_age"), f"derived metric {x.get('id')}", 0)) for x in raw.get("derived_metrics") or []]
    for x in derived:
        if x.id in ids:
            faults.append(f"derived metric {x.id}: the id is a metric's")
        if x.missing_policy not in POLICIES:
            faults.append(f"derived metric {x.id}: unknown missing_policy")
        faults += _expression_faults(f"derived metric {x.id}", x.expression, ids)
    rules = []
    for r in raw.get("rules") or []:
        where = f"rule {r.get('id')}"
        _known(r, "id type severity trigger recovery duration cooldown merge_interval device_tags", where, unknown)
        if r.get("type", "threshold") not in RULE_TYPES:
            faults.append(f"{where}: unknown type {r.get('type')}")
        if r.get("severity", "warning") not in SEVERITIES:
            faults.append(f"{where}: unknown severity {r.get('severity')}")
        for text in filter(None, (r.get("trigger") or "?", r.get("recovery"))):
            faults += _expression_faults(where, text, [*ids, *(x.id for x in derived)])
        rules.append(Rule(r.get("id"), r.get("trigger", ""), r.get("recovery"), r.get("type", "threshold"), r.get("severity", "warning"), *(duration(r.get(k), where, 0) for k in ("duration", "cooldown", "merge_interval")), dict(r.get("device_tags") or {})))
    for what, found in (("metric", ids), ("device", [d.id for d in devices]), ("rule", [r.id for r in rules]), ("derived metric", [x.id for x in derived])):
        faults += [f"duplicate {what} id {x}" for x in sorted({str(x) for x in found if found.count(x) > 1})]
        faults += [f"{what} without an id"] * any(not x for x in found)
    if faults:
        raise ConfigError("; ".join(faults))
    return Settings(
        tuple(metrics), tuple(devices), tuple(segments), tuple(rules), tuple(derived), sizes,
        duration(p.get("allowed_lateness"), "pipeline", 300_000_000), duration(p.get("history_range"), "pipeline", 7 * 86_400_000_000),
        float(rate), int(p.get("error_rate_min_records", 100)), batch, p.get("ambiguous_time_policy", "earlier") == "earlier", bool(p.get("late_correction", True)),
        {k.removesuffix("_days"): int(v) for k, v in (raw.get("retention") or {}).items()}, tuple(unknown),
    )


def _expression_faults(where: str, text: str, known: list[str]) -> list[str]:
    try:
        return [f"{where}: unknown metric {x}" for x in expression.metric_refs(expression.parse(text)) if x not in known]
    except expression.ExpressionError as e:
        return [f"{where}: {e}"]


def load(path: str) -> Settings:
    """From a JSON or YAML file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_dict(json.loads(text))
    import yaml

    return from_dict(yaml.safe_load(text))


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation, whose size the plan knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    fields = to_arrow_schema(wanted)
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    arrays = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in column], field.type) for column, field in zip(columns, fields, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields), wanted)


def dimensions(spark: SparkSession, settings: Settings) -> dict[str, DataFrame]:
    """The settings as small tables: metrics, metric_units, devices, device_metrics, calibrations."""
    pairs = [(d.id, m) for d in settings.devices for m in d.metrics or [x.id for x in settings.metrics]]
    table = lambda rows, schema: local_table(spark, rows, schema)
    return {
        "metrics": table([(m.id, m.canonical_unit, m.valid_min, m.valid_max, m.expected_period_us, m.jitter_us, m.max_gap_us, m.interpolation) for m in settings.metrics], "metric_id string, canonical_unit string, valid_min double, valid_max double, expected_period_us long, jitter_us long, max_gap_us long, interpolation string"),
        "metric_units": table([(m.id, u) for m in settings.metrics for u in m.input_units], "metric_id string, unit string"),
        "devices": table([(d.id, d.timezone, d.tags) for d in settings.devices], "device_id string, timezone string, tags map<string,string>"),
        "device_metrics": table(pairs, "device_id string, metric_id string"),
        "calibrations": table([(s.device, s.metric, s.min, s.max, s.slope, s.intercept, s.reject_unmatched) for s in settings.calibrations], "device_id string, metric_id string, seg_min double, seg_max double, slope double, intercept double, reject_unmatched boolean"),
    }
