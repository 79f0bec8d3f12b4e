"""Alert rules: evaluation at every instant of a device, and incidents that open, merge and close.

The machine of a rule is path-dependent, so the evaluations of a rule and device go to one task in time order; they
stream through it and only the machine's state is kept. Rules without duration, cooldown and merging need no machine:
threshold_incidents finds their incidents with window functions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.config import Rule
from gaugeworks.functions import expression as E
from gaugeworks.functions.text import has_tags
from gaugeworks.operators.current import history, instants
from gaugeworks.operators.dims import small

NORMAL, PENDING, FIRING, RECOVERING, COOLDOWN = "NORMAL", "PENDING", "FIRING", "RECOVERING", "COOLDOWN"
HISTORY = "array<struct<at_us:long,from_state:string,to_state:string,reason:string>>"
OUTPUT = (
    "kind string, rule_id string, rule_version int, device_id string, incident_uuid string, severity string, state string, started_us long, ended_us long, close_reason string, "
    f"last_hit_us long, hit_count long, reopen_count long, peak_value double, history {HISTORY}, since_us long, last_eval_us long, last_closed_us long"
)


@dataclass(frozen=True)
class CompiledRule:
    rule: Rule
    trigger: E.Node
    recovery: E.Node | None
    metrics: tuple[str, ...]


def compile_rule(rule: Rule, known: list[str]) -> CompiledRule:
    """ExpressionError for syntax, unknown metrics or a trigger that isn't a condition."""
    trigger, recovery = E.parse(rule.trigger), E.parse(rule.recovery) if rule.recovery else None
    metrics = list(dict.fromkeys([*E.metric_refs(trigger), *(E.metric_refs(recovery) if recovery else [])]))
    if missing := [m for m in metrics if m not in known]:
        raise E.ExpressionError(f"rule {rule.id}: unknown metric {missing[0]}")
    for tree in filter(None, (trigger, recovery)):
        if E.Compiler(lambda m: F.lit(0.0), history).compile(tree).kind != E.BOOLEAN:
            raise E.ExpressionError(f"rule {rule.id}: not a condition")
    return CompiledRule(rule, trigger, recovery, tuple(metrics))


def evaluations(samples: DataFrame, rules: list[CompiledRule], devices: DataFrame | None = None) -> DataFrame:
    """rule_id, device_id, event_time_us, has_data, condition, recovered, peak, for every rule and instant of its metrics.

    Samples with an evaluation error are left out. devices: device_id and tags, for rules with device_tags."""
    metrics = list(dict.fromkeys(m for r in rules for m in r.metrics))
    w = Window.partitionBy("device_id").orderBy("event_time_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = instants(samples, metrics)
    if devices is not None:
        rows = rows.join(small(devices.select("device_id", F.col("tags").alias("__tags"))), "device_id", "left")
    value = lambda m: F.last(F.col(f"`{m}`"), ignorenulls=True).over(w)
    compiler = E.Compiler(value, history, lenient=True)
    each = []
    for r in rules:
        trigger = compiler.compile(r.trigger)
        recovery = compiler.compile(r.recovery) if r.recovery else E.Compiled(~trigger.value, E.none(), E.BOOLEAN)
        error = F.coalesce(trigger.error, F.when(trigger.value.isNotNull(), recovery.error))
        here = F.lit(False)
        for m in r.metrics:
            here |= F.col(f"`{m}`").isNotNull()
        peak = F.coalesce(F.greatest(*(value(m) for m in r.metrics), F.lit(None).cast("double")), F.lit(0.0)) if r.metrics else F.lit(0.0)
        fits = has_tags(F.col("__tags"), r.rule.device_tags) if r.rule.device_tags and devices is not None else F.lit(not r.rule.device_tags)
        each.append(
            F.when(
                error.isNull() & here & fits,
                F.struct(F.lit(r.rule.id).alias("rule_id"), trigger.value.isNotNull().alias("has_data"), F.coalesce(trigger.value, F.lit(False)).alias("condition"), (trigger.value.isNotNull() & F.coalesce(recovery.value, F.lit(False))).alias("recovered"), peak.alias("peak")),
            )
        )
    found = rows.select("device_id", "event_time_us", F.array(*each).alias("each"))
    found = found.select("device_id", "event_time_us", F.explode(F.array_compact("each")).alias("e"))
    return found.select("e.rule_id", "device_id", "event_time_us", "e.has_data", "e.condition", "e.recovered", "e.peak")


@dataclass
class Incident:
    uuid: str
    started_us: int
    peak: float
    hits: int = 1
    reopened: int = 0
    last_hit_us: int | None = None
    ended_us: int | None = None
    reason: str | None = None
    history: list[tuple[int, str, str, str]] = field(default_factory=list)


@dataclass
class Machine:
    """One rule on one device, fed in time order."""

    rule: Rule
    device: str
    state: str = NORMAL
    since_us: int = 0
    last_us: int | None = None
    open: Incident | None = None
    last: Incident | None = None  # closed, and may be reopened
    done: list[Incident] = field(default_factory=list)

    def turn(self, state: str, t: int) -> None:
        self.state, self.since_us = state, t

    def feed(self, t: int, has_data: bool, condition: bool, recovered: bool, peak: float) -> None:
        self.last_us = t
        rule = self.rule
        if self.state == COOLDOWN:
            if t - self.since_us < rule.cooldown_us:
                return
            self.turn(NORMAL, t)
        if not has_data:
            return
        if self.state in (NORMAL, PENDING):
            if not condition:
                if self.state == PENDING:
                    self.turn(NORMAL, t)
            elif self.state == NORMAL and rule.duration_us > 0:
                self.turn(PENDING, t)
            elif self.state == NORMAL or t - self.since_us >= rule.duration_us:
                self.fire(t, peak)
            return
        if self.state == FIRING and condition:
            self.open.hits += 1
            self.open.last_hit_us = t
            self.open.peak = max(self.open.peak, peak)
        if not recovered:
            if self.state == RECOVERING:
                self.turn(FIRING, t)
        elif self.state == FIRING and rule.duration_us > 0:
            self.turn(RECOVERING, t)
        elif self.state == FIRING or t - self.since_us >= rule.duration_us:
            self.close(t, "RECOVERED")

    def fire(self, t: int, peak: float) -> None:
        last = self.last
        if last is not None and self.rule.merge_interval_us > 0 and t - last.ended_us <= self.rule.merge_interval_us:
            last.history.append((t, "closed", "open", "REOPENED"))
            last.ended_us = last.reason = None
            last.last_hit_us, last.peak, last.reopened = t, max(last.peak, peak), last.reopened + 1
            self.open, self.last = last, None
        else:
            if last is not None:
                self.done.append(last)
                self.last = None
            key = f"{self.rule.id}\x1f{self.rule.version}\x1f{self.device}\x1f{t}"
            self.open = Incident(hashlib.sha256(key.encode()).hexdigest()[:32], t, peak)
        self.turn(FIRING, t)

    def close(self, t: int, reason: str) -> None:
        self.open.history.append((t, "open", "closed", reason))
        self.open.ended_us, self.open.reason = t, reason
        if self.last is not None:
            self.done.append(self.last)
        self.last, self.open = self.open, None
        self.turn(COOLDOWN if self.rule.cooldown_us > 0 else NORMAL, t)

    def rows(self, end: bool) -> Iterator[tuple]:
        """Finished incidents; at the end also those that may change, and the state."""
        for x in [*self.done, *([i for i in (self.last, self.open) if i] if end else [])]:
            yield ("incident", self.rule.id, self.rule.version, self.device, x.uuid, self.rule.severity, "open" if x.ended_us is None else "closed", x.started_us, x.ended_us, x.reason, x.last_hit_us, x.hits, x.reopened, x.peak, x.history, None, None, None)
        self.done = []
        if end:
            yield ("state", self.rule.id, self.rule.version, self.device, self.open.uuid if self.open else None, None, self.state, None, None, None, None, None, None, None, [], self.since_us, self.last_us, self.last.ended_us if self.last else None)


def restored(rule: Rule, device: str, row: dict, incidents: dict[str, dict]) -> Machine:
    """A machine as stored rows of OUTPUT left it: a state row, and the rows of its incidents by uuid."""
    machine = Machine(rule, device, row["state"], int(row["since_us"]), row["last_eval_us"])

    def incident(x: dict) -> Incident:
        whole = lambda v: None if v is None or pd.isna(v) else int(v)
        return Incident(x["incident_uuid"], int(x["started_us"]), float(x["peak_value"]), int(x["hit_count"]), int(x["reopen_count"]), whole(x["last_hit_us"]), whole(x["ended_us"]), x["close_reason"], [tuple(h.values()) if isinstance(h, dict) else tuple(h) for h in x["history"]])

    for x in incidents.values():
        if x["state"] == "open":
            machine.open = incident(x)
        elif machine.last is None or x["ended_us"] > machine.last.ended_us:
            machine.last = incident(x)
    return machine


def run_rules(found: DataFrame, rules: list[Rule], before: DataFrame | None = None) -> DataFrame:
    """OUTPUT: an `incident` row for each incident and a `state` row for each rule and device. found: evaluations().

    before: OUTPUT rows of an earlier run, each incident and state once. Its machines go on: evaluations up to their last
    one don't count again, and the rows are those of incidents and states that this run knows of; a row of the same
    incident or state replaces the earlier one."""
    by = {r.id: r for r in rules}
    names = [x.split()[0] for x in OUTPUT.replace(HISTORY, "h").split(", ")]
    found = found.select("rule_id", "device_id", "event_time_us", "has_data", "condition", "recovered", "peak", F.lit(None).cast("string").alias("resumed"))
    if before is not None:
        found = found.unionByName(_resumed(before.filter(F.col("rule_id").isin([r.id for r in rules]))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine: Machine | None = None
        out: list[tuple] = []
        for frame in frames:
            columns = (frame[c].tolist() for c in ("rule_id", "device_id", "resumed", "event_time_us", "has_data", "condition", "recovered", "peak"))
            for rule, device, resumed, *sample in zip(*columns, strict=True):
                if machine is None or (machine.rule.id, machine.device) != (rule, device):
                    if machine:
                        out += machine.rows(True)
                    machine = Machine(by[rule], device)
                if resumed:
                    was = json.loads(resumed)
                    machine = restored(by[rule], device, was["state"], {x["incident_uuid"]: x for x in was["incidents"]})
                elif machine.last_us is None or sample[0] > machine.last_us:
                    machine.feed(*sample)
            if machine:
                out += machine.rows(False)
            if out:
                yield _frame(out, names)
                out = []
        if machine:
            yield _frame(list(machine.rows(True)), names)

    key = ["rule_id", "device_id"]
    return found.repartition(*key).sortWithinPartitions(*key, "event_time_us").mapInPandas(run, OUTPUT)


def _resumed(before: DataFrame) -> DataFrame:
    """One row for each rule and device, before all evaluations: its state, its open incident and the one closed last."""
    key = ["rule_id", "device_id"]
    whole = F.struct("incident_uuid", "state", "started_us", "ended_us", "close_reason", "last_hit_us", "hit_count", "reopen_count", "peak_value", "history")
    incident = F.col("kind") == "incident"
    rows = before.groupBy(*key).agg(
        F.max_by(F.struct("state", "since_us", "last_eval_us"), F.when(F.col("kind") == "state", F.lit(1))).alias("state"), F.max_by(whole, F.when(incident & (F.col("state") == "open"), F.col("started_us"))).alias("open"),
        F.max_by(whole, F.when(incident & (F.col("state") == "closed"), F.col("ended_us"))).alias("last"),
    )
    told = F.to_json(F.struct("state", F.array_compact(F.array("open", "last")).alias("incidents")), {"ignoreNullFields": "false"})
    none = F.lit(False)
    return rows.filter("state is not null").select(*key, F.lit(-(1 << 63)).cast("bigint").alias("event_time_us"), none.alias("has_data"), none.alias("condition"), none.alias("recovered"), F.lit(0.0).alias("peak"), told.alias("resumed"))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for c in ("started_us", "ended_us", "last_hit_us", "hit_count", "reopen_count", "since_us", "last_eval_us", "last_closed_us"):
        frame[c] = frame[c].astype("Int64")
    frame["history"] = [[dict(zip(("at_us", "from_state", "to_state", "reason"), h, strict=True)) for h in x] for x in frame["history"]]
    return frame


def incidents(output: DataFrame) -> DataFrame:
    return output.filter("kind = 'incident'").select("incident_uuid", "rule_id", "rule_version", "device_id", "severity", "state", "started_us", "ended_us", "close_reason", "last_hit_us", "hit_count", "reopen_count", "peak_value")


def incident_history(output: DataFrame) -> DataFrame:
    rows = output.filter("kind = 'incident'").select("incident_uuid", F.explode("history").alias("h"))
    return rows.select("incident_uuid", "h.*")


def threshold_incidents(found: DataFrame) -> DataFrame:
    """Incidents of rules without duration, cooldown and merging, by gaps and islands. found: evaluations().

    A row that meets trigger and recovery at once opens nothing here; run_rules handles such rules."""
    w = Window.partitionBy("rule_id", "device_id").orderBy("event_time_us")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("has_data") & F.col("condition"), 1).when(F.col("has_data") & F.col("recovered"), 0)
    rows = found.withColumn("on", F.coalesce(F.last(mark, ignorenulls=True).over(so_far), F.lit(0)))
    opens = (F.col("on") == 1) & (F.coalesce(F.lag("on").over(w), F.lit(0)) == 0)
    rows = rows.withColumn("island", F.sum(opens.cast("int")).over(so_far)).filter("island > 0")
    closing = F.min(F.when(F.col("on") == 0, F.col("event_time_us")))
    hit: Column = (F.col("on") == 1) & F.col("condition") & F.col("has_data")
    out = rows.groupBy("rule_id", "device_id", "island").agg(F.min("event_time_us").alias("started_us"), closing.alias("ended_us"), F.count_if(hit).alias("hit_count"), F.max(F.when(hit, F.col("event_time_us"))).alias("last"), F.max(F.when(hit, F.col("peak"))).alias("peak_value"))
    return out.select("rule_id", "device_id", "started_us", "ended_us", "hit_count", F.when(F.col("hit_count") > 1, F.col("last")).alias("last_hit_us"), "peak_value")


def close_removed(stored: DataFrame, rule_ids: list[str], now_us: int) -> DataFrame:
    """Stored incidents, the open ones of rules that are gone closed as RULE_REMOVED."""
    gone = (F.col("state") == "open") & ~F.col("rule_id").isin(rule_ids)
    return stored.withColumns({"ended_us": F.when(gone, F.lit(now_us)).otherwise(F.col("ended_us")), "close_reason": F.when(gone, "RULE_REMOVED").otherwise(F.col("close_reason")), "state": F.when(gone, "closed").otherwise(F.col("state"))})


def absences(samples: DataFrame, duration_us: int, now_us: int) -> DataFrame:
    """device_id, started_us, ended_us (null while it lasts): spans without any sample longer than the duration."""
    w = Window.partitionBy("device_id").orderBy("event_time_us")
    rows = samples.select("device_id", "event_time_us").distinct().withColumn("next", F.lead("event_time_us").over(w))
    long = F.coalesce("next", F.lit(now_us)) - F.col("event_time_us") > duration_us
    return rows.filter(long).select("device_id", (F.col("event_time_us") + duration_us).alias("started_us"), F.col("next").alias("ended_us"))
