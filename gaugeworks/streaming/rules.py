"""Rules on a stream: the machine of each rule and device lives in the state store, as typed columns.

A stream may begin from what imports have stored: their last states and incidents are its initial state, so that an incident opened there
goes on here, and is merged or closed as if all rows had come at once. A rule that is gone closes its incident as RULE_REMOVED: when
a row of it comes, or a row of its device with a null time, which says that the rule has been removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.config import Rule
from gaugeworks.operators.rules import FIRING, HISTORY, OUTPUT, RECOVERING, Incident, Machine, _resumed, restored
from gaugeworks.shipping import ship
from gaugeworks.streaming.devices import PROVIDER

NAMES = [x.split()[0] for x in OUTPUT.replace(HISTORY, "h").split(", ")]
_STEP = "struct<at_us:bigint,from_state:string,to_state:string,reason:string>"
_INCIDENT = f"struct<uuid:string,started_us:bigint,peak:double,hits:bigint,reopened:bigint,last_hit_us:bigint,ended_us:bigint,reason:string,history:array<{_STEP}>>"
STATE = f"state string, since_us bigint, last_us bigint, open {_INCIDENT}, last {_INCIDENT}"
REMOVED = "RULE_REMOVED"


def _kept(x: Incident | None) -> tuple | None:
    return None if x is None else (x.uuid, x.started_us, x.peak, x.hits, x.reopened, x.last_hit_us, x.ended_us, x.reason, [tuple(h) for h in x.history])


def _incident(x: Row | None) -> Incident | None:
    return None if x is None else Incident(x[0], x[1], x[2], x[3], x[4], x[5], x[6], x[7], [tuple(h) for h in x[8]])


class RuleMachine(StatefulProcessor):
    """One rule on one device."""

    def __init__(self, rules: dict[str, Rule]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState("machine", STATE)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState, timerValues) -> None:
        was = json.loads(initialState["resumed"])
        rule = self.rules.get(key[0]) or Rule(key[0], "", "")
        self._keep(restored(rule, key[1], was["state"], {x["incident_uuid"]: x for x in was["incidents"]}))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rule = self.rules.get(key[0])
        machine = Machine(rule or Rule(key[0], "", ""), key[1])
        if self.machine.exists():
            state, since, last_us, open_, last = self.machine.get()
            machine = Machine(machine.rule, key[1], state, since, last_us, _incident(open_), _incident(last))
        arrived = sorted((r for r in rows), key=lambda r: (r["event_time_us"] is None, r["event_time_us"] or 0))
        ends = bool(arrived) and arrived[-1]["event_time_us"] is None
        for r in arrived if rule else []:
            if r["event_time_us"] is not None and (machine.last_us is None or r["event_time_us"] > machine.last_us):
                machine.feed(int(r["event_time_us"]), bool(r["has_data"]), bool(r["condition"]), bool(r["recovered"]), float(r["peak"]))
        if ends or rule is None:
            if machine.open and machine.state in (FIRING, RECOVERING):
                machine.close(machine.last_us if machine.last_us is not None else machine.open.started_us, REMOVED)
            self.machine.clear()
        else:
            self._keep(machine)
        for row in machine.rows(True):
            values = dict(zip(NAMES, row, strict=True))
            values["history"] = [dict(zip(("at_us", "from_state", "to_state", "reason"), h, strict=True)) for h in values["history"]]
            yield Row(**values)

    def _keep(self, machine: Machine) -> None:
        self.machine.update((machine.state, machine.since_us, machine.last_us, _kept(machine.open), _kept(machine.last)))


def run_rules_stream(found: DataFrame, rules: list[Rule], before: DataFrame | None = None) -> DataFrame:
    """Each micro-batch gives, for the rules and devices that it touches, the rows that run_rules would give by then.

    found: a stream of evaluations. Rows of a batch are taken in time order; rows no newer than the state's last are late and
    don't count. The latest row of an incident or state is the valid one. before: OUTPUT rows of imports, from which a new query begins."""
    spark = found.sparkSession
    ship(spark)
    spark.conf.set(*PROVIDER)
    start = None if before is None else _resumed(before).select("rule_id", "device_id", "resumed").groupBy("rule_id", "device_id")
    return found.groupBy("rule_id", "device_id").transformWithState(RuleMachine({r.id: r for r in rules}), OUTPUT, "Append", "None", start)
