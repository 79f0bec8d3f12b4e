"""The command line over a small store."""

import json

import pytest

from gaugeworks.__main__ import main

CONFIG = {
    "schema_version": 1, "windows": [60], "pipeline": {"history_range": "365d"}, "metrics": [{"id": "temp", "canonical_unit": "C", "input_units": ["C", "K"]}],
    "devices": [{"id": "dev-01", "tags": {"line": "A"}}, {"id": "dev-02", "tags": {"line": "B"}}], "rules": [{"id": "hot", "trigger": "temp > 80", "severity": "critical"}],
}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    lines = ["device_id,metric,event_time,value,unit"] + [f"dev-01,temp,{1788221800000 + 1000 * i},{v},C" for i, v in enumerate((70, 85, 90, 60, 99))]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")

    def run(*args):
        capsys.readouterr()
        assert main(["--config", str(tmp_path / "c.json"), "--store", str(tmp_path / "store"), *args]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert run("import", str(tmp_path / "in.csv"), "--now", "2026-09-01T00:30:00Z") == [{"path": str(tmp_path / "in.csv"), "status": "COMPLETED"}]
    assert run("status") == [{"status": "COMPLETED", "files": 1}, {"status": "SAMPLES", "files": 5}]
    assert [r["value"] for r in run("samples", "--device", "dev-01", "--metric", "temp", "--from", "1788221801000", "--to", "1788221804000")] == [85, 90, 60]
    assert [r["device_id"] for r in run("devices", "--tag", "line=B")] == ["dev-02"]
    assert [(r["state"], r["hit_count"]) for r in run("incidents")] == [("open", 1), ("closed", 2)] and len(run("incidents", "--state", "open")) == 1
    assert [r["reason"] for r in run("history")] == ["RECOVERED"] and run("check") == [] and run("audit")[0]["operation"] == "import"
    assert run("files", "--path", str(tmp_path / "in.csv"))[0]["status"] == "COMPLETED" and run("files", "--status", "QUARANTINED") == []
    assert [(r["sample_count"], r["version"]) for r in run("windows")] == [(5, 1)]
    uuid = run("incidents", "--state", "open")[0]["incident_uuid"]
    assert run("ack", uuid, "--by", "me", "--comment", "seen")[0]["acked_by"] == "me" and run("incidents", "--state", "open")[0]["ack_comment"] == "seen"
    # the next import goes on where the machines stopped: one more hit, then the incident closes
    (tmp_path / "next.csv").write_text("\n".join([lines[0]] + [f"dev-01,temp,{1788221810000 + 1000 * i},{v},C" for i, v in enumerate((95, 10))]) + "\n")
    run("import", str(tmp_path / "next.csv"), "--now", "2026-09-01T00:30:00Z")
    found = {r["incident_uuid"]: r for r in run("incidents")}
    assert len(found) == 2 and (found[uuid]["state"], found[uuid]["hit_count"], found[uuid]["peak_value"]) == ("closed", 2, 99.0)
    assert [r["reason"] for r in run("history")] == ["RECOVERED", "RECOVERED", "ACKNOWLEDGED"]
    # a rule and a device that are gone
    (tmp_path / "last.csv").write_text("\n".join([lines[0], "dev-01,temp,1788221820000,99,C"]) + "\n")
    run("import", str(tmp_path / "last.csv"), "--now", "2026-09-01T00:30:00Z")
    assert [r["state"] for r in run("incidents")] == ["open", "closed", "closed"]
    (tmp_path / "c.json").write_text(json.dumps(CONFIG | {"rules": [], "devices": CONFIG["devices"][:1]}))
    (tmp_path / "more.csv").write_text("\n".join([lines[0], "dev-01,temp,1788221830000,50,C"]) + "\n")
    run("import", str(tmp_path / "more.csv"), "--now", "2026-09-01T00:30:00Z")
    assert [(r["state"], r.get("close_reason")) for r in run("incidents")][0] == ("closed", "RULE_REMOVED") and run("history")[-2]["reason"] in ("RULE_REMOVED", "ACKNOWLEDGED")
    assert [(r["device_id"], r["enabled"]) for r in run("devices")] == [("dev-01", True), ("dev-02", False)]
    # a failed import and dropped days are in the audit
    with pytest.raises(FileNotFoundError):
        main(["--config", str(tmp_path / "c.json"), "--store", str(tmp_path / "store"), "import", str(tmp_path / "nowhere.csv")])
    assert run("audit")[-1]["result"].startswith("failed: FileNotFoundError")
    assert run("retain", "--days", "10", "--table", "samples", "--now", "2026-09-01T00:30:00Z") == []
    assert run("retain", "--days", "10", "--table", "samples", "--now", "2026-09-20T00:00:00Z") == [{"table": "samples", "day": "2026-09-01"}]
    assert run("status")[-1] == {"status": "SAMPLES", "files": 0} and run("audit")[-1]["operation"] == "retain" and len(run("windows")) > 0
