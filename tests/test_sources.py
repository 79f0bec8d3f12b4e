"""Files in, records out; whole imports; the streaming forms."""

import json
import os
import time

import pytest

from gaugeworks.config import from_dict
from gaugeworks.plans import ingest
from gaugeworks.sources import files, tables, tlm
from gaugeworks.sources.csv import read_csv, sniff
from gaugeworks.sources.jsonl import read_jsonl
from gaugeworks.sources.tlm import Reading, read_tlm

SETTINGS = from_dict({
    "schema_version": 1, "windows": [60, 3600], "pipeline": {"history_range": "365d", "error_rate_min_records": 20},
    "metrics": [{"id": "temp", "canonical_unit": "C", "input_units": ["C", "F", "K"]}, {"id": "pressure", "canonical_unit": "kPa", "input_units": ["Pa", "kPa", "MPa", "bar"]}],
    "devices": [{"id": "dev-01"}, {"id": "dev-02", "timezone": "Asia/Shanghai", "tags": {"line": "A"}}],
})
NOW = 1788221900 * 1_000_000
ROWS = [("dev-01", "temp", 1788221800000, 76.4, "C", 0, 1, {"line": "A"}), ("dev-01", "temp", 1788221810000, None, "C", 0, 2, {}), ("dev-02", "temp", 1788221800000, 10.0, "C", 0, None, {"zone": "w"}), ("dev-01", "pressure", 1788221820000, 300.0, "kPa", 1, 9, {})]


def write_csv(path):
    lines = ["device_id,metric,event_time,value,unit,quality,sequence,tags"]
    lines += [f"{d},{m},{t},{'' if v is None else v},{u},{q},{'' if s is None else s},{'|'.join(f'{k}={x}' for k, x in g.items())}" for d, m, t, v, u, q, s, g in ROWS]
    path.write_text("\n".join(lines) + "\n")


def write_jsonl(path):
    path.write_text("".join(json.dumps({"device_id": d, "metric": m, "event_time": t, "value": v, "unit": u, "quality": q, "tags": g} | ({"sequence": s} if s else {})) + "\n" for d, m, t, v, u, q, s, g in ROWS))


def write_tlm(path, compress=False):
    path.write_bytes(tlm.encode([Reading(d, m, t, v, u, q, s, g) for d, m, t, v, u, q, s, g in ROWS], compress=compress))


def test_one_result_from_all_formats(spark, tmp_path):
    found = []
    for name, write in (("a.csv", write_csv), ("a.jsonl", write_jsonl), ("a.tlm", write_tlm), ("b.tlm", lambda p: write_tlm(p, True))):
        write(tmp_path / name)
        stages = ingest.process(ingest.read_records(spark, [str(tmp_path / name)]), SETTINGS, NOW)
        assert stages.files.first().asDict()["accepted"] == 4, stages.validated.show(truncate=False)
        found.append(sorted((r.device_id, r.metric_id, r.event_time_us, -1.0 if r.value is None else r.value, r.quality, int(r.sequence or -1), tuple(sorted((r.tags or {}).items()))) for r in stages.samples.collect()))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 4


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿# note\n\nunit;device_id;metric;event_time;value;more\nC;"dev ""x""\ny";temp;1;1.5;z\n# c\nC;d;temp;1;abc;z\nC;d;temp;1\nC;d;temp;1;;z\n')
    rows = read_csv(spark, [str(tmp_path / "x.csv")]).orderBy("position").collect()
    assert [r.parse_error for r in rows] == [None, "value is not a number", "column count", None]
    assert rows[0].device_id == 'dev "x"\ny' and rows[0].value == 1.5 and rows[3].value is None and rows[3].has_value
    assert sniff('a;b,"c,d"') == "," and sniff('a;b;"c,d,e"') == ";"
    (tmp_path / "bad.csv").write_text("device_id,metric\n1,2\n")
    assert [r.parse_error for r in read_csv(spark, [str(tmp_path / "bad.csv"), str(tmp_path / "x.csv")]).filter("file like '%bad.csv'").collect()] == ["header: missing column event_time"]
    (tmp_path / "empty.csv").write_text("# nothing\n\n")
    assert read_csv(spark, [str(tmp_path / "empty.csv")]).count() == 0


def test_jsonl(spark, tmp_path):
    base = {"device_id": "d", "metric": "m", "event_time": 5, "value": 1.5, "unit": "C"}
    line = lambda **x: json.dumps({k: v for k, v in (base | x).items() if v != "drop"})
    cases = [
        (line(), None), (line(value=None), None), (line(value="1"), "value must be a number or null"), (line(value="drop"), "missing value"), (line(device_id=5), "device_id must be a string"), (line(device_id=None), "device_id must be a string"),
        (line(quality=1.0), "quality must be an integer"), (line(sequence=-1), "sequence must be unsigned"), (line(sequence=2**64 - 1), None), (line(tags={"a": 1}), "tag values must be strings"), (line(tags=[]), "tags must be an object"),
        (line(extra={"b": [1, 2]}, other="x"), None), ("[1]", "not an object"), ("{", "not JSON"), (line(x=eval("[" * 20 + "]" * 20)), "nesting too deep"), (line(event_time=1.5), "event_time must be a string or an integer"), ('{"value": NaN}', "not JSON"), ("   ", "gone"),
    ]
    (tmp_path / "x.jsonl").write_text("".join(c + "\n" for c, _ in cases))
    rows = read_jsonl(spark, [str(tmp_path / "x.jsonl")]).orderBy("position").collect()
    assert [r.parse_error for r in rows] == [e for _, e in cases if e != "gone"]
    assert rows[8].sequence == 2**64 - 1 and json.loads(rows[11].ext_json).keys() == {"extra", "other"} and rows[0].ext_json is None


def test_tlm(spark, tmp_path):
    data = tlm.encode([Reading("pump-07", "bearing_temp", 1785598530125, 76.4, "C", 0, 18342)], 1785598530125)
    # fixed values: the format's worked example
    assert data[:24].hex() == "544c4d31010018004d52f7bd9f01000000000000142444a0" and data[24:40].hex() == "5aa501004200000001" + "00" * 7 and data[-4:].hex() == "1baefb60"
    many = [Reading("d", "m", i, float(i), "C", sequence=i) for i in range(5)]
    data = bytearray(tlm.encode(many))
    at = data.index(tlm.SYNC, 24 + 40)
    data[at + 30] ^= 0xFF
    (tmp_path / "x.tlm").write_bytes(bytes(data))
    (tmp_path / "y.tlm").write_bytes(b"TLM2" + bytes(data[4:]))
    rows = read_tlm(spark, [str(tmp_path / "x.tlm")]).orderBy("position").collect()
    good = [r for r in rows if r.parse_error is None]
    assert [r.value for r in good] == [0.0, 2.0, 3.0, 4.0] and [r.quality for r in good] == [None, 1, 1, 1] and good[1].tags == {"resync": "true"}
    assert [r.parse_error for r in rows if r.parse_error] == ["bad payload checksum"]
    assert read_tlm(spark, [str(tmp_path / "y.tlm")]).first().parse_error == "header: bad magic"
    for raw in (b"", b"\x01\x05\x00dev-1", b"\x04\x08\x00" + b"0" * 8 + b"\x05\x00\x00"):
        with pytest.raises(tlm.FrameError):
            tlm.decode_payload(raw)


def test_tlm_values_that_are_no_numbers(spark, tmp_path):
    """NaN and infinities stay what they are, so that validation rejects them; null is a value."""
    values = [float("nan"), None, float("inf"), float("-inf"), 1.0]
    readings = [Reading("dev-01", "temp", 1788221800000 + i, v, "C", sequence=i + 1) for i, v in enumerate(values)]
    (tmp_path / "x.tlm").write_bytes(tlm.encode(readings))
    rows = read_tlm(spark, [str(tmp_path / "x.tlm")]).orderBy("position").collect()
    assert repr([r.value for r in rows]) == repr(values) and all(r.has_value and r.parse_error is None for r in rows)
    errors = {r.position: r.code for r in ingest.process(ingest.read_records(spark, [str(tmp_path / "x.tlm")]), SETTINGS, NOW).validated.select("position", "error.code").collect()}
    assert [errors[r.position] for r in rows] == ["value_not_finite", None, "value_not_finite", "value_not_finite", None]


def test_import_with_faults(spark, tmp_path):
    """A bad header, open quotes, an overlong cell and NaN in one import: good rows are stored, the bad file goes apart."""
    inbox, root = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    head = "device_id,metric,event_time,value,unit\n"
    (inbox / "bad.csv").write_text("device_id,metric\n1,2\n")
    (inbox / "long.csv").write_text(head + "dev-01,temp,1788221800000,1,C\n" + f"dev-01,{'x' * (5 << 20)},1788221801000,1,C\n" + "dev-01,temp,1788221802000,2,C\n" + 'dev-01,temp,1788221803000,3,"C\n')
    (inbox / "nan.tlm").write_bytes(tlm.encode([Reading("dev-01", "temp", 1788221810000, float("nan"), "C", sequence=1), Reading("dev-01", "temp", 1788221811000, 5.0, "C", sequence=2)]))
    (inbox / "empty.csv").write_text("")
    paths = [str(inbox / n) for n in ("bad.csv", "long.csv", "nan.tlm", "empty.csv")]
    out = ingest.import_files(spark, paths, SETTINGS, root, NOW, str(tmp_path / "archive"), str(tmp_path / "quarantine"))
    assert out == {paths[0]: "QUARANTINED", paths[1]: "COMPLETED", paths[2]: "COMPLETED", paths[3]: "COMPLETED"}
    assert sorted(r.value for r in tables.read_table(spark, f"{root}/samples", ingest.SAMPLES).collect()) == [1.0, 2.0, 5.0]
    report = json.loads(next(tmp_path.glob("quarantine/*/*/*/bad.csv.report.json")).read_text())
    assert [e["code"] for e in report["errors"]] == ["header: missing column event_time"]


def test_gate_and_import(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    write_csv(inbox / "good.csv")
    lines = ["device_id,metric,event_time,value,unit"] + [f"{'dev-01' if i % 2 else 'dev-99'},temp,{1788221800000 + i},1,C" for i in range(30)]
    (inbox / "bad.csv").write_text("\n".join(lines) + "\n")
    paths = [str(inbox / "good.csv"), str(inbox / "bad.csv")]
    out = ingest.import_files(spark, paths, SETTINGS, root, NOW, str(tmp_path / "archive"), str(tmp_path / "quarantine"))
    assert out == {paths[0]: "COMPLETED", paths[1]: "QUARANTINED"}
    assert tables.read_table(spark, f"{root}/samples", ingest.SAMPLES).count() == 4
    moved = sorted(os.path.basename(p) for p in (str(x) for x in tmp_path.glob("quarantine/*/*/*/*")))
    assert moved == ["bad.csv", "bad.csv.report.json"] and not os.listdir(inbox)
    report = json.loads(next(tmp_path.glob("quarantine/*/*/*/*.json")).read_text())
    assert report["business_errors"] == 15 and len(report["errors"]) == 15
    write_csv(inbox / "again.csv")  # the same readings again: all duplicates of stored ones
    assert ingest.import_files(spark, [str(inbox / "again.csv")], SETTINGS, root, NOW) == {str(inbox / "again.csv"): "COMPLETED"}
    assert tables.read_table(spark, f"{root}/samples", ingest.SAMPLES).count() == 4
    assert ingest.import_files(spark, [str(inbox / "again.csv")], SETTINGS, root, NOW) == {str(inbox / "again.csv"): "SKIPPED"}


def stored_windows(spark, root):
    rows = ingest.read_aggregates(spark, root).filter("window_type = '3600s'").collect()
    return sorted((r.start_us, r.version, r.superseded, r.sample_count, r["avg"]) for r in rows)


def add_readings(path, readings):
    path.write_text("\n".join(["device_id,metric,event_time,value,unit"] + [f"dev-01,temp,{t},{v},C" for t, v in readings]) + "\n")
    return str(path)


@pytest.mark.parametrize("correction", [True, False])
def test_windows_over_imports(spark, tmp_path, correction):
    """Windows hold all stored rows, however many imports brought them; late rows correct a closed window, or leave it."""
    from dataclasses import replace

    settings, root, hour = replace(SETTINGS, late_correction=correction), str(tmp_path / "store"), 1788220800000
    load = lambda name, *readings: ingest.import_files(spark, [add_readings(tmp_path / f"{name}.csv", readings)], settings, root, NOW)
    load("a", (hour + 1000, 1.0))
    load("b", (hour + 2000, 3.0))  # on time: version 1 is made again
    assert stored_windows(spark, root) == [(hour * 1000, 1, False, 2, 2.0)]
    load("c", (hour + 900_000, 5.0), (hour + 3000, 11.0))  # the second row is late
    load("d", (hour + 4000, 30.0))  # late alone
    if correction:
        assert stored_windows(spark, root) == [(hour * 1000, 1, True, 2, 2.0), (hour * 1000, 2, True, 4, 5.0), (hour * 1000, 3, False, 5, 10.0)]
    else:
        assert stored_windows(spark, root) == [(hour * 1000, 1, False, 4, 5.0)]
    whole = str(tmp_path / "whole")
    every = [(hour + 1000, 1.0), (hour + 2000, 3.0), (hour + 900_000, 5.0), (hour + 3000, 11.0), (hour + 4000, 30.0)]
    ingest.import_files(spark, [add_readings(tmp_path / "e.csv", every)], settings, whole, NOW)
    assert stored_windows(spark, whole) == [(hour * 1000, 1, False, 5, 10.0)]


def test_arrival_order(spark, tmp_path):
    """Files by name, then rows by their place, whatever their formats and sizes."""
    hour = 1788220800000
    (tmp_path / "b.csv").write_text("device_id,metric,event_time,value,unit\n" + "".join(f"dev-01,temp,{hour + i},{i},C\n" for i in range(100)))
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"device_id": "dev-01", "metric": "temp", "event_time": hour + 1000 + i, "value": 1000.0 + i, "unit": "C"}) + "\n" for i in range(5)))
    write_tlm(tmp_path / "c.tlm")
    stages = ingest.process(ingest.read_records(spark, [str(tmp_path / n) for n in ("c.tlm", "b.csv", "a.jsonl")]), SETTINGS, NOW)
    rows = stages.samples.orderBy("arrival").collect()
    assert [os.path.basename(r.file) for r in rows] == ["a.jsonl"] * 5 + ["b.csv"] * 100 + ["c.tlm"] * 4
    assert [round(r.value, 6) for r in rows[:105]] == [1000.0 + i for i in range(5)] + [float(i) for i in range(100)] and len({r.arrival for r in rows}) == 109


def test_discovery(tmp_path):
    for name in ("a.csv", "b.jsonl.ready", ".c.csv", "d.csv.tmp", "e.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "l.csv").symlink_to(tmp_path / "a.csv")
    found = files.Discovery(str(tmp_path), quiet_s=5)
    later = time.time() + 60
    assert [os.path.basename(p) for p in found.scan(later)] == ["b.jsonl.ready"]
    assert [os.path.basename(p) for p in found.scan(later)] == ["a.csv"] and found.scan(later) == []
    assert files.identity(str(tmp_path / "a.csv")).hash == files.identity(str(tmp_path / "a.csv")).hash
    place = files.put_away(str(tmp_path / "a.csv"), str(tmp_path / "store"), "0123456789abcdef", by_date=False)
    (tmp_path / "a.csv").write_text("y")
    assert files.put_away(str(tmp_path / "a.csv"), str(tmp_path / "store"), "0123456789abcdef", by_date=False) == place.replace("a.csv", "a-01234567.csv")
    assert files.inside(place, str(tmp_path)) and not files.inside("/etc", str(tmp_path))


def test_streams(spark, tmp_path):
    from gaugeworks.plans.samples import clean
    from gaugeworks.operators.lateness import flag_late
    from gaugeworks.streaming import lateness as stream

    day = 86_400_000_000
    rows = clean(spark, "/root/testdata/sf0.001").filter("device_id in ('user-1', 'user-2', 'user-3')")
    whole = sorted(map(tuple, flag_late(rows, day).collect()), key=repr)
    ordered = rows.orderBy("arrival").coalesce(1)
    half = ordered.approxQuantile("arrival", [0.5], 0)[0]
    for i, part in enumerate((f"arrival <= {half}", f"arrival > {half}")):
        ordered.filter(part).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = stream.flag_late_stream(source, day).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(*flag_late(rows, day).columns)
    assert sorted(map(tuple, got.collect()), key=repr) == whole
    bare = rows.filter("value is not null").limit(5).selectExpr("device_id", "metric_id", "event_time_us", "value", "quality", "flags", "cast(null as bigint) sequence", "arrival").cache()
    bare.unionAll(bare).coalesce(1).write.parquet(str(tmp_path / "bare"))
    query = stream.dedup_stream(spark.readStream.schema(bare.schema).parquet(str(tmp_path / "bare")), "1 day").writeStream.format("memory").queryName("bare_rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.arrival for r in spark.table("bare_rows").collect()) == sorted(r.arrival for r in bare.collect())
    for f in (lambda s: stream.windows_stream(s, "1 hour", "1 day"), lambda s: stream.dedup_stream(s, "1 day")):
        name = f"s{int(time.time() * 1e6)}"
        query = f(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() > 0


def test_streamed_import_and_rules(spark, tmp_path):
    from gaugeworks.config import Rule
    from gaugeworks.operators import rules
    from gaugeworks.plans.samples import clean
    from gaugeworks.streaming.imports import import_stream
    from gaugeworks.streaming.rules import run_rules_stream

    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("a", "b"):
        write_jsonl(inbox / f"{name}.jsonl")
        import_stream(spark, str(inbox), SETTINGS, str(tmp_path / "store"), NOW, str(tmp_path / "cp")).awaitTermination()
        assert tables.read_table(spark, str(tmp_path / "store" / "samples"), ingest.SAMPLES).count() == 4
    assert {(r.version, r.sample_count) for r in ingest.read_aggregates(spark, str(tmp_path / "store")).filter("window_type = '3600s' and metric_id = 'temp' and device_id = 'dev-01'").collect()} == {(1, 2)}

    rule = Rule("r", "click > 60", "click < 30", cooldown_us=3_600_000_000)
    found = rules.evaluations(clean(spark, "/root/testdata/sf0.001"), [rules.compile_rule(rule, ["click"])])
    whole = {r.incident_uuid: r for r in rules.incidents(rules.run_rules(found, [rule])).collect()}
    middle = found.approxQuantile("event_time_us", [0.5], 0)[0]
    for i, part in enumerate((f"event_time_us <= {middle}", f"event_time_us > {middle}")):
        found.filter(part).coalesce(1).write.parquet(str(tmp_path / "ev" / f"p{i}"))
    source = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "ev"))
    query = run_rules_stream(source, [rule]).writeStream.format("memory").queryName("incident_rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in rules.incidents(spark.table("incident_rows")).collect():
        if r.incident_uuid not in last or (r.ended_us or 0, r.hit_count) >= (last[r.incident_uuid].ended_us or 0, last[r.incident_uuid].hit_count):
            last[r.incident_uuid] = r
    assert last == whole and len(whole) > 3
