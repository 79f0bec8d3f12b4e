"""Imports from and into a store that only Spark reaches: here a mount with a name of its own."""

import json
import os
import time

import pytest

from gaugeworks.plans import ingest
from gaugeworks.sources import files, tables

from .test_sources import NOW, SETTINGS, write_csv


@pytest.fixture
def mount(spark, tmp_path):
    for name in ("in", "store", "away"):
        (tmp_path / name).mkdir()
        spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.mount{os.getpid()}.link./{name}", f"file://{tmp_path}/{name}")
    return tmp_path, f"viewfs://mount{os.getpid()}"


def test_import_by_a_remote_path(spark, mount):
    local, far = mount
    write_csv(local / "in" / "good file.csv")
    (local / "in" / "bad.csv").write_text("device_id,metric\n1,2\n")
    (local / "in" / "c.csv.part").write_text("x")
    watch = files.Discovery(f"{far}/in", quiet_s=0, spark=spark)
    later = time.time() + 60
    assert watch.scan(later) == [] and [os.path.basename(p) for p in watch.scan(later)] == ["bad.csv", "good file.csv"] and watch.scan(later) == []
    paths = [f"{far}/in/good file.csv", f"{far}/in/bad.csv"]
    assert files.identity(paths[0], spark) == files.identity(paths[0], spark) and files.identity(paths[0], spark).size == (local / "in" / "good file.csv").stat().st_size
    out = ingest.import_files(spark, paths, SETTINGS, f"{far}/store", NOW, f"{far}/away", f"{far}/away")
    assert out == {paths[0]: "COMPLETED", paths[1]: "QUARANTINED"}
    assert tables.read_table(spark, f"{far}/store/samples", ingest.SAMPLES).count() == 4
    moved = sorted(p.name for p in local.glob("away/*/*/*/*") if not p.name.startswith("."))
    assert moved == ["bad.csv", "bad.csv.report.json", "good file.csv"] and [p for p in os.listdir(local / "in") if not p.startswith(".")] == ["c.csv.part"]
    assert json.loads(next(local.glob("away/*/*/*/*.json")).read_text())["errors"][0]["code"].startswith("header: ")
    write_csv(local / "in" / "good file.csv")  # its name is taken there; its readings are stored
    again = ingest.import_files(spark, paths[:1], SETTINGS, f"{far}/store", NOW + 1, f"{far}/away")
    assert again == {paths[0]: "COMPLETED"} and tables.read_table(spark, f"{far}/store/samples", ingest.SAMPLES).count() == 4
    assert len([p for p in local.glob("away/*/*/*/good file*.csv")]) == 2
