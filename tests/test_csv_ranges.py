"""CSV files cut into ranges: the same rows for any size of a range, against a reading from start to end in plain Python."""

import csv
import io
import random

import pytest

from gaugeworks.sources import csv as source

HEAD = "device_id,metric,event_time,value,unit,tags"


def plain(text):
    """(position, record or what is wrong) from start to end."""
    out, at, lines = [], 0, text.encode().split(b"\n")
    if lines and lines[-1] == b"":
        lines.pop()
    seen_header, i = False, 0
    while i < len(lines):
        line, start = lines[i], at
        at += len(line) + 1
        i += 1
        line = line.removeprefix(b"\xef\xbb\xbf") if start == 0 else line
        if line in (b"", b"\r") or line.startswith(b"#"):
            continue
        if not seen_header:
            seen_header = True
            continue
        parts = [line]
        while sum(p.count(b'"') for p in parts) % 2 and i < len(lines):
            parts.append(lines[i])
            at += len(lines[i]) + 1
            i += 1
        record = b"\n".join(parts).removesuffix(b"\r")
        if sum(p.count(b'"') for p in parts) % 2:
            out.append((start, "unterminated quote"))
        elif sum(len(p) + 1 for p in parts) - 1 > source.MOST_BYTES:
            out.append((start, "record too long"))
        else:
            out.append((start, next(csv.reader(io.StringIO(record.decode(), newline="")))))
    return out


def made(seed, records=60):
    r = random.Random(seed)
    cells = ["dev", "", "a b", 'say "hi"', "two\nlines", "three\n\nlines\n# no comment", "semi;colon", "comma,", "\r", "é漢"]
    lines = [HEAD]
    for i in range(records):
        if r.random() < 0.1:
            lines.append(r.choice(["", "# a comment", '# one " quote', "\r", '#""']))
        row = [r.choice(cells) for _ in range(6 if r.random() < 0.95 else 5)]
        quoted = [f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in '",\n\r') or r.random() < 0.1 else c for c in row]
        lines.append(",".join(["x" + quoted[0].strip('"').replace('"', "").replace("\n", "").replace("\r", "").replace(",", ""), *quoted[1:]]))
    return "\n".join(lines) + "\n" * r.randint(0, 1)


def read(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return [r.asDict() for r in source.read_csv(spark, [str(path)]).orderBy("position").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def check(rows, expected):
    assert [r["position"] for r in rows] == [p for p, _ in expected]
    for r, (_, want) in zip(rows, expected, strict=True):
        if isinstance(want, str):
            assert r["parse_error"] == want
        elif len(want) != 6:
            assert r["parse_error"] == "column count"
        else:
            assert r["parse_error"] in (None, "value is not a number", "bad tags") and (r["device_id"], r["metric"], r["event_time"], r["unit"]) == (*want[:3], want[4])


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges(spark, tmp_path, seed):
    text = made(seed)
    for end in ("", '\nx,"open,1,2,C,\nlast line'):
        (tmp_path / "a.csv").write_bytes((text.rstrip("\n") + end).encode())
        expected = plain(text.rstrip("\n") + end)
        sizes = [1 << 27, len(text) // 64 + 1]
        found = [read(spark, tmp_path / "a.csv", s) for s in sizes]
        assert found[0] == found[1]
        check(found[0], expected)


def test_comment_quotes_at_edges(spark, tmp_path):
    """A comment's odd quote counts inside a quoted field only."""
    text = HEAD + '\n# it"s\nx,m,1,2,C,\ny,"m\n# it""s",1,2,C,\nz,m,1,2,C,\n'
    (tmp_path / "a.csv").write_text(text)
    for size in (1 << 27, 9, 4):
        rows = read(spark, tmp_path / "a.csv", size)
        check(rows, plain(text))
        assert [r["metric"] for r in rows] == ["m", 'm\n# it"s', "m"]


def test_faults_are_rows(spark, tmp_path):
    """Overlong cells and records, and quotes that stay open, leave the other rows alone; memory keeps no long record."""
    big = "v" * (5 << 20)
    lines = [HEAD, "a,m,1,1,C,", f"b,{big},1,1,C,", 'c,"' + "line\n" * 400_000 + '",1,1,C,', "d,m,1,1,C,", 'e,m,"1,1,C,', "f,m,1,1,C,"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    for size in (1 << 27, 700_000):
        rows = read(spark, tmp_path / "a.csv", size)
        assert [r["parse_error"] for r in rows] == [None, "record too long", "record too long", None, "unterminated quote"]
        assert [r["device_id"] for r in rows] == ["a", "", "", "d", ""] and all(len(r["raw"]) <= 256 for r in rows)


def test_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "\n" + "".join(f'd{i},"m\n{i}",{i},1,C,\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        assert source._lines(spark, [str(tmp_path / "a.csv")]).rdd.getNumPartitions() > 10
        found = source.read_csv(spark, [str(tmp_path / "a.csv")])
        assert found.filter("parse_error is null").count() == found.select("device_id", "metric").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
