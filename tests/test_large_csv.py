"""Large CSV by splits against Python's csv over the whole file."""

from __future__ import annotations

import csv
import io
import random

from tessera.sources import large_csv


def test_splits_equal_the_whole_file(spark, tmp_path):
    """Quoted line ends, doubled quotes and stray ones, cut into splits of a few hundred bytes."""
    rnd = random.Random(7)
    files = {}
    for name in ("a.csv", "b.csv"):
        rows = []
        for _ in range(400):
            cell = lambda: rnd.choice(["x", "é 1", "", '"q ""r"" s"', '"line one\nline two"', '"a,b\r\nc"', '5" disk', '"open"tail "x', '"\n\n\n' + "long " * rnd.randint(0, 90) + '"'])
            rows.append(",".join(cell() for _ in range(rnd.randint(1, 4))))
        files[name] = "﻿" + "\r\n".join(rows) + ("\n" if name == "a.csv" else '\n"never closed\nto the end,1')
    files["c.csv"], files["d.csv"] = "", '"one"'
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = large_csv.read_large_csv(spark, f"file://{tmp_path}/*.csv").orderBy("path", "split", "row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({(r.path, r.split) for r in got}) > 40
    for name, text in files.items():
        # a line end in a cell stays as it is in the file
        want = [c for c in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if any(x.strip() for x in c)]
        assert [list(r.cells) for r in got if r.path.endswith(name)] == want, name


def test_lines_end_inside_or_not():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice('",a\n') for _ in range(rnd.randint(0, 14)))
        inside, parts, rows = False, [], []
        for line in text.split("\n"):
            parts.append(line)
            inside = large_csv.ends_inside(line, inside, ",")
            if not inside:
                rows.append("\n".join(parts))
                parts = []
        rows += ["\n".join(parts)] if parts else []
        assert [c for r in rows for c in csv.reader([x + "\n" for x in r.split("\n")])] == [c for c in csv.reader(io.StringIO(text + "\n", newline=""))], text
