"""Records of CSV files against Python's csv module, whatever the size of the blocks."""

import csv
import random

import pytest

from talentlake.sources.records import csv_records, csv_rows


@pytest.mark.parametrize("block", [64, 300, 10_000_000])
def test_records(spark, tmp_path, block):
    rng = random.Random(block)
    pieces = ["plain", 'say "so"', "a,b", "two\nlines", "", '"', "\n\n", "é", "three\nlines, \"q\"\nmore", "x" * 150]
    want = {}
    for name in ("a.csv", "b.csv"):
        rows = [(str(k), "".join(rng.choices(pieces, k=rng.randrange(3))), rng.choice(pieces)) for k in range(60)]
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as f:
            f.write("﻿" if name == "a.csv" else "")
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", "name, of it", "note"])
            for k, r in enumerate(rows):
                w.writerow(r)
                f.write("\n" * (k % 3 == 0))  # a blank line is no record
            f.write("60,short\n61,long,x,beyond\n")
        with open(tmp_path / name, encoding="utf-8-sig", newline="") as f:
            for k, r in enumerate(csv.DictReader(f), start=1):
                want[name, k] = tuple((r[c] or None) for c in ("id", "name, of it", "note"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        tasks = spark.read.text(str(tmp_path / "*.csv")).rdd.getNumPartitions()
        got = csv_rows(spark, str(tmp_path / "*.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > (10 if block < 1000 else 0)
    assert {(r["file"].rsplit("/", 1)[1], r["row_no"]): (r["id"], r["name, of it"], r["note"]) for r in got} == want and len(got) == len(want)


def test_odd_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
    with pytest.raises(ValueError, match="not closed"):
        csv_records(spark, str(tmp_path / "open.csv"))
    (tmp_path / "none.csv").write_text("\n\n")
    assert csv_rows(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    assert csv_rows(spark, str(tmp_path / "head.csv")).columns == ["file", "row_no", "a", "b"]
