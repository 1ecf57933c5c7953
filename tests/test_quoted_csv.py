"""CSV read by byte ranges: the same rows as the reader that takes a file in one task."""

import csv
import random

import pytest

from strata.sources import readers


def write(path, n, seed, long=False):
    rnd = random.Random(seed)
    pool = ["plain", "with, comma", 'a "quote"', "two\nlines", "a\n\nb", "", " x ", "é中", '"', "\n", "tail\r"]
    rows = [[str(1000 * seed + i), rnd.choice(pool), rnd.choice(pool) * rnd.randint(1, 4), "z" if i % 2 else ""] for i in range(n)]
    if long:
        rows.insert(n // 2, ["-1", "line\n" * 6000 + 'end "here"', "x", "y"])
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "a,b", "c", "d\nname"])
        w.writerows(rows)
    return rows


@pytest.mark.parametrize("size,long", [("1g", False), ("2k", False), ("700b", True), ("64b", False)])
def test_same_rows_in_many_ranges(spark, tmp_path, size, long):
    want = write(tmp_path / "a.csv", 300, 1, long) + write(tmp_path / "b.csv", 40, 2)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = readers.read_csv(spark, str(tmp_path), na_values=[], infer=False)
        got = [tuple(r) for r in df.collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert df.columns == ["id", "a,b", "c", "d\nname"]
    assert len(got) == len(want)
    assert sorted((v or "") for r in got for v in r) == sorted(v for r in want for v in r)
    assert {r[0]: tuple(v or "" for v in r) for r in got} == {r[0]: tuple(r) for r in want}


def test_header_alone_and_a_row_like_it(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "i.csv").write_text('a,b\na,b\n\n1,"x\ny"\n')
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "i.csv"), infer=False).collect()) == [("1", "x\ny"), ("a", "b")]
