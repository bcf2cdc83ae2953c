"""CSV files with line breaks in quotes, cut into many small blocks, against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from sparkboard.sources import csv, records

BLOCKS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get(BLOCKS)
    spark.conf.set(BLOCKS, "97")
    yield
    spark.conf.set(BLOCKS, before)


def whole(spark, path, charset="UTF-8"):
    """Read by one task per file, with Spark's own cells."""
    read = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding=charset)
    return [tuple(r) for r in read.csv(str(path)).collect()]


def given(spark, path, **kinds):
    rows = csv.read_csv(spark, str(path), row_number=True, **kinds).orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == list(range(1, len(rows) + 1))
    return [tuple(r)[:-1] for r in rows]


def made(seed, end, letters):
    """Rows whose cells hold breaks, commas, doubled quotes and, unquoted, quotes that open nothing."""
    rng = random.Random(seed)
    pieces = ["a", "bc", ",", '""', end, end + end, " ", letters, "x" * 60]
    lines = [f'n,"the{end}note",c']
    for n in range(150):
        cells = [str(n)]
        for _ in range(2):
            inner = "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
            cells.append(f'"{inner}"' if rng.random() < 0.6 else rng.choice(["plain", '5" pipe', 'say "x y"', letters, "z"]))
        lines.append(",".join(cells))
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + (end if seed % 2 else "")


@pytest.mark.parametrize("seed, end, charset", [
    (1, "\n", "UTF-8"), (2, "\n", "UTF-8"), (3, "\r\n", "UTF-8"), (4, "\n", "ISO-8859-1"), (5, "\r\n", "ISO-8859-1"),
])
def test_blocks_give_the_rows_of_the_whole_file(spark, tmp_path, small_blocks, seed, end, charset):
    path = tmp_path / "a.csv"
    path.write_bytes(made(seed, end, "Größe").encode(charset))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
    wanted, found = whole(spark, path, charset), given(spark, path)
    assert len(wanted) == 150 and found == wanted


def test_a_cell_over_many_blocks_and_one_block_of_continued_lines(spark, tmp_path, small_blocks):
    path = tmp_path / "a.csv"
    long = "\n".join(f"line {k} with ""some"" words" for k in range(100))
    path.write_text(f'a,b\n1,"{long}"\n2,"x\ny"\n3,"{long},\n"\n4,end\n')
    assert given(spark, path) == [("1", long), ("2", "x\ny"), ("3", long + ",\n"), ("4", "end")]


def test_a_mark_before_a_quoted_header_and_several_files(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes('﻿"the\nkey",b\n1,"x\ny"\n'.encode())
    (tmp_path / "b.csv").write_bytes('b,"the\nkey"\n"p\nq",2\n'.encode())
    found = given(spark, tmp_path)
    assert sorted(found) == [("1", "x\ny"), ("2", "p\nq")]


def test_a_quote_never_closed_fails(spark, tmp_path, small_blocks):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,"open\n' + "2,x\n" * 100)
    with pytest.raises(Exception, match="never closed"):
        csv.read_csv(spark, str(path)).collect()


def test_too_many_cells_fail_and_short_rows_are_filled(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n"1\n2"\n')
    assert given(spark, path) == [("1\n2", None)]
    path.write_text('a,b\n"1\n2",x,y\n')
    with pytest.raises(Exception, match="more than 2 cells"):
        csv.read_csv(spark, str(path)).collect()


def test_very_long_lines_take_no_stack(spark, tmp_path):
    path = tmp_path / "a.csv"
    cell = '""q,' * 200_000
    path.write_text(f'a,b\n1,"{cell}\n{cell}"\n')
    assert given(spark, path) == [("1", (cell + "\n" + cell).replace('""', '"'))]


def test_files_of_carriage_returns_are_read_whole(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'a,b\r1,"x\ry"\r2,z\r')
    assert not records.splittable(spark, [str(path)], "UTF-8")
    assert [r[0] for r in given(spark, path)] == ["1", "2"]


def test_a_broken_cell_costs_no_tasks(spark, tmp_path):
    """The lines are dealt by block, and no reader of whole files is left in the plan."""
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" + '1,"x\ny"\n' * 10)
    plan = csv.read_csv(spark, str(path))._jdf.queryExecution().toString()
    assert "FileScan csv" not in plan and "FileScan text" in plan
    assert csv.read_csv(spark, str(path)).where(F.col("b") == "x\ny").count() == 10
