"""CSV records over several lines, files and parts, against the standard reader."""

import csv
import io
import random

import pytest

from tonearm.sources import tables


def plain(path):
    out = []
    for f in sorted(path.iterdir()):
        text = f.read_text()
        if list(csv.reader(io.StringIO(text + "\nend\n")))[-1] != ["end"]:
            text = text.removesuffix("\n")  # the last line of a field that is never closed
        out += [r for r in csv.reader(io.StringIO(text)) if r]
    return out


def read(spark, path):
    return [r.fields for r in tables.csv_lines(spark, str(path)).orderBy("line_no").collect()]


@pytest.mark.parametrize(("seed", "part"), [(1, None), (2, 64), (3, 7)])
def test_equals_the_standard_reader(spark, tmp_path, seed, part):
    rnd = random.Random(seed)
    atoms = ["a", "b c", '"', '""', ",", "\n", '"x\ny"', '"p,q"', "", '"\n\n"', "é", '"a""b\n"c']
    for k, size in enumerate((12, 3, 30) if part == 7 else (40, 3, 200)):
        (tmp_path / f"{k}.csv").write_text("".join(rnd.choice(atoms) + rnd.choice(["", ",", "\n", ""]) for _ in range(size)) + "\n")
    (tmp_path / "9.csv").write_text('k,"one\ntwo"\n\n"open,\n\nto the end')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if part:
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        assert read(spark, tmp_path) == plain(tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_names_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"the\nband",The Band\nx,"X\n1"\n')
    (tmp_path / "b.csv").write_text('x,last\n')
    assert sorted(map(tuple, tables.read_artist_alias(spark, str(tmp_path)).collect())) == [("the\nband", "The Band"), ("x", "last")]
    assert [tuple(r)[1:] for r in tables.read_rename_list(spark, str(tmp_path)).orderBy("line_no").collect()] == [("the\nband", "The Band"), ("x", "X\n1"), ("x", "last")]
