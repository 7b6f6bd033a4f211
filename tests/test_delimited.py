"""Cells of delimited files against Python's csv reader, over files of many blocks."""

import csv
import io
import random

import pytest

from tallyframe.sources import delimited


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of a few dozen bytes, so that records cross their edges."""
    keys = {"spark.sql.files.maxPartitionBytes": "48b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def expected(text, sep):
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
    n = len(rows[0])
    return [tuple((r + [""] * n)[:n]) for r in rows[1:]]


def scanned(spark, tmp_path, text, sep):
    f = tmp_path / "x.csv"
    f.write_bytes(text.encode())
    df = delimited.read(spark, str(f), sep=sep)
    return [tuple(r) for r in df.collect()], df


PLAIN = ['A,B,C', 'x,y,z', '', 'short', 'a,b,c,long', '  pad , 5" pipe,a"b""c', ',,', 'é,日本,😀', 'back\\,sl\\"ash,\\']
QUOTED = ['"say ""hi"", ok",2,3', '"two\nlines",5,6', '"back\\",8,9', '"",x,""', '"a"tail,"b" ,c', '"three\r\n\r\nlines ""q""\n",,"\n"', 'x,"only, comma",y', '"q""\n""",""""', 'u"n,quoted"\n"x"']


@pytest.mark.parametrize("sep", [",", "|"])
def test_each_kind_of_cell(spark, tmp_path, sep):
    for text in ("\n".join(PLAIN + QUOTED) + "\n", "\r\n".join(PLAIN + QUOTED), "\n".join(PLAIN), "A,B,C", '"A\n1",B,"C"\n1,2,3\n"4\n\n",5,6'):
        text = text.replace(",", sep)
        got, _ = scanned(spark, tmp_path, text, sep)
        assert sorted(got) == sorted(expected(text, sep))


def test_random_files_of_many_blocks(spark, tmp_path, tiny_blocks):
    rng = random.Random(5)
    for trial in range(4):
        cell = lambda: "".join(rng.choice(['"', '""', ",", "\n", "\r\n", "a", "bc", "é", "\\", " ", "x" * 40]) for _ in range(rng.randint(0, 7)))
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        w.writerow(["A", "B", "C"])
        for _ in range(25):
            w.writerow([cell().replace("\r", "").replace("\n", rng.choice(["\n", "\r\n"])) for _ in range(rng.choice([1, 3, 3, 3, 4]))])
        text = out.getvalue() + (rng.choice(['"open to the end\nof, file', ""]) if trial % 2 else 'a "quote" inside,5" x,y\n')
        got, df = scanned(spark, tmp_path, text, ",")
        assert df.rdd.getNumPartitions() > 5
        assert sorted(got) == sorted(expected(text, ","))


def test_lines_dealt_and_sorted_where_blocks_are_many(spark, tmp_path, tiny_blocks, monkeypatch):
    monkeypatch.setattr(delimited, "BROADCAST_BLOCKS", 0)
    text = "A,B\n" + "".join(f'{i},"{"y" * (i % 50)}\n\n{i}"\n' for i in range(60))
    got, _ = scanned(spark, tmp_path, text, ",")
    assert sorted(got) == sorted(expected(text, ","))


def test_files_of_several_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('X,Y,Z\n1,"2\n2",3\n')
    (tmp_path / "b.csv").write_text("Z,X,X,\n9,8,7,6\n\n")
    (tmp_path / "c.dat").write_text('X|Y|Z\n4|5|"6|6"\n')
    df = delimited.read(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.dat")])
    assert {tuple(sorted(r.asDict().items())) for r in df.collect()} == {
        (("X", "1"), ("X1", ""), ("X2", ""), ("Y", "2\n2"), ("Z", "3"), ("_c3", "")),
        (("X", ""), ("X1", "8"), ("X2", "7"), ("Y", ""), ("Z", "9"), ("_c3", "6")),
        (("X", ""), ("X1", ""), ("X2", ""), ("Y", ""), ("Z", ""), ("_c3", "")),
        (("X", "4"), ("X1", ""), ("X2", ""), ("Y", "5"), ("Z", "6|6"), ("_c3", "")),
    }
    with pytest.raises(ValueError, match="separator"):
        delimited.read(spark, str(tmp_path / "a.csv"), sep='"')


def test_long_lines_take_linear_time(spark, tmp_path):
    csv.field_size_limit(1 << 24)
    for body in ('"' * 400_001, '""' * 200_000 + ",", '"a",' * 100_000, '"x' * 200_000):
        text = "A,B,C\n" + body + "\n1,2,3"
        got, _ = scanned(spark, tmp_path, text, ",")
        assert sorted(got) == sorted(expected(text, ","))
