"""The delimited source against read_csv, in splits of any size, and as a stream."""

from __future__ import annotations

import os
import random

import pytest

from tablemill.sources import datasource
from tablemill.sources.delimited import fields_of, read_csv


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    datasource.register(spark)


LONG = "ID;Texto\n" + "".join(f'{i};"linha {i}\n{"fim" if i % 3 else "x" * 40}{chr(10) * (i % 4)}"\n' for i in range(1, 120))
TEXTS = [
    "ID;Preço;Nome\n1;1,37;Ana\n2;2,50;Bruno", 'Nome,Cidade\r\n"Ana, Maria","Rio, ""RJ"""\r\n', "﻿Valor;Valor\n1;2\n;\n3;4\n", "A;B\nx\ny;z;;\n", "Código;Valor\n001;1\n002;indefinido",
    "A\n", "A;B\n\n\n1;2\n", '"a\nb";c\n"1\n2";3', LONG,
]


def shown(frame):
    return [tuple(r) for r in frame.sorted().collect()], frame.ids, [c.detected_type for c in frame.columns]


@pytest.mark.parametrize("n", range(len(TEXTS)))
@pytest.mark.parametrize("split", [3, 97])
def test_the_same_frames(spark, tmp_path, n, split):
    path = f"file://{tmp_path}/a.csv"
    (tmp_path / "a.csv").write_bytes(TEXTS[n].encode())
    if split == 3 and n == len(TEXTS) - 1:
        split = 41
    want = read_csv(spark, path)
    df = spark.read.format("delimited").option("splitBytes", split).load(path)
    assert shown(datasource.frame_of(df, [c.header for c in want.columns])) == shown(want)


def test_any_text_in_any_splits():
    """Records and numbers of random texts, without Spark."""
    import pathlib
    import tempfile

    r = random.Random(4)
    for _ in range(200):
        cells = ['"' + "".join(r.choice('a\n;""'[:4]) for _ in range(r.randrange(6))).replace('"', '""') + '"' if r.random() < 0.5 else r.choice(["", "x", "é"]) for _ in range(r.randrange(1, 30))]
        text = "".join(c + r.choice([";", "\n"]) for c in cells)
        with tempfile.TemporaryDirectory() as d:
            p = pathlib.Path(d, "t.csv")
            p.write_bytes(text.encode())
            whole = None
            for split in (1, 2, 5, 1000):
                system, files = datasource.files_of(str(p))
                splits, n = datasource.splits_of(datasource.counts_of(system, files, split), 0)
                got = [x for s in splits for x in datasource.records(system, s)]
                assert [k for k, _ in got] == list(range(1, n + 1))
                whole = whole or got
                assert got == whole
            assert "\n".join(t for _, t in whole) == text.removesuffix("\n")


def test_a_plan_made_by_tasks(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_bytes(LONG.encode())
    (tmp_path / "_hidden").write_bytes(b"x")
    path = f"file://{tmp_path}"
    plan = datasource.plan_splits(spark, path, 500)
    df = spark.read.format("delimited").option("plan", plan).load(path)
    want = read_csv(spark, f"{path}/*.csv")
    assert shown(datasource.frame_of(df, ["ID", "Texto"])) == shown(want)
    assert df.rdd.getNumPartitions() > 10


@pytest.mark.parametrize(("text", "code"), [('A;B\n"x;1', "fechado"), ("A;B\n1;2\n1;2;3", "registro 3"), ("", "cabeçalho")])
def test_bad_files(spark, tmp_path, text, code):
    (tmp_path / "a.csv").write_bytes(text.encode())
    with pytest.raises(Exception, match=code):
        spark.read.format("delimited").load(f"file://{tmp_path}/a.csv").collect()


def test_a_growing_folder_is_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "z.csv").write_bytes(b'A;B\n1;"x\ny"\n2;z\n')
    os.utime(folder / "z.csv", (1_000, 1_000))
    df = spark.readStream.format("delimited").option("splitBytes", 5).load(f"file://{folder}")
    query = df.writeStream.format("memory").queryName("grown").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("grown").collect())) == [("1", "x\ny", 2), ("2", "z", 3)]
        (folder / "a.csv").write_bytes(b"A;B\n3;w\n")
        os.utime(folder / "a.csv", (2_000, 2_000))
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("grown").collect())) == [("1", "x\ny", 2), ("2", "z", 3), ("3", "w", 5)]
    finally:
        query.stop()
    assert fields_of("a;b", ";") == ["a", "b"]
