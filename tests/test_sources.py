"""Delimited files, workbooks and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablemill.frame import ROW_NUM, FrameError, from_dataframe
from tablemill.operators.commands import apply
from tablemill.sources.delimited import SourceReadError, detect_delimiter, read_csv
from tablemill.sources.workbooks import list_sheets, read_references, read_source, read_xlsx, unique_sheet_name, workbook_bytes, workbooks
from tablemill.streaming.prepared import apply_to_stream, first_of_each, validate_stream


def csv_frame(spark, tmp_path, text: str, delimiter: str | None = None):
    (tmp_path / "a.csv").write_bytes(text.encode())
    return read_csv(spark, f"file://{tmp_path}/a.csv", delimiter)


def rows(frame):
    return [tuple(r)[: len(frame.ids)] for r in frame.sorted().collect()]


def kinds(frame):
    return [c.detected_type for c in frame.columns]


def test_numbers_with_commas(spark, tmp_path):
    f = csv_frame(spark, tmp_path, "ID;Preço;Nome\n1;1,37;Ana\n2;2,50;Bruno")
    assert kinds(f) == ["number", "number", "string"] and rows(f) == [(1.0, 1.37, "Ana"), (2.0, 2.5, "Bruno")]
    assert f.ids == ["id__1", "preco__1", "nome__1"]


def test_padded_ids_stay_text(spark, tmp_path):
    f = csv_frame(spark, tmp_path, "Código;Valor\n001;1\n002;indefinido")
    assert kinds(f) == ["string", "string"]


def test_quoted_fields(spark, tmp_path):
    f = csv_frame(spark, tmp_path, 'Nome,Cidade\r\n"Ana, Maria","Rio, ""RJ"""\r\n')
    assert rows(f) == [("Ana, Maria", 'Rio, "RJ"')]


def test_bom_repeated_headers_and_blank_records(spark, tmp_path):
    f = csv_frame(spark, tmp_path, "﻿Valor;Valor\n1;2\n;\n3;4\n")
    assert f.ids == ["valor__1", "valor__2"] and rows(f) == [(1.0, 2.0), (3.0, 4.0)]
    assert [r[0] for r in f.sorted().select(ROW_NUM).collect()] == [2, 4]


@pytest.mark.parametrize(("text", "code"), [('A;B\n"x;1', "MissingQuotes"), ("A;B\n1;2\n1;2;3", "TooManyFields"), ("", "EmptySource")])
def test_bad_files(spark, tmp_path, text, code):
    with pytest.raises(SourceReadError) as e:
        csv_frame(spark, tmp_path, text)
    assert e.value.issues[0].code == code
    assert e.value.issues[0].row == (3 if code == "TooManyFields" else None)


def test_short_and_long_but_empty_records(spark, tmp_path):
    assert rows(csv_frame(spark, tmp_path, "A;B\nx\ny;z;;\n")) == [("x", None), ("y", "z")]


@pytest.mark.parametrize(("line", "want"), [("a;b;c,d", ";"), ("a\tb", "\t"), ('"a,b,c";d', ";"), ("a", ","), ("a,b;c", ",")])
def test_delimiters(line, want):
    assert detect_delimiter(line + "\n1,2,3,4") == want


def test_records_across_many_splits(spark, tmp_path):
    """Quoted line ends at split borders: the same rows and numbers however the file is split."""
    text = "ID;Texto\n" + "".join(f'{i};"linha {i}\n{"fim" if i % 3 else "x" * 40}{chr(10) * (i % 4)}"\n' for i in range(1, 400))
    whole = rows(csv_frame(spark, tmp_path, text))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        cut = csv_frame(spark, tmp_path, text)
        assert rows(cut) == whole
        assert [r[0] for r in cut.sorted().select(ROW_NUM).collect()] == list(range(2, 401))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(whole) == 399 and whole[2][1] == "linha 3\n" + "x" * 40 + "\n\n\n"


def load_rows(n: int) -> str:
    """The load scenario: seven columns, separated by semicolons."""
    out = ["ID;Produto;Quantidade;Preço;Ativo;Data;Observação"]
    out += [f"{i};Produto {i:06d};{i % 500};{i * 137 // 100},{i * 137 % 100:02d};{str(i % 2 == 1).lower()};2026-{i % 12 + 1:02d}-{i % 28 + 1:02d};{'' if i % 11 == 0 else f'Lote {i % 7}'}" for i in range(1, n + 1)]
    return "\n".join(out)


def test_load_scenario(spark, tmp_path):
    f = csv_frame(spark, tmp_path, load_rows(10_000))
    assert kinds(f) == ["number", "string", "number", "number", "string", "string", "string"]
    f = apply(f, {"type": "prefix", "columnId": "produto__1", "value": "P-"})
    assert f.df.agg(F.count(F.lit(1)), F.max("produto__1")).first()[:] == (10_000, "P-Produto 010000")


# --- workbooks


def book(tmp_path, name: str, headers: list[str], body: list[list]):
    (tmp_path / name).write_bytes(workbook_bytes(headers, iter(body), "Dados"))
    return f"file://{tmp_path}/{name}"


def test_sheet_of_several_kinds(spark, tmp_path):
    path = book(tmp_path, "a.xlsx", ["Cliente", "Valor", "Valor"], [["Ana", 12.5, True], [None, None, None], ["Bruno & <Cia>", 23.75, "x"]])
    f = read_source(spark, path)
    assert list_sheets(spark, path) == ["Dados"] and list_sheets(spark, "a.csv") == []
    assert f.ids == ["cliente__1", "valor__1", "valor__2"] and kinds(f) == ["string", "number", "mixed"]
    got = f.sorted().collect()
    assert [(r.cliente__1, r.valor__1, r.valor__2.t) for r in got] == [("Ana", 12.5, "boolean"), ("Bruno & <Cia>", 23.75, "string")]
    assert [r[ROW_NUM] for r in got] == [2, 4]


def test_destination_range(spark, tmp_path):
    path = book(tmp_path, "b.xlsx", ["A", "", "C"], [[1, "x", 3], [2, "y", 4], [5, "z", 6]])
    f = read_xlsx(spark, path, region="$A$1:B3")
    assert f.ids == ["a__1", "coluna-b__2"] and rows(f) == [(1.0, "x"), (2.0, "y")]
    assert [r[0] for r in f.sorted().select("_row_id").collect()] == ["template-2", "template-3"]


@pytest.mark.parametrize(("args", "code"), [({"sheet": "Outra"}, "MissingSheet"), ({"max_cells": 3}, "WorksheetRangeTooLarge"), ({"max_cells": 0}, "InvalidCellBound")])
def test_bad_workbooks(spark, tmp_path, args, code):
    path = book(tmp_path, "c.xlsx", ["A", "B"], [[1, 2]])
    with pytest.raises(SourceReadError) as e:
        read_xlsx(spark, path, **args)
    assert e.value.issues[0].code == code


def test_other_files(spark, tmp_path):
    (tmp_path / "d.xlsx").write_bytes(b"no zip")
    for name, code in (("d.xlsx", "InvalidWorkbook"), ("d.pdf", "UnsupportedFileType")):
        with pytest.raises(SourceReadError) as e:
            read_source(spark, f"file://{tmp_path}/{name}")
        assert e.value.issues[0].code == code


def test_round_trip_in_several_workbooks(spark, tmp_path):
    df = spark.range(25).selectExpr("id AS k", "concat('n', id) AS name", "id / 4 AS q", "id % 2 = 0 AS even")
    f = apply(from_dataframe(df, ["k"]), {"type": "sort", "sorts": [{"columnId": "k", "direction": "desc"}]})
    parts = sorted(workbooks(f, rows=10).collect())
    assert [(p.part, p.n_rows) for p in parts] == [(0, 10), (1, 10), (2, 5)]
    back = []
    for p in parts:
        (tmp_path / f"{p.part}.xlsx").write_bytes(bytes(p.content))
        back += rows(read_xlsx(spark, f"file://{tmp_path}/{p.part}.xlsx"))
    assert back == [(float(i), f"n{i}", i / 4, i % 2 == 0) for i in reversed(range(25))]


def test_sheet_names():
    assert unique_sheet_name("a/b:c" + "x" * 40)[:6] == "a b cx" and len(unique_sheet_name("x" * 40)) == 31
    assert unique_sheet_name("Dados", ["dados", "DADOS (2)"]) == "Dados (3)"


# --- streams


def test_rules_and_commands_on_a_stream(spark, tmp_path):
    spark.range(20).selectExpr("id AS k", "CASE WHEN id % 5 = 0 THEN '' ELSE 'v' END AS s", "timestamp_seconds(id) AS ts").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, s string, ts timestamp").parquet(f"file://{tmp_path}/in")
    f = apply_to_stream(from_dataframe(stream, ["k"], ["k", "s"]), {"type": "suffix", "columnId": "s", "value": "!"})
    issues = validate_stream(f, [{"type": "required", "columnId": "s"}]).issues.select("rowId")
    q = issues.writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.rowId for r in spark.table("found").collect()} == {"row-0", "row-5", "row-10", "row-15"}
    q = first_of_each(stream, ["s"], "ts", "1 hour").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 2
    for bad in ({"type": "sort", "sorts": []}, {"type": "deduplicate", "columnIds": ["s"], "keep": "first"}):
        with pytest.raises(FrameError):
            apply_to_stream(f, bad)
    with pytest.raises(FrameError):
        validate_stream(f, [{"type": "unique", "columnId": "s"}])


def test_a_folder_is_one_source(spark, tmp_path):
    """Quoted line ends across splits, a byte order mark, an empty file among others."""
    folder = tmp_path / "many"
    folder.mkdir()
    for n, text in {"a": "id,t\n1,x\n2,\"a\nb\"\n", "b": "", "c": "﻿\"id\",t\r\n3,\"q\"\"\n\"\r\n\r\n4,y\r\n", "d": "id,t\n"}.items():
        (folder / f"{n}.csv").write_bytes(text.encode())
    f = read_csv(spark, f"file://{folder}")
    assert rows(f) == [(1.0, "x"), (2.0, "a\nb"), (3.0, 'q"\n'), (4.0, "y")]
    assert [r[0] for r in f.sorted().select(ROW_NUM).collect()] == [2, 3, 5, 7]
    assert rows(read_csv(spark, f"file://{folder}/[ad].csv")) == rows(f)[:2]
    (folder / "e.csv").write_text("id,u\n5,z\n")
    with pytest.raises(SourceReadError) as e:
        read_csv(spark, f"file://{folder}")
    assert e.value.issues[0].code == "UnlikeHeaders"
    (folder / "e.csv").write_text('id,t\n5,"z\n')
    with pytest.raises(SourceReadError) as e:
        read_csv(spark, f"file://{folder}")
    assert e.value.issues[0].code == "MissingQuotes"


def test_every_sheet_is_a_reference(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes(["code"], iter([["A"], ["B"]]), "Catalog"))
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes([f"c{i}" for i in range(9)], iter([["A"] * 9] * 9), "Large"))
    got = read_references(spark, f"file://{tmp_path}/a.xlsx", f"file://{tmp_path}/b.xlsx", max_cells=20)
    assert list(got) == ["source:Catalog"] and rows(got["source:Catalog"]) == [("A",), ("B",)]
    assert read_references(spark, f"file://{tmp_path}/a.csv") == {}


def test_written_tables_are_removed(spark, tmp_path):
    from pathlib import Path

    from tablemill.functions import storage

    df = storage.materialize(spark.range(3), "kept")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 3 and folder.exists()
    assert storage.remove_written(spark) >= 1 and not folder.exists()
    assert storage.remove_written(spark) == 0
