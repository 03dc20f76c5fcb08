"""Many CSV files in one plan, with the columns of each file where its own header puts them."""

import pathlib

import pytest

from riskloom.operators import cleaning
from riskloom.sources import files


def write(folder, name, *lines):
    pathlib.Path(folder, name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_headers_are_data(spark, tmp_path):
    write(tmp_path, "b.csv", "amount,TransactionID", "7,9", "", '"1,5",10')
    write(tmp_path, "a.csv", "TransactionID,name Orig,amount", "1, x ,NA", '2,"say ""hi""",3.5', "3,null")
    write(tmp_path, "c.csv", "TransactionID,amount")
    pathlib.Path(tmp_path, "d.csv").write_text("")
    got = cleaning.union_files(files.read_lines(spark, str(tmp_path))).orderBy("source_file", "source_row_number")
    assert got.columns == ["source_row_number", "source_file", "source_file_row_number", "transaction_id", "name_orig", "amount"]
    rows = [tuple(r) for r in got.collect()]
    assert [(r[1], r[0], r[3], r[5]) for r in rows] == [("a.csv", 1, "1", None), ("a.csv", 2, "2", "3.5"), ("a.csv", 3, "3", None), ("b.csv", 1, "9", "7"), ("b.csv", 2, "10", "1,5")]
    assert rows[0][4] == " x " and rows[2][4] is None and rows[3][4] is None


def test_same_rows_as_one_branch_per_file(spark, tmp_path):
    for i in range(6):
        head = "TransactionID,amount,type" if i % 2 else "type,TransactionID,amount"
        write(tmp_path, f"f{i}.csv", head, *[f"{i}{k},{k}.5,t{k}" if i % 2 else f"t{k},{i}{k},{k}.5" for k in range(50)])
    lines = files.read_lines(spark, str(tmp_path))
    frames = {f"f{i}.csv": files.read_raw_csv(spark, f"{tmp_path}/f{i}.csv", positions=True) for i in range(6)}
    want = cleaning.union_sources(frames, files.FILE_POSITION)
    got = cleaning.union_files(lines).select(*want.columns)
    key = lambda r: (r.source_file, r.source_row_number)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_plan_does_not_grow_with_the_files(spark, tmp_path):
    size = {}
    for n in (2, 60):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            write(folder, f"f{i}.csv", "TransactionID,amount" if i % 2 else "amount,TransactionID", "1,2")
        plan = cleaning.union_files(files.read_lines(spark, str(folder)))._jdf.queryExecution().analyzed().toString()
        size[n] = len(plan.splitlines())
    assert size[2] == size[60]


def test_no_files(spark, tmp_path):
    pathlib.Path(tmp_path, "a.csv").write_text("")
    with pytest.raises(ValueError):
        cleaning.union_files(files.read_lines(spark, str(tmp_path)))
