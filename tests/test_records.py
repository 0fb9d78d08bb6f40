import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from hazardflow.plans import flows
from hazardflow.schema import EXTRA_CELL, FILE_KEY, REQUIRED
from hazardflow.sources import readers, records, writers


def small_splits(spark, size):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


def random_table(rng, rows):
    """Cells with quotes, commas and line breaks, some lines blank; what a reader that sees all makes of them."""
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    write.writerow(["a\nb", "c", "d"])
    for _ in range(rows):
        write.writerow([rng.choice(["x", "", 'q"u', "l\nm", '"\n"', ",", "\n\n,", "end "]) * rng.randint(1, 3) for _ in range(3)])
        if rng.random() < 0.2:
            out.write(rng.choice(["\n", "  \n", 'r 5" wide,b"c,d"e\n']))
    return out.getvalue()


@pytest.mark.parametrize("size", [64, 300, 100_000])
def test_splits_give_the_records_of_one_reader(spark, tmp_path, size):
    rng, want = random.Random(size), set()
    for i in range(3):
        text = random_table(rng, 120)
        (tmp_path / f"f{i}.csv").write_text(text)
        table = [r for r in csv.reader(io.StringIO(text, newline="")) if len(r) > 1 or (r and r[0].strip())]
        assert table[0] == ["a\nb", "c", "d"]
        want |= {(i, n, tuple(c or None for c in r)) for n, r in enumerate(sorted(table[1:]))}
    rows, files = readers.read_csv_files(small_splits(spark, size), str(tmp_path), null_tokens=[""])
    assert {tuple(r["columns"]) for r in files.collect()} == {("a\nb", "c", "d")}
    got = {}
    for r in rows.collect():
        got.setdefault(int(r[FILE_KEY][-5]), []).append((r["a\nb"] or "", r["c"] or "", r["d"] or ""))
    found = {(i, n, tuple(c or None for c in row)) for i, own in got.items() for n, row in enumerate(sorted(own))}
    assert found == want


def test_files_beside_others_keep_all_rows(spark, tmp_path):
    """Spark cuts one file alone finer than the same file among others; no row may be lost by that."""
    quoted = "a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(9000))
    (tmp_path / "quoted.csv").write_text(quoted)
    (tmp_path / "plain.csv").write_text("a,b\n" + "1,2\n" * 200_000)
    session = spark.newSession()
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    rows, _ = readers.read_csv_files(session, str(tmp_path))
    assert {r[0]: r[1] for r in rows.groupBy("b").count().collect()} == {"x\ny": 9000, "2": 200_000}
    assert rows.where("b <> '2'").select("a").distinct().count() == 9000


def test_a_split_without_a_start_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + '1,"x\ny"\n' * 40)
    paths = [str(tmp_path / "a.csv")]
    splits = records.with_starts(records.split_states(records.lines_of(small_splits(spark, 50), paths)))
    with pytest.raises(Exception, match="a split of unknown start"):
        records.cut_records(records.lines_of(small_splits(spark, 64), paths), splits).collect()


def test_split_states(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h,i\n1,"x\n' + "inside\n" * 40 + 'y"\n2,3\n')
    session = small_splits(spark, 50)
    splits = records.with_starts(records.split_states(records.lines_of(session, [str(tmp_path / "a.csv")]))).orderBy("block").collect()
    assert len(splits) > 4 and splits[0].head == "h,i" and not splits[0].starts_inside
    assert [s.starts_inside for s in splits[1:-1]] == [True] * (len(splits) - 2) and not splits[-1].ends_inside


def test_files_that_pandas_reads(spark, tmp_path):
    for name, text in {
        "blank.csv": "\n  \na,b\n1,2\n",
        "head.csv": '"a\nb",c\n1,2\n',
        "open.csv": 'a,b\n1,"2\n3,4\n',
        "bare.csv": 'a,b\n5" pipe,x"y"\n',
        "blanks.csv": "\n\n",
        "crlf.csv": 'a,b\r\n1,"x\r\ny"\r\n',
        "bom.csv": "﻿a,b\n7,8\n",
    }.items():
        (tmp_path / name).write_text(text, newline="")
    rows, files = readers.read_csv_files(spark, str(tmp_path))
    table = {r["path"].rsplit("/", 1)[1]: r for r in files.collect()}
    assert table["blank.csv"]["columns"] == ["a", "b"] == table["bom.csv"]["columns"]
    assert table["head.csv"]["columns"] == ["a\nb", "c"]
    assert table["open.csv"].error == "EOF inside a quoted cell" and table["blanks.csv"].error == "No columns to parse from file"
    got = {(r[FILE_KEY].rsplit("/", 1)[1], r["a"], r["b"], r["a\nb"], r["c"]) for r in rows.collect()}
    assert got == {
        ("blank.csv", "1", "2", None, None), ("head.csv", None, None, "1", "2"), ("bare.csv", '5" pipe', 'x"y"', None, None),
        ("crlf.csv", "1", "x\ny", None, None), ("bom.csv", "7", "8", None, None),
    }


def test_many_headers_in_one_scan(spark, tmp_path):
    for i in range(120):
        names = [f"c{(i + j) % 40}" for j in range(2 + i % 5)]
        (tmp_path / f"{i:03}.csv").write_text(",".join(names) + "\n" + ",".join(f"{i}-{n}" for n in names) + "\n")
    rows, files = readers.read_csv_files(spark, str(tmp_path))
    assert len(rows.columns) == 40 + 2 and rows.where(f"{EXTRA_CELL} IS NOT NULL").count() == 0
    for r in rows.collect():
        i = int(r[FILE_KEY][-7:-4])
        assert {n: r[n] for n in rows.columns[:40] if r[n]} == {f"c{(i + j) % 40}": f"{i}-c{(i + j) % 40}" for j in range(2 + i % 5)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("csv") + plan.count("CSV") <= 2  # not one scan per header


def test_equal_stems_stay_apart(spark, tmp_path):
    for folder, text in (("x", "a\n1\n"), ("y", "a\n2\n3\n")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "a.csv").write_text(text)
    (tmp_path / "in" / "x" / "a.CSV").write_text("b\n4\n")
    rows, files = readers.read_csv_files(spark, str(tmp_path / "in" / "*"))
    out = writers.write_clean(rows.drop(EXTRA_CELL), str(tmp_path / "out"), "r", files=files).collect()
    assert len(out) == 3 and all(r.output_name.startswith("a_preprocessed_r_") for r in out)
    back, _ = readers.read_csv_files(spark, str(tmp_path / "out/layout=*/output_name=*"))
    assert sorted(map(str, [(r["a"], r["b"]) for r in back.collect()])) == sorted(map(str, [("1", None), ("2", None), ("3", None), (None, "4")]))


def test_ingest_where_no_row_survives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "long.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "in" / "head.csv").write_text(",".join(REQUIRED) + "\n")
    out = flows.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), "r", "2024-01-01 00:00:00")
    stages = {r[FILE_KEY].rsplit("/", 1)[1]: r for r in out["stages"].collect()}
    assert stages["long.csv"].status == "error" and stages["long.csv"].points is None
    assert (stages["head.csv"].rows_after, stages["head.csv"].points, stages["head.csv"].storage_status) == (0, 0, "success")
    row = out["summary"].first()
    assert (row.files_found, row.files_stored, row.success_rate) == (2, 1, 50.0) and out["outputs"].count() == 0


def test_cells_whose_text_is_no_number_are_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Duration_days,note\n1,x\nabc,y\nNA,z\nabc,y\n")
    out = flows.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), "r", "2024-01-01 00:00:00")
    assert out["stats"].agg(F.sum("coerced")).first()[0] == 2
