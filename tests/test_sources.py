"""Workbook piles, drop-folder inventory and landing."""

import os
import time

from tallyspark.sources import workbook as wbk
from tallyspark.sources.inventory import first_names, inventory
from tallyspark.sources.piles import read_pile
from tallyspark.streaming import landing as ld

HDR = ["Card", "Operation Number", "Original Amount"]


def put(path, data):
    with open(path, "wb") as fh:
        fh.write(data)


def test_workbook_pile_isolates_bad_files(spark, tmp_path):
    d = tmp_path / "wb"
    d.mkdir()
    put(d / "m2d-recu 01.01.2026.xlsx", wbk.workbook_bytes(HDR + ["Extra"], [
        ["  1234  ", "OP-001", "$1,234.56", "x"], ["5678", "OP-002\n", "invalid", None],
        [None, None, None, None], ["   ", "", "1", None]]))
    put(d / "M2D-RECU 02.01.2026.xlsx", wbk.workbook_bytes(["Wrong_Column", "Original Amount"], [["a", "1"]]))
    put(d / "m2d-recu 03.01.2026.xlsx", wbk.workbook_bytes(["Card", "Operation Number"], [["1", "2"]]))
    put(d / "m2d-recu broken.xlsx", b"not a zip")
    put(d / "m6d-dev 01.01.2026.xlsx", wbk.workbook_bytes(HDR, [["9", "OP-9", "1"]]))
    rows, errors = read_pile(spark, str(d), "m2d-recu", fmt="xlsx")
    got = sorted((r["Card"], r["Operation Number"], r["Amt_Float"], r["Accounting_Ref"], r["Extra"])
                 for r in rows.collect())
    assert got == [("1234", "OP-001", 1234.56, "M2D-RECU 01.01.2026", "x"),
                   ("5678", "OP-002", 0.0, "M2D-RECU 01.01.2026", None)]
    reasons = {(r["file"], r["reason"]) for r in errors.collect()}
    assert reasons == {("M2D-RECU 02.01.2026.xlsx", "missing_key_columns"),
                       ("m2d-recu 03.01.2026.xlsx", "missing_amount"),
                       ("m2d-recu broken.xlsx", "unreadable")}


def test_long_ids_stay_text(spark, tmp_path):
    d = tmp_path / "ids"
    d.mkdir()
    put(d / "m2d-recu 1.1.1.xlsx", wbk.workbook_bytes(HDR, [["12345678901234567890", "0007", "1"]]))
    rows, _ = read_pile(spark, str(d), "m2d-recu", fmt="xlsx")
    r = rows.collect()[0]
    assert (r["Card"], r["Operation Number"]) == ("12345678901234567890", "0007")


def test_inventory_and_first_names(spark, tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    for i in range(12):
        put(d / f"f{i:02d}.csv", b"a\n1\n")
    inv = inventory(spark, str(d), "*.csv")
    assert inv.count() == 12
    assert [r["name"] for r in first_names(inv).collect()] == [f"f{i:02d}.csv" for i in range(10)]


def test_land_latest_replaces_redropped_file(spark, tmp_path):
    drop, dest, man = (str(tmp_path / x) for x in ("drop", "dest", "manifest"))
    os.makedirs(drop)
    put(os.path.join(drop, "target.csv"), b"k,v\n1,a\n2,b\n")
    put(os.path.join(drop, "other.csv"), b"k,v\n9,z\n")
    opts = {"header": "true"}
    assert ld.land_latest(spark, drop, dest, man, "csv", "*.csv", opts) == 2
    assert ld.land_latest(spark, drop, dest, man, "csv", "*.csv", opts) == 0
    time.sleep(1.1)
    put(os.path.join(drop, "target.csv"), b"k,v\n3,c\n")
    assert ld.land_latest(spark, drop, dest, man, "csv", "*.csv", opts) == 1
    got = sorted((r["source_name"], r["k"], r["v"]) for r in spark.read.parquet(dest).collect())
    assert got == [("other.csv", "9", "z"), ("target.csv", "3", "c")]


def test_land_stream_versioned_names(spark, tmp_path):
    drop, dest, ck = (str(tmp_path / x) for x in ("drop", "dest", "ck"))
    os.makedirs(drop)
    put(os.path.join(drop, "report_v1.csv"), b"k,v\n1,a\n")
    schema = "k string, v string"
    ld.land_stream(spark, drop, dest, ck, schema, "csv", "*.csv", {"header": "true"})
    put(os.path.join(drop, "report_v2.csv"), b"k,v\n2,b\n")
    ld.land_stream(spark, drop, dest, ck, schema, "csv", "*.csv", {"header": "true"})
    got = sorted((r["source_name"], r["k"]) for r in spark.read.parquet(dest).collect())
    assert got == [("report_v1.csv", "1"), ("report_v2.csv", "2")]


def test_workbooks_are_written_and_read_in_passing(spark, tmp_path):
    rows = [(f"{i}", None if i % 7 == 0 else f"<{i}> & co", f"${i}.50", f"m2d-recu {i % 3}.xlsx") for i in range(500)]
    pile = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in [*HDR, "source_file"]))
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("64", "-1")):
        spark.conf.set(n, v)
    try:
        written = wbk.write_workbooks(pile, str(tmp_path / "wb"), HDR)
        plan = written._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan  # no file's rows are held at once
        assert sorted(written.collect()) == [(f"m2d-recu {k}.xlsx", len(range(k, 500, 3))) for k in range(3)]
        got, errors = wbk.read_workbooks(spark, str(tmp_path / "wb"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan  # no file's rows meet in a task
        assert sorted(got.select(*HDR, "source_file").na.fill("").collect()) == sorted(
            (c, o or "", a, f) for c, o, a, f in rows)
        assert errors.count() == 0
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_batches_are_rendered_like_rows():
    import pyarrow as pa

    rows = [("1", None, "a&b"), (None, None, None), ("x<y>", "", " z ")]
    assert wbk._rows_xml(9, [pa.array(c, pa.string()) for c in zip(*rows)]) == "".join(
        wbk._row_xml(9 + i, r) for i, r in enumerate(rows))


def test_parsing_does_not_grow_with_the_sheet():
    import tracemalloc

    def peak(n):
        data = wbk.workbook_bytes(HDR, [[f"{i}", f"{i}-1", "$1.00"] for i in range(n)])
        tracemalloc.start()
        assert sum(1 for _ in wbk.parse_workbook(data)) == n + 1
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return most - len(data)

    small, large = peak(2000), peak(20000)
    assert large < 2 * small
