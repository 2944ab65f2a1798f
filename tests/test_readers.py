"""Real files: decoded names, path identity, per-file guards, sinks."""

import os

from tallyspark.plans import sinks
from tallyspark.sources import workbook as wbk
from tallyspark.sources.lines import read_lines
from tallyspark.plans.reconcile import reconcile
from tallyspark.sources.piles import pile_files, read_pile
from tallyspark.streaming import landing as ld

HDR = ["Card", "Operation Number", "Original Amount"]


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(text if isinstance(text, bytes) else text.encode())


def test_csv_names_and_guards(spark, tmp_path):
    head = ",".join(HDR)
    put(f"{tmp_path}/m2d-recu 01.02.2026.csv", f"{head}\nA,1,$5.00\n ,,\nB+,2%20,x\n")
    put(f"{tmp_path}/m2d-recu 100%+ 02.02.2026.csv", "Operation Number,Extra,Card,Original Amount\n3,e,C,7\n")
    put(f"{tmp_path}/m2d-recu wrong.csv", "Wrong,Other\n1,2\n")
    put(f"{tmp_path}/m2d-recu noamount.csv", "Card,Operation Number\n1,2\n")
    put(f"{tmp_path}/m6d-dev 01.02.2026.csv", f"{head}\nZ,9,1\n")
    put(f"{tmp_path}/sub/m2d-recu 01.02.2026.csv", f"{head}\nS,4,2\n")
    rows, errors = read_pile(spark, str(tmp_path), "m2d-recu", fmt="csv")
    got = sorted((r["Card"], r["Operation Number"], r["Amt_Float"], r["source_file"], r["Accounting_Ref"])
                 for r in rows.collect())
    assert got == [("A", "1", 5.0, "m2d-recu 01.02.2026.csv", "M2D-RECU 01.02.2026"),
                   ("B+", "2%20", 0.0, "m2d-recu 01.02.2026.csv", "M2D-RECU 01.02.2026"),
                   ("C", "3", 7.0, "m2d-recu 100%+ 02.02.2026.csv", "M2D-RECU 02.02.2026")]
    assert sorted((r["file"], r["reason"]) for r in errors.collect()) == [
        ("m2d-recu noamount.csv", "missing_amount"), ("m2d-recu wrong.csv", "missing_key_columns")]
    both, _ = read_pile(spark, str(tmp_path), "m2d-recu", fmt="csv", recursive=True)
    assert both.where("source_file = 'm2d-recu 01.02.2026.csv'").count() == 3
    old, _ = read_pile(spark, str(tmp_path), "m6d", match="prefix", fmt="csv", clean="minimal")
    assert [(r["Card"], r["Origin_File"]) for r in old.collect()] == [("Z", "m6d-dev 01.02.2026.csv")]


def test_files_without_rows_are_part_of_a_pile(spark, tmp_path):
    """Two header-only files are copies of each other, and block a run."""
    head = ",".join(HDR)
    put(f"{tmp_path}/m2d-recu 1.csv", f"{head}\n1,2,3\n")
    put(f"{tmp_path}/m2d-recu 2.csv", f"{head}\n")
    put(f"{tmp_path}/m2d-recu 3.csv", head)
    put(f"{tmp_path}/m6d-dev 1.csv", f"{head}\n1,2,3\n")
    put(f"{tmp_path}/m6d-dev 2.csv", "")
    debt, credit = (read_pile(spark, str(tmp_path), k, fmt="csv")[0] for k in ("m2d-recu", "m6d-dev"))
    files = pile_files(spark, str(tmp_path), "m2d-recu", debt)
    assert sorted(map(tuple, files.collect())) == [("m2d-recu 1.csv", 1), ("m2d-recu 2.csv", 0), ("m2d-recu 3.csv", 0)]
    res = reconcile(debt, credit, debt_files=files, credit_files=pile_files(spark, str(tmp_path), "m6d-dev", credit))
    assert res.status() == "INTRA_PILE_DUPLICATES" and res.by_debt is None
    found = res.issues.where("gate = 'G1'").collect()
    assert [(r["check"], r["subject"], r["n"]) for r in found] == [
        ("intra_pile_duplicate", "m2d-recu 2.csv <> m2d-recu 3.csv", 0)]


def csv_cells(spark, folder, **options):
    rows, errors = read_pile(spark, str(folder), "m2d", fmt="csv", clean="minimal", options=options)
    return (sorted((r["Origin_File"], r["Card"], r["Operation Number"], r["Original Amount"]) for r in rows.collect()),
            sorted((r["file"], r["reason"]) for r in errors.collect()))


def test_csv_records_reach_over_lines_and_splits(spark, tmp_path):
    """Random cells with line ends, quotes, separators and stray quotes, read in
    splits of a few bytes."""
    import csv
    import io
    import random
    rnd = random.Random(4)
    want = []
    for f in range(2):
        name = f"m2d-recu {f}.csv"
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n", quoting=[csv.QUOTE_MINIMAL, csv.QUOTE_ALL][f % 2])
        writer.writerow([*HDR, "Note"])
        for i in range(60):
            note = rnd.choice(["", "plain", "two\nlines", 'say ""', "a,b\n\n,c", '"\n"', "\n", 'x"y', "é\n中", "\n" * 5])
            op = rnd.choice([f"o{i}", f"o\n{i}", f'"o{i}"'])
            writer.writerow([f"c{i}", op, str(i), note])
            want.append((name, f"c{i}", op, str(i)))
        put(f"{tmp_path}/{name}", out.getvalue())
    # quotes that open no cell stay text
    put(f"{tmp_path}/m2d-recu stray.csv", ",".join(HDR) + '\n5" pipe,1,2\nx,6" pipe,"3"\n')
    want += [("m2d-recu stray.csv", '5" pipe', "1", "2"), ("m2d-recu stray.csv", "x", '6" pipe', "3")]
    put(f"{tmp_path}/m2d-recu open.csv", ",".join(HDR) + '\n1,2,3\n4,"5,6\n7,8,9\n')
    for size in (None, "150"):
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got, errors = csv_cells(spark, tmp_path, escape='"')
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == sorted(want), size
        assert errors == [("m2d-recu open.csv", "unclosed_quote")]


def test_csv_separators_are_literal(spark, tmp_path):
    put(f"{tmp_path}/m2d 1.csv", "|".join(HDR) + '\n1|"a|b\nc"|3\n')
    put(f"{tmp_path}/m2d 2.csv", "Extra|" + "|".join(HDR) + "\n\ne|4|5|6|7|8\n")
    assert csv_cells(spark, tmp_path, sep="|") == (
        [("m2d 1.csv", "1", "a|b\nc", "3"), ("m2d 2.csv", "4", "5", "6")], [])


def test_corrupt_parquet_is_an_error_row(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2", "3")], ", ".join(f"`{h}` string" for h in HDR))
    rows.toPandas().to_parquet(f"{tmp_path}/m2d-recu 1.1.2026.parquet")
    put(f"{tmp_path}/m2d-recu 2.1.2026.parquet", b"PAR1 no parquet PAR1")
    got, errors = read_pile(spark, str(tmp_path), "m2d-recu")
    assert got.count() == 1
    assert [(r["file"], r["reason"]) for r in errors.collect()] == [("m2d-recu 2.1.2026.parquet", "unreadable")]


def test_workbook_piles_in_one_folder(spark, tmp_path):
    put(f"{tmp_path}/m2d-recu 1.1.2026.xlsx", wbk.workbook_bytes(HDR + ["D"], [["1", "2", "3", "d"]]))
    put(f"{tmp_path}/m6d-dev 1.1.2026.xlsx", wbk.workbook_bytes(HDR + ["C"], [["1", "2", "3", "c"]]))
    put(f"{tmp_path}/m6d-dev broken.xlsx", b"x")
    debt, debt_errors = read_pile(spark, str(tmp_path), "m2d-recu", fmt="xlsx")
    credit, credit_errors = read_pile(spark, str(tmp_path), "m6d-dev", fmt="xlsx")
    assert "D" in debt.columns and "C" not in debt.columns and debt_errors.count() == 0
    assert "C" in credit.columns and credit_errors.count() == 1
    none, _ = read_pile(spark, str(tmp_path), "absent", fmt="xlsx")
    assert none.count() == 0 and {*HDR} <= {*none.columns}


def test_numeric_cells_are_plain_text():
    cells = {"1234.0": "1234", "1.2345678901234567E+19": "12345678901234567000", "12": "12", "0.1": "0.1",
             "1e-7": "0.0000001", "-5.50": "-5.5", "4.111111111111111E+15": "4111111111111111"}
    assert {v: wbk._number_text(v) for v in cells} == cells


def test_reports_with_one_name_stay_apart(spark, tmp_path):
    put(f"{tmp_path}/x/r.txt", "a\nb\n")
    put(f"{tmp_path}/y/r.txt", "c\n")
    rows = read_lines(spark, str(tmp_path), recursive=True).collect()
    assert sorted((r["file"], r["value"]) for r in rows) == [("x/r.txt", "a"), ("x/r.txt", "b"), ("y/r.txt", "c")]


def test_landing_keeps_files_of_one_name(spark, tmp_path):
    drop, dest, man = (str(tmp_path / x) for x in ("drop", "dest", "manifest"))
    put(f"{drop}/x/t.csv", "k,v\n1,a\n")
    put(f"{drop}/y/t.csv", "k,v\n2,b\n")
    assert ld.land_latest(spark, drop, dest, man, "csv", "*.csv", {"header": "true"}) == 2
    put(f"{drop}/x/t.csv", "k,v\n3,cc\n")
    assert ld.land_latest(spark, drop, dest, man, "csv", "*.csv", {"header": "true"}) == 1
    got = sorted((r["source_name"], r["k"], r["v"]) for r in spark.read.parquet(dest).collect())
    assert got == [("x/t.csv", "3", "cc"), ("y/t.csv", "2", "b")]


def test_empty_results_leave_the_last_report(spark, tmp_path):
    path = str(tmp_path / "match")
    rows = spark.range(3)
    assert sinks.write_match(rows, path) == 3
    assert sinks.write_match(rows.where("id > 5"), path) == 0
    assert spark.read.parquet(path).count() == 3
    assert sinks.write_linear(rows.where("id > 5"), str(tmp_path / "linear")) == 0
    assert not (tmp_path / "linear").exists()
    assert sinks.write_match(rows.where("id > 0"), path) == 2
    assert spark.read.parquet(path).count() == 2
    assert list(sinks.write_report(None, None, rows, str(tmp_path / "report"))) == ["Detailed_Audit_Log"]


def test_csv_lines_are_written_once(spark, tmp_path, monkeypatch):
    """Lines that are records already are not written again; what is read of the
    files' first records is, as the names, the errors and the rows need it."""
    from tallyspark.sources import piles
    put(tmp_path / "m2d-recu a.csv", "Card,Operation Number,Original Amount\n1,2,3\n")
    put(tmp_path / "m2d-recu b.csv", "Original Amount,Card,Operation Number\n6,4,5\n")
    put(tmp_path / "m2d-recu c.csv", "Card,Original Amount\n7,8\n")
    written, cut = [], piles.cut_lineage
    monkeypatch.setattr(piles, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    rows, errors = read_pile(spark, str(tmp_path), "m2d-recu", fmt="csv")
    assert sorted((r["Card"], r["Operation Number"], r["Original Amount"]) for r in rows.collect()) == [
        ("1", "2", "3"), ("4", "5", "6")]
    assert [(r["file"], r["reason"]) for r in errors.collect()] == [("m2d-recu c.csv", "missing_key_columns")]
    assert written == [["path", "block", "row", "value", "open_out", "open_in"], ["path", "value", "at"]]


def test_records_are_found_over_small_windows(spark, monkeypatch):
    """A window holds a part of a split, not all its lines, and gives the same
    records: cells open over many parts, quotes in text, a file left open."""
    import random

    from tallyspark.sources import records as rec
    rnd = random.Random(13)
    rows = []
    for path in ("a", "b", "c"):
        for row in range(300):
            rows.append((path, row // 120, row + (row // 120 << 33), rnd.choice(
                ['"x","y"', '"x","open', 'more text', 'closed","z"', '"q ""z"" ","', '', 'plain,1', '"","'])))
    df = spark.createDataFrame(rows, "path string, block long, row long, value string")
    out, within = rec.open_after(df["value"])
    df = df.withColumns({"open_out": out, "open_in": within})

    def found():
        text, unclosed = rec.records(df)
        return sorted(map(tuple, text.select("path", "block", "row", "value").collect())), sorted(map(tuple, unclosed.collect()))

    want = found()
    assert len(want[0]) > 50 and any("\n" in r[3] for r in want[0])
    for bits in (1, 4):
        monkeypatch.setattr(rec, "CHUNK_BITS", bits)
        assert found() == want
