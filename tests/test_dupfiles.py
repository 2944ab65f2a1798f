"""Duplicate / look-alike files (reference tests T:238-444) and a
brute-force check of the scalable pair detection."""

import random
from collections import Counter

from conftest import pile
from tallyspark.operators import dupfiles as dfl

COLS = ("Card", "Operation Number", "Amt_Float", "Accounting_Ref", "source_file")


def verdicts(spark, rows):
    df = pile(spark, rows, COLS)
    return sorted((r["file1"], r["file2"], r["verdict"], r["overlap_pct"]) for r in dfl.file_pairs(df).collect())


def test_identical_files(spark):
    rows = [("1234", "OP-001", 100.0, "R", "a"), ("5678", "OP-002", 200.0, "R", "a"),
            ("1234", "OP-001", 100.0, "R2", "b"), ("5678", "OP-002", 200.0, "R2", "b")]
    assert verdicts(spark, rows) == [("a", "b", "DUPLICATE", 100.0)]


def test_same_keys_other_amounts(spark):
    rows = [("1234", "OP-001", 100.0, "R", "a"), ("5678", "OP-002", 200.0, "R", "a"),
            ("1234", "OP-001", 150.0, "R", "b"), ("5678", "OP-002", 250.0, "R", "b")]
    assert verdicts(spark, rows) == [("a", "b", "SUSPICIOUS", 100.0)]


def test_eighty_percent_is_not_a_warning(spark):
    k1 = [("1234", "OP-001"), ("5678", "OP-002"), ("9999", "OP-003"), ("8888", "OP-004"), ("7777", "OP-005")]
    k2 = k1[:4] + [("XXXX", "OP-999")]
    rows = [(c, o, 1.0, "R", "a") for c, o in k1] + [(c, o, 1.0, "R", "b") for c, o in k2]
    assert verdicts(spark, rows) == []


def test_different_row_counts_never_compared(spark):
    rows = [("1", "A", 1.0, "R", "a"), ("2", "B", 1.0, "R", "a"), ("3", "C", 1.0, "R", "a"),
            ("1", "A", 1.0, "R", "b"), ("2", "B", 1.0, "R", "b")]
    assert verdicts(spark, rows) == []


def brute(rows):
    files = sorted({r[4] for r in rows})
    by = {f: [r for r in rows if r[4] == f] for f in files}
    out = []
    for i, a in enumerate(files):
        for b in files[i + 1:]:
            ra, rb = by[a], by[b]
            if len(ra) != len(rb):
                continue
            ka, kb = {(r[0], r[1]) for r in ra}, {(r[0], r[1]) for r in rb}
            if ka == kb:
                same = Counter((r[0], r[1], r[2]) for r in ra) == Counter((r[0], r[1], r[2]) for r in rb)
                out.append((a, b, "DUPLICATE" if same else "SUSPICIOUS"))
            elif len(ka & kb) / max(len(ka), 1) * 100 > 90:
                out.append((a, b, "WARNING", round(len(ka & kb) / max(len(ka), 1) * 100, 6)))
    return out


def test_pairs_match_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    base = [(str(rnd.randint(1, 40)), f"OP-{rnd.randint(1, 40)}", float(rnd.randint(1, 9))) for _ in range(30)]
    for f in range(8):
        kind = f % 4
        for i, (c, o, a) in enumerate(base):
            if kind == 1:
                a = a + 1
            if kind == 2 and i == 0:
                o = o + "W"  # 1 of ~30 keys renamed -> > 90 % overlap
            if kind == 3 and i < 10:
                c = None if i == 0 else c + "Z"
            rows.append((c, o, a, "R", f"file{f}"))
    for f in range(3):  # unrelated files of the same size
        rows += [(str(rnd.randint(100, 200)), str(i), 1.0, "R", f"other{f}") for i in range(30)]
    got = dfl.file_pairs(pile(spark, rows, COLS)).collect()
    got_pairs = {(r["file1"], r["file2"], r["verdict"]) for r in got}
    want = brute(rows)
    # duplicates / suspicious pairs: same classes (edges to the class representative)
    want_dup = {frozenset((a, b)) for a, b, *v in want if v[0] == "DUPLICATE"}
    got_dup = {frozenset((a, b)) for a, b, v in got_pairs if v == "DUPLICATE"}
    closure = set()
    for p in got_dup:
        closure.add(p)
    for p in list(closure):  # two edges to one representative imply the third pair
        for q in list(closure):
            if p != q and p & q:
                closure.add(frozenset(p ^ q))
    assert closure == want_dup
    # WARNING rows: first and last file of the brute-force pairs of two classes
    keys = {f: frozenset((r[0], r[1]) for r in rows if r[4] == f) for f in {r[4] for r in rows}}
    ends = {}
    for a, b, *v in want:
        if v[0] == "WARNING":
            first, last = ends.get((keys[a], keys[b]), (a, b))
            ends[keys[a], keys[b]] = (min(first, a), max(last, b))
    got_warn = {(a, b) for a, b, v in got_pairs if v == "WARNING"}
    assert ends and got_warn == set(ends.values())


def test_overlap_of_the_file_that_comes_first(spark):
    """a1 and z1 hold 20 keys, b1 18 of them twice over: only with b1 first do
    the shared keys pass."""
    twenty = [(str(i), "op") for i in range(20)]
    rows = [(c, o, 1.0, "R", f) for f in ("a1", "z1") for c, o in twenty]
    rows += [(c, o, 1.0, "R", "b1") for c, o in twenty[:18] + twenty[:2]]
    assert verdicts(spark, rows) == [("a1", "z1", "DUPLICATE", 100.0), ("b1", "z1", "WARNING", 100.0)]


def test_cross_checks_flag_a_pile_against_itself(spark):
    rows = [("1234", "OP-001", 100.0, "M2D-RECU 1", "a"), ("5678", "OP-002", 200.0, "M2D-RECU 1", "a")]
    d = pile(spark, rows, COLS)
    cc = dfl.cross_checks(d, d)
    assert cc["exact"].collect()[0]["exact_match"]
    assert cc["overlap"].collect()[0]["flagged"]
    assert cc["fingerprint"].collect()[0]["flagged"]
    assert cc["types"].collect()[0]["flagged"]
    other = pile(spark, [("9999", "OP-099", 500.0, "M6D-DEV 2", "b"), ("8888", "OP-098", 600.0, "M6D-DEV 2", "b")],
                 COLS)
    cc = dfl.cross_checks(d, other)
    assert not any(cc[k].collect()[0][f] for k, f in (("exact", "exact_match"), ("overlap", "flagged"),
                                                      ("fingerprint", "flagged"), ("types", "flagged")))


def test_two_empty_files_are_duplicates(spark):
    rows = [("1", "A", 1.0, "R", "a"), ("2", "B", 1.0, "R", "b")]
    empty = spark.createDataFrame([("e1",), ("e2",), ("a",)], "f string")
    got = dfl.file_pairs(pile(spark, rows, COLS), empty_files=empty).collect()
    assert sorted((r["file1"], r["file2"], r["verdict"], r["n_rows"]) for r in got) == [("e1", "e2", "DUPLICATE", 0)]


def clusters(spark, rows):
    return {r["file"]: (r["cluster"], r["n_files"]) for r in dfl.file_clusters(pile(spark, rows, COLS)).collect()}


def groups_of(files, pairs):
    """{file: (first file of its group, size)} of the files that are in a pair."""
    root = {f: f for f in files}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    size = Counter(find(f) for f in files)
    return {f: (find(f), size[find(f)]) for f in files if size[find(f)] > 1}


def test_clusters_match_brute_force(spark):
    rnd = random.Random(12)
    rows = []
    for family in range(6):  # chains: each file is the one before with a few keys renamed
        now = [(f"c{rnd.randint(1, 30)}", f"OP-{family if rnd.random() < 0.9 else 'x'}-{i}") for i in range(25)]
        for f in range(rnd.randint(1, 7)):
            for i in rnd.sample(range(25), rnd.randint(0, 3)):
                now[i] = (now[i][0], f"{now[i][1]}{f}")
            rows += [(c, o, 1.0, "R", f"f{rnd.randint(0, 9)}-{family}-{f}-{len(now)}") for c, o in now[:1]]
            name = f"{rnd.choice('abcz')}{family}{f}"
            rows += [(c, o, 1.0, "R", name) for c, o in now]
    files = {r[4] for r in rows}
    want = groups_of(files, [(a, b) for a, b, *_ in brute(rows)])
    assert len(want) > 8 and clusters(spark, rows) == want


def test_a_cluster_of_a_thousand_files_is_linear(spark, monkeypatch):
    """Every two of them overlap by more than 90 %, and all differ."""
    n, keys = 1000, 30
    rows = [("c", f"OP-{i}" if i != f % keys else f"OP-{i}-{f}", 1.0, "R", f"f{f:04d}")
            for f in range(n) for i in range(keys)]
    compared = []
    plain = dfl.exact_overlap

    def counted(cand, *rest):
        compared.append(cand.count())
        return plain(cand, *rest)

    monkeypatch.setattr(dfl, "exact_overlap", counted)
    got = clusters(spark, rows)
    assert got == {f"f{f:04d}": ("f0000", n) for f in range(n)}
    assert 0 < sum(compared) <= 12 * n


def test_only_keys_of_comparable_files_are_scored(spark, monkeypatch):
    """A file whose row count no other file has is compared with none."""
    rows = [(str(i), f"o{i}", 1.0, "R", f) for f, n in (("a", 21), ("b", 30), ("c", 30), ("d", 12)) for i in range(n)]
    rows[-13] = ("x", "y", 1.0, "R", "c")
    seen, candidates = [], dfl.overlap_candidates

    def recorded(fk, *args):
        seen.extend(r[0] for r in fk.select("source_file").distinct().collect())
        return candidates(fk, *args)

    monkeypatch.setattr(dfl, "overlap_candidates", recorded)
    assert verdicts(spark, rows) == [("b", "c", "WARNING", round(100 * 29 / 30, 6))]
    assert sorted(seen) == ["b", "c"]
