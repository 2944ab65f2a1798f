"""Files delivered twice or suspiciously alike (J6, A14) and cross-pile
checks (A12, A15, A16, A17).

Within a pile, only files with equal row counts are compared (as in the
reference). The verdict of a pair of files a < b (by name):

* DUPLICATE  - same key set and the same multiset of rows,
* SUSPICIOUS - same key set, rows differ,
* WARNING    - key sets differ and  |keys(a) & keys(b)| / |keys(a)| > 90 %.

Scale design (never all pairs of files, never all files per key):

1. Per-file fingerprints are plain distributed aggregates: row count,
   distinct-key count, and order-free sums of two independent 64/32-bit
   hashes over the distinct keys and over the rows (a multiset hash).
   Files with equal (n_rows, key fingerprint) form a *key class*; inside
   it, equal row fingerprints form a *row class*. A group of k copies is
   reported as k-1 edges to its representative (the smallest name), not
   k(k-1)/2 pairs.
2. WARNING pairs are a set-similarity join between key-class
   representatives, done with prefix filtering: keys are ordered
   rare-first (classes of global frequency, then hash); a pair can only
   reach the overlap threshold if a key among the first ~10 % of ``a``'s
   keys occurs in ``b``. A file's prefix ends with the first of a fixed set
   of score buckets at which its running key count reaches that length, so
   it is exact up to whole buckets. Candidates are then verified by counting
   their real overlap.
3. ``file_clusters`` gives the connected groups of these findings, one row
   per file. Each prefix key first proposes only the first and the last
   file that hold it; the links found this way join nearly all files of a
   cluster, and all pairs are compared only for keys that occur in several
   groups still apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import AMT, FILE, KEYS, REF, source_type
from tallyspark.operators.money import as_money
from tallyspark.operators.setops import rows_equal
from tallyspark.session import cut_lineage

FREQ_EXACT = 64    # frequencies below it are classes of their own
FREQ_STEPS = 8     # classes to a doubling above
HASH_BUCKETS = 256  # buckets of a frequency class


def _q(c: str) -> str:
    return f"`{c}`"


def _null_safe_hash(cols, fn):
    """Hash of a tuple that tells (x, null) from (null, x)."""
    args = []
    for c in cols:
        args += [F.col(_q(c)), F.col(_q(c)).isNull()]
    return fn(*args)


def _fp_sum(cols, fn, name):
    # sums of hashes as decimals: order-free and never overflow
    return F.sum(_null_safe_hash(cols, fn).cast("decimal(20,0)")).alias(name)


def narrow_pile(pile: DataFrame, keys=KEYS, file_col: str = FILE, exclude=(REF,)) -> DataFrame:
    """(file, keys, rh1, rh2): the only columns the pair check needs, with
    two independent hashes of each whole row (all columns but ``exclude``
    and the file)."""
    cmp_cols = [c for c in pile.columns if c not in set(exclude) | {file_col}]
    return pile.select(file_col, *[F.col(_q(k)) for k in keys],
                       _null_safe_hash(cmp_cols, F.xxhash64).alias("rh1"),
                       _null_safe_hash(cmp_cols, F.hash).alias("rh2"))


def file_fingerprints(narrow: DataFrame, keys=KEYS, file_col: str = FILE) -> DataFrame:
    """Per file: n_rows, n_keys and key / row multiset fingerprints
    (order-free sums of hashes, as decimals so they never overflow)."""
    rows = (narrow.groupBy(file_col)
                  .agg(F.count(F.lit(1)).alias("n_rows"),
                       F.sum(F.col("rh1").cast("decimal(20,0)")).alias("rfp1"),
                       F.sum(F.col("rh2").cast("decimal(20,0)")).alias("rfp2")))
    fk = narrow.select(file_col, *[F.col(_q(k)) for k in keys]).distinct()
    ks = (fk.groupBy(file_col)
            .agg(F.count(F.lit(1)).alias("n_keys"),
                 _fp_sum(keys, F.xxhash64, "kfp1"), _fp_sum(keys, F.hash, "kfp2")))
    return rows.join(ks, file_col)


def _classes(fp: DataFrame, file_col: str) -> DataFrame:
    kcls = ["n_rows", "n_keys", "kfp1", "kfp2"]
    rcls = kcls + ["rfp1", "rfp2"]
    krep = fp.groupBy(*kcls).agg(F.min(file_col).alias("key_rep"), F.max(file_col).alias("key_last"),
                                 F.count(F.lit(1)).alias("key_size"))
    rrep = fp.groupBy(*rcls).agg(F.min(file_col).alias("row_rep"))
    return fp.join(krep, kcls).join(rrep, rcls)


def _ns_cond(left: DataFrame, right: DataFrame, lk, rk):
    return reduce(lambda a, b: a & b, [left[_q(x)].eqNullSafe(right[_q(y)]) for x, y in zip(lk, rk)])


def _scored(fk: DataFrame, keys, file_col: str) -> DataFrame:
    """``fk`` with the score bucket of each key, rare keys first. All files order
    their keys by it; keys of one bucket count as one place."""
    kc = [F.col(_q(k)) for k in keys]
    freq = fk.groupBy(*kc).agg(F.count(F.lit(1)).alias("freq"))
    freq = freq.select(*[F.col(_q(k)).alias(f"__f_{k}") for k in keys], "freq")
    step = F.floor(F.lit(FREQ_STEPS) * F.log2(F.col("freq") / F.lit(FREQ_EXACT)))
    rare = F.when(F.col("freq") < FREQ_EXACT, F.col("freq")).otherwise(F.lit(FREQ_EXACT) + step).cast("int")
    bucket = rare * HASH_BUCKETS + F.pmod(_null_safe_hash(keys, F.xxhash64), F.lit(HASH_BUCKETS)).cast("int")
    return (fk.join(freq, _ns_cond(fk, freq, keys, [f"__f_{k}" for k in keys]))
              .select(file_col, *[fk[_q(k)] for k in keys], bucket.alias("bucket")))


def prefixes(fk: DataFrame, stats: DataFrame, keys=KEYS, file_col: str = FILE, min_pct: float = 90.0) -> DataFrame:
    """(a, n_rows, keys): of every file the keys one of which any file must
    hold that shares more than ``min_pct`` % of its keys. ``fk``: distinct
    (file, keys); ``stats``: (file, n_rows, n_keys)."""
    scored = _scored(fk, keys, file_col)
    # required overlap t = floor(min_pct/100 * n) (one below the strict bound:
    # a safe superset); prefix length n - t + 1
    st = stats.select(file_col, "n_rows", F.least(F.col("n_keys"), F.col("n_keys") - F.floor(
        F.col("n_keys") * F.lit(min_pct / 100.0)) + 1).alias("p"))
    # a file has at most some 10^5 buckets, however many keys
    held = scored.groupBy(file_col, "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(file_col).orderBy("bucket"))
    cut = (held.withColumn("upto", upto).join(st, file_col).where(F.col("upto") >= F.col("p"))
               .groupBy(file_col, "n_rows").agg(F.min("bucket").alias("last")))
    return (scored.join(cut, file_col).where(F.col("bucket") <= F.col("last"))
                  .select(F.col(file_col).alias("a"), "n_rows", *[F.col(_q(k)) for k in keys]))


def _probes(fk: DataFrame, stats: DataFrame, keys, file_col: str) -> DataFrame:
    return fk.join(stats.select(file_col, "n_rows"), file_col).select(
        F.col(file_col).alias("b"), F.col("n_rows").alias("n_rows_b"),
        *[F.col(_q(k)).alias(f"__b_{k}") for k in keys])


def overlap_candidates(fk: DataFrame, stats: DataFrame, keys=KEYS, file_col: str = FILE,
                       min_pct: float = 90.0) -> DataFrame:
    """Prefix-filter candidates (a, b), equal n_rows, that may share more than
    ``min_pct`` % of ``a``'s keys. ``fk``: distinct (file, keys);
    ``stats``: (file, n_rows, n_keys)."""
    prefix = prefixes(fk, stats, keys, file_col, min_pct)
    probe = _probes(fk, stats, keys, file_col)
    cond = (_ns_cond(prefix, probe, keys, [f"__b_{k}" for k in keys])
            & (prefix["n_rows"] == probe["n_rows_b"]) & (prefix["a"] != probe["b"]))
    return prefix.join(probe, cond).select("a", "b").distinct()


def exact_overlap(cand: DataFrame, fk: DataFrame, keys=KEYS, file_col: str = FILE) -> DataFrame:
    """|keys(a) & keys(b)| for each candidate pair."""
    cand = cut_lineage(cand)  # a row per pair: small, unlike the keys, which are not moved for it
    ka = fk.select(F.col(file_col).alias("a"), *[F.col(_q(k)) for k in keys])
    kb = fk.select(F.col(file_col).alias("b"), *[F.col(_q(k)).alias(f"__b_{k}") for k in keys])
    kb = kb.join(cand.select("b").distinct(), "b", "left_semi")
    x = cand.join(ka, "a")
    j = x.join(kb, (x["b"] == kb["b"]) & _ns_cond(x, kb, keys, [f"__b_{k}" for k in keys]))
    return j.groupBy(x["a"], x["b"]).agg(F.count(F.lit(1)).alias("n_overlap"))


def _classified(pile: DataFrame, keys, file_col: str, exclude, empty_files: DataFrame | None):
    """The narrow pile, and one row per file with its classes."""
    # one pass over the wide pile; the narrow projection is written to the
    # shared checkpoint folder and every later step reads it
    narrow = cut_lineage(narrow_pile(pile, keys, file_col, exclude))
    fp = file_fingerprints(narrow, keys, file_col)
    if empty_files is not None:
        z = F.lit(0).cast("decimal(30,0)")
        fp = fp.unionByName(
            empty_files.select(F.col(empty_files.columns[0]).alias(file_col)).distinct()
            .join(fp.select(file_col), file_col, "left_anti")
            .select(file_col, F.lit(0).cast("long").alias("n_rows"), z.alias("rfp1"), z.alias("rfp2"),
                    F.lit(0).cast("long").alias("n_keys"), z.alias("kfp1"), z.alias("kfp2")))
    cls = cut_lineage(_classes(fp, file_col))  # one row per file, read by four branches
    return narrow, cls


def _comparable(reps: DataFrame) -> DataFrame:
    """The files that another has as many rows as: only these are compared."""
    shared = reps.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_rows")
    return cut_lineage(reps.join(shared, "n_rows", "left_semi"))  # a row per file


def _warnings(cand: DataFrame, fk: DataFrame, reps: DataFrame, keys, file_col: str, overlap_pct: float) -> DataFrame:
    """Candidates (a, b) that pass: a, b, file1, file2, pct, n_rows, where file1 is
    the first file of a's class and file2 the last of b's."""
    ov = exact_overlap(cand, fk, keys, file_col)
    na = reps.select(F.col(file_col).alias("a"), F.col("n_keys").alias("n_keys_a"), "n_rows")
    pct = F.col("n_overlap") / F.greatest(F.col("n_keys_a"), F.lit(1)) * F.lit(100.0)
    last = reps.select(F.col(file_col).alias("b"), F.col("key_last").alias("file2"))
    return (ov.join(na, "a").join(last, "b").where((pct > overlap_pct) & (F.col("a") < F.col("file2")))
              .select("a", "b", F.col("a").alias("file1"), "file2", pct.alias("pct"), "n_rows"))


def file_pairs(pile: DataFrame, keys=KEYS, file_col: str = FILE, overlap_pct: float = 90.0,
               exclude=(REF,), empty_files: DataFrame | None = None) -> DataFrame:
    """(file1, file2, verdict, overlap_pct, n_rows) findings of one pile.

    DUPLICATE rows link each file to its row-class representative,
    SUSPICIOUS rows link a row-class representative to its key-class
    representative; all pairs inside a class follow by transitivity.
    The overlap is taken of the keys of the file that comes first by name. A
    WARNING row stands for all pairs (x, y), x before y, of one class of files
    with equal keys and another: it names the first x and the last y. Two
    classes give two rows if both orders occur and pass.

    ``empty_files`` (one column, the file name) lists files that are part of
    the pile but have no data rows (from the listing or the workbook
    headers): their fingerprints are zero, so two of them are duplicates.
    """
    narrow, cls = _classified(pile, keys, file_col, exclude, empty_files)
    dup = (cls.where(F.col(file_col) != F.col("row_rep"))
              .select(F.col("row_rep").alias("file1"), F.col(file_col).alias("file2"),
                      F.lit("DUPLICATE").alias("verdict"), F.lit(100.0).alias("overlap_pct"), "n_rows"))
    sus = (cls.where((F.col(file_col) == F.col("row_rep")) & (F.col("row_rep") != F.col("key_rep")))
              .select(F.col("key_rep").alias("file1"), F.col(file_col).alias("file2"),
                      F.lit("SUSPICIOUS").alias("verdict"), F.lit(100.0).alias("overlap_pct"), "n_rows"))
    reps = cls.where(F.col(file_col) == F.col("key_rep")).select(file_col, "n_rows", "n_keys", "key_last")
    fk = cut_lineage(narrow.select(file_col, *[F.col(_q(k)) for k in keys]).distinct()
                     .join(_comparable(reps).select(file_col), file_col, "left_semi"))  # five consumers
    warn = _warnings(overlap_candidates(fk, reps, keys, file_col, overlap_pct), fk, reps, keys, file_col, overlap_pct)
    warn = warn.select("file1", "file2", F.lit("WARNING").alias("verdict"), F.round("pct", 6).alias("overlap_pct"), "n_rows")
    return dup.unionByName(sus).unionByName(warn)


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node connected to each of ``nodes`` by ``edges``
    (x, y). In each round every node takes the least root among its own and its
    neighbours', then the root of that root; as many rounds as it takes."""
    both = cut_lineage(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
                       .distinct())
    roots = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(
            F.min("root").alias("near"))
        low = roots.join(near, "node", "left").select("node", "root", F.least("root", "near").alias("low"))
        up = low.select(F.col("node").alias("low"), F.col("low").alias("above"))
        after = cut_lineage(low.join(up, "low").select("node", F.col("above").alias("next"), "root"))
        moved = after.where("next <> root").limit(1).count()
        roots = after.select("node", F.col("next").alias("root"))
        if not moved:
            return roots


def file_clusters(pile: DataFrame, keys=KEYS, file_col: str = FILE, overlap_pct: float = 90.0, exclude=(REF,),
                  empty_files: DataFrame | None = None) -> DataFrame:
    """A14 as groups: (cluster, file, n_files, n_key_sets) for every file with a
    finding. Files of a cluster are connected by the findings of
    ``file_pairs``; ``cluster`` is its first file, ``n_key_sets`` how many
    different key sets its files have. One row per file, never one per pair.
    """
    narrow, cls = _classified(pile, keys, file_col, exclude, empty_files)
    reps = cls.where(F.col(file_col) == F.col("key_rep")).select(file_col, "n_rows", "n_keys", "key_last")
    fk = cut_lineage(narrow.select(file_col, *[F.col(_q(k)) for k in keys]).distinct()
                     .join(_comparable(reps).select(file_col), file_col, "left_semi"))
    prefix = cut_lineage(prefixes(fk, reps, keys, file_col, overlap_pct))
    probe = _probes(fk, reps, keys, file_col)
    kb = [f"__b_{k}" for k in keys]

    # the first and the last holder of a key, two candidates for each prefix key
    ends = probe.groupBy(*[F.col(_q(k)) for k in kb], "n_rows_b").agg(F.min("b").alias("b1"), F.max("b").alias("b2"))
    near = prefix.join(ends, _ns_cond(prefix, ends, keys, kb) & (prefix["n_rows"] == ends["n_rows_b"])).select(
        "a", F.explode(F.array("b1", "b2")).alias("b")).where("a <> b").distinct()
    # either file of a pair may come first by name
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    nodes = reps.select(F.col(file_col).alias("node"))
    links = cut_lineage(_warnings(near, fk, reps, keys, file_col, overlap_pct).select(
        F.col("a").alias("x"), F.col("b").alias("y")))
    roots = cut_lineage(_components(nodes, links))

    # all candidates between groups that are still apart, of keys that occur in several
    grouped = probe.join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b")
    apart = grouped.groupBy(*[F.col(_q(k)) for k in kb], "n_rows_b").agg(
        F.min("root_b").alias("r1"), F.max("root_b").alias("r2")).where("r1 <> r2").drop("r1", "r2")
    apart = apart.select(*[F.col(_q(k)).alias(f"__s_{k}") for k in kb], F.col("n_rows_b").alias("__n"))
    open_probe = grouped.join(apart, _ns_cond(grouped, apart, kb, [f"__s_{k}" for k in kb])
                              & (grouped["n_rows_b"] == apart["__n"]), "left_semi")
    open_prefix = prefix.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a")
    rest = open_prefix.join(open_probe, _ns_cond(open_prefix, open_probe, keys, kb) & (
        open_prefix["n_rows"] == open_probe["n_rows_b"]) & (open_prefix["root_a"] != open_probe["root_b"])).select(
        "a", "b").distinct()
    more = _warnings(rest, fk, reps, keys, file_col, overlap_pct).select(F.col("a").alias("x"), F.col("b").alias("y"))
    roots = _components(nodes, links.unionByName(more))

    member = cls.join(roots.withColumnRenamed("node", "key_rep"), "key_rep")
    size = member.groupBy("root").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("key_rep").alias("n_key_sets"))
    return member.join(size.where("n_files > 1"), "root").select(
        F.col("root").alias("cluster"), F.col(file_col).alias("file"), "n_files", "n_key_sets")


# --- cross-pile checks ---------------------------------------------------------

def cross_checks(debt: DataFrame, credit: DataFrame, keys=KEYS, ref: str = REF, amount: str = AMT,
                 file_col: str = FILE, overlap_pct: float = 95.0, tol: float = 0.01) -> dict:
    """A15, A16, A12, A17 as one-row DataFrames keyed by check name."""
    meta = {ref, amount, file_col}
    ca = [c for c in debt.columns if c not in meta]
    cb = [c for c in credit.columns if c not in meta]
    same_cols = set(ca) == set(cb)
    nd = debt.agg(F.count(F.lit(1))).scalar()
    nc = credit.agg(F.count(F.lit(1))).scalar()
    if same_cols:
        eq = rows_equal(debt, credit, sorted(ca)).select(
            F.lit(True).alias("same_columns"), nd.alias("n_debt"), nc.alias("n_credit"),
            ((nd == nc) & F.col("rows_equal")).alias("exact_match"))
    else:
        eq = debt.sparkSession.range(1).select(
            F.lit(False).alias("same_columns"), nd.alias("n_debt"), nc.alias("n_credit"),
            F.lit(False).alias("exact_match"))

    kc = [F.col(_q(k)) for k in keys]
    kd, kcr = debt.select(*kc).distinct(), credit.select(*kc).distinct()
    n_kd = kd.agg(F.count(F.lit(1))).scalar()
    n_kc = kcr.agg(F.count(F.lit(1))).scalar()
    n_ov = kd.intersect(kcr).agg(F.count(F.lit(1)).alias("n_overlap"))
    pct = F.col("n_overlap") / F.greatest(n_kd, F.lit(1)) * F.lit(100.0)
    over = n_ov.select(n_kd.alias("n_debt_keys"), n_kc.alias("n_credit_keys"), "n_overlap",
                       F.round(pct, 6).alias("overlap_pct"),
                       ((pct > overlap_pct) & (n_kd == n_kc)).alias("flagged"))

    def mom(df):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(as_money(amount)).cast("double").alias("s"))
    md, mc = mom(debt), mom(credit)
    sd, sc = md.select("s").scalar(), mc.select("s").scalar()
    mean_d = sd / md.select("n").scalar()
    mean_c = sc / mc.select("n").scalar()
    fpr = debt.sparkSession.range(1).select(
        nd.alias("n_debt"), nc.alias("n_credit"), sd.alias("debt_sum"), sc.alias("credit_sum"),
        F.round(mean_d, 6).alias("debt_mean"), F.round(mean_c, 6).alias("credit_mean"),
        ((F.abs(sd - sc) < tol) & (F.abs(mean_d - mean_c) < tol) & (nd == nc)).alias("flagged"))

    def types(df):
        return df.agg(F.concat_ws(",", F.sort_array(F.collect_set(source_type(F.col(ref)))))).scalar()
    td, tc = types(debt), types(credit)
    typ = debt.sparkSession.range(1).select(td.alias("debt_types"), tc.alias("credit_types"),
                                            (td == tc).alias("flagged"))
    return {"exact": eq, "overlap": over, "fingerprint": fpr, "types": typ}
