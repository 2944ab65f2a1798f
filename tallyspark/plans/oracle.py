r"""DuckDB SQL for every registered query (the correctness oracle).

The fixtures F1-F3 are rebuilt here in plain SQL, independently of the
Spark code, and every column is aliased to the Spark name. Counts are
BIGINT, money sums DECIMAL then DOUBLE, ratios rounded on both sides.
"""

from __future__ import annotations

MONEY = "DECIMAL(32,6)"


def money_text(x: str) -> str:
    return f"'$' || CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"


BASE = r"""base AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS card,
         CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS op,
         l.l_extendedprice AS price, l.l_partkey AS pk, l.l_returnflag AS rf,
         strftime(l.l_shipdate, '%Y-%m') || '-01' AS m
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def ref_sql(f: str) -> str:
    low = f"lower({f})"
    date = rf"coalesce(nullif(regexp_extract({low}, '(\d+[.-]\d+[.-]\d+)', 1), ''), 'NO_DATE')"
    return (f"CASE WHEN contains({low}, 'm2d-recu') THEN 'M2D-RECU ' || {date} "
            f"WHEN contains({low}, 'm6d-dev') THEN 'M6D-DEV ' || {date} "
            f"ELSE 'UNKNOWN ' || {f} END")


def blank_null(c: str) -> str:
    return rf"CASE WHEN regexp_matches({c}, '^\s*$') THEN NULL ELSE {c} END"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def lenient(a: str) -> str:
    return rf"coalesce(TRY_CAST(regexp_replace({a}, '[^0-9.\-]', '', 'g') AS DOUBLE), 0.0)"


def strict(a: str) -> str:
    return rf"TRY_CAST(regexp_replace({a}, '[^0-9.\-]', '', 'g') AS DOUBLE)"


def raw_f1(name: str, side: str) -> str:
    where = "" if side == "DEBT" else "WHERE rf = 'R'"
    prefix = "m2d-recu " if side == "DEBT" else "m6d-dev "
    return (f"{name} AS (SELECT card AS \"Card\", op AS \"Operation Number\", "
            f"{money_text('price')} AS \"Original Amount\", '{prefix}' || m || '.xlsx' AS source_file "
            f"FROM base {where})")


def raw_f2(name: str, side: str) -> str:
    where = "" if side == "DEBT" else "WHERE rf = 'R'"
    prefix = "m2d-recu " if side == "DEBT" else "m6d-dev "
    orphan = "WHEN pk % 83 = 0 THEN op || 'X' " if side == "CREDIT" else ""
    return f"""{name} AS (SELECT
      CASE WHEN pk % 97 = 0 THEN '  ' WHEN pk % 101 = 0 THEN '' WHEN pk % 89 = 0 THEN chr(9) || card || '  '
           ELSE card END AS "Card",
      CASE WHEN pk % 97 = 0 OR pk % 103 = 0 THEN NULL {orphan}ELSE op END AS "Operation Number",
      CASE WHEN pk % 109 = 0 THEN 'invalid' WHEN pk % 107 = 0 THEN '-' || {money_text('price')}
           WHEN pk % 113 = 0 THEN {money_text('price * 1000')} ELSE {money_text('price')} END AS "Original Amount",
      '{prefix}' || m || '.xlsx' AS source_file
    FROM base {where})"""


def clean(name: str, src: str) -> str:
    """Loader cleaning: blank->null, drop all-null keys, ref, strip, amount."""
    return f"""{name} AS (SELECT {strip('"Card"')} AS "Card", {strip('"Operation Number"')} AS "Operation Number",
        "Original Amount", source_file, {ref_sql('source_file')} AS "Accounting_Ref",
        {lenient('"Original Amount"')} AS "Amt_Float"
      FROM (SELECT {blank_null('"Card"')} AS "Card", {blank_null('"Operation Number"')} AS "Operation Number",
                   "Original Amount", source_file FROM {src}) t
      WHERE NOT ("Card" IS NULL AND "Operation Number" IS NULL))"""


def minimal(name: str, src: str) -> str:
    return f"""{name} AS (SELECT {strip('"Card"')} AS "Card", {strip('"Operation Number"')} AS "Operation Number",
        "Original Amount", source_file AS "Origin_File" FROM {src})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join((BASE,) + ctes) + "\n"


F1 = (raw_f1("debt_raw", "DEBT"), raw_f1("credit_raw", "CREDIT"),
      clean("debt", "debt_raw"), clean("credit", "credit_raw"))
F2 = (raw_f2("debt_raw", "DEBT"), raw_f2("credit_raw", "CREDIT"),
      clean("debt", "debt_raw"), clean("credit", "credit_raw"))

K = '"Card", "Operation Number"'
JOIN_EQ = 'd."Card" = c."Card" AND d."Operation Number" = c."Operation Number"'
JOIN_NS = ('d."Card" IS NOT DISTINCT FROM c."Card" AND '
           'd."Operation Number" IS NOT DISTINCT FROM c."Operation Number"')

SQL: dict[str, str] = {}

SQL["breakdown_by_debt"] = with_(*F1) + f"""
SELECT d."Accounting_Ref" AS "Accounting_Ref_DEBT", c."Accounting_Ref" AS "Accounting_Ref_CREDIT",
       count(*) AS "Count_Operations",
       CAST(sum(CAST(d."Amt_Float" AS {MONEY})) AS DOUBLE) AS "Total_Conciliated_Amount"
FROM debt d JOIN credit c ON {JOIN_EQ}
GROUP BY 1, 2 ORDER BY 1, 2"""

SQL["breakdown_by_credit"] = with_(*F1) + f"""
SELECT c."Accounting_Ref" AS "Accounting_Ref_CREDIT", d."Accounting_Ref" AS "Accounting_Ref_DEBT",
       count(*) AS "Count_Operations",
       CAST(sum(CAST(d."Amt_Float" AS {MONEY})) AS DOUBLE) AS "Total_Conciliated_Amount"
FROM debt d JOIN credit c ON {JOIN_EQ}
GROUP BY 1, 2 ORDER BY 1, 2"""

SQL["breakdown_direct"] = SQL["breakdown_by_debt"]

SQL["match_audit"] = with_(*F1) + f"""
SELECT d."Card", d."Operation Number",
       d."Original Amount" AS "Original Amount_DEBT", d.source_file AS "source_file_DEBT",
       d."Accounting_Ref" AS "Accounting_Ref_DEBT", d."Amt_Float" AS "Amt_Float_DEBT",
       c."Original Amount" AS "Original Amount_CREDIT", c.source_file AS "source_file_CREDIT",
       c."Accounting_Ref" AS "Accounting_Ref_CREDIT", c."Amt_Float" AS "Amt_Float_CREDIT"
FROM debt d JOIN credit c ON {JOIN_EQ}"""

_F2MIN = (raw_f2("debt_raw", "DEBT"), raw_f2("credit_raw", "CREDIT"),
          minimal("debt", "debt_raw"), minimal("credit", "credit_raw"))

SQL["match_nullsafe"] = with_(*_F2MIN) + f"""
SELECT d."Card", d."Operation Number",
       d."Original Amount" AS "Original Amount_DEBT", d."Origin_File" AS "Origin_File_DEBT",
       c."Original Amount" AS "Original Amount_CREDIT", c."Origin_File" AS "Origin_File_CREDIT"
FROM debt d JOIN credit c ON {JOIN_NS}"""

SQL["bridging_credits"] = with_(*_F2MIN) + f"""
SELECT c."Origin_File" AS "Origin_File_CREDIT", count(DISTINCT d."Origin_File") AS n_debt_files
FROM debt d JOIN credit c ON {JOIN_NS}
GROUP BY 1 HAVING count(DISTINCT d."Origin_File") >= 2"""

SQL["matched_keys"] = with_(*F1) + f"""
SELECT DISTINCT d."Card", d."Operation Number" FROM debt d
WHERE EXISTS (SELECT 1 FROM credit c WHERE {JOIN_EQ})"""

SQL["orphan_debts"] = with_(*F1) + f"""
SELECT d.* FROM debt d WHERE NOT EXISTS (SELECT 1 FROM credit c WHERE {JOIN_NS})"""

SQL["orphan_debt_summary"] = with_(*F1) + f"""
, od AS (SELECT d.* FROM debt d WHERE NOT EXISTS (SELECT 1 FROM credit c WHERE {JOIN_NS}))
SELECT (SELECT count(DISTINCT ({K})) FROM debt) AS n_debt_keys,
       count(DISTINCT ({K})) AS n_orphan_keys, count(*) AS n_orphan_rows,
       CAST(sum(CAST("Amt_Float" AS {MONEY})) AS DOUBLE) AS orphan_total,
       round(100.0 * ((SELECT count(DISTINCT ({K})) FROM debt) - count(DISTINCT ({K})))
             / greatest((SELECT count(DISTINCT ({K})) FROM debt), 1), 6) AS match_rate_pct
FROM od"""

_OC = f"""
, oc AS (SELECT c.* FROM credit c WHERE NOT EXISTS (SELECT 1 FROM debt d WHERE {JOIN_NS}))"""

SQL["orphan_credits"] = with_(*F2) + _OC + "\nSELECT * FROM oc"

SQL["orphan_credit_summary"] = with_(*F2) + _OC + f"""
SELECT count(DISTINCT ({K})) AS n_orphan_keys, count(*) AS n_orphan_rows,
       CAST(sum(CAST("Amt_Float" AS {MONEY})) AS DOUBLE) AS orphan_total FROM oc"""

SQL["orphan_credit_sample"] = with_(*F2) + _OC + f"""
, pk AS (SELECT {K}, min("Amt_Float") AS "Amt_Float" FROM oc GROUP BY ALL)
SELECT *, greatest((SELECT count(*) FROM pk) - 5, 0) AS n_more FROM pk
ORDER BY "Card" NULLS FIRST, "Operation Number" NULLS FIRST LIMIT 5"""

_NAMES = f"""
, names AS (
  SELECT DISTINCT source_file FROM debt_raw
  UNION SELECT DISTINCT source_file FROM credit_raw
  UNION SELECT 'M2D-RECU-' || n_name || '.xlsx' FROM nation
  UNION SELECT n_name || ' 01.02.2026.xlsx' FROM nation
  UNION SELECT 'x_m6d-dev_' || CAST(n_nationkey AS VARCHAR) || '.' || CAST(n_regionkey AS VARCHAR) || '.2026.XLSX' FROM nation
  UNION SELECT 'M6D-DEV M2D-RECU ' || n_name || ' 1-2-3.xlsx' FROM nation)"""

SQL["std_names"] = with_(*F1) + _NAMES + rf"""
SELECT source_file, {ref_sql('source_file')} AS "Accounting_Ref",
       regexp_extract({ref_sql('source_file')}, '^\s*(\S+)', 1) AS source_type
FROM names"""

SQL["file_selection"] = with_(*F1) + _NAMES + """
SELECT source_file,
       contains(lower(source_file), 'm2d-recu') AS in_debt_pile,
       contains(lower(source_file), 'm6d-dev') AS in_credit_pile,
       starts_with(lower(source_file), 'm2d-recu') AS debt_prefix,
       starts_with(lower(source_file), 'm6d-dev') AS credit_prefix
FROM names"""

SQL["clean_keys"] = with_(*F2) + "SELECT * FROM debt"

SQL["dropped_rows"] = with_(*F2) + r"""
SELECT source_file, count(*) AS rows_read,
       count(*) FILTER (WHERE ("Card" IS NULL OR regexp_matches("Card", '^\s*$'))
                          AND ("Operation Number" IS NULL OR regexp_matches("Operation Number", '^\s*$'))) AS rows_dropped
FROM debt_raw GROUP BY 1"""

SQL["clean_amounts"] = with_(*F2) + f"""
SELECT DISTINCT "Original Amount", {lenient('"Original Amount"')} AS "Amt_Float"
FROM (SELECT "Original Amount" FROM debt_raw UNION ALL SELECT "Original Amount" FROM credit_raw) t"""

SQL["strict_amounts"] = with_(*F2) + f"""
SELECT DISTINCT "Original Amount", {strict('"Original Amount"')} AS amount_strict
FROM (SELECT "Original Amount" FROM debt_raw UNION ALL SELECT "Original Amount" FROM credit_raw) t"""


def _qual(label: str, src: str) -> str:
    return rf"""SELECT '{label}' AS pile, count(*) AS n_rows,
       count(*) FILTER (WHERE "Amt_Float" < 0) AS n_negative,
       count(*) FILTER (WHERE "Amt_Float" = 0) AS n_zero,
       count(*) FILTER (WHERE "Card" IS NULL OR "Card" = '') AS n_empty_card,
       count(*) FILTER (WHERE "Operation Number" IS NULL OR "Operation Number" = '') AS n_empty_op,
       count(*) FILTER (WHERE {strip('"Card"')} = '') AS n_whitespace_card
FROM {src}"""


_RAWAMT = f"""
, debt_rawq AS (SELECT *, {lenient('"Original Amount"')} AS "Amt_Float" FROM debt_raw)
, credit_rawq AS (SELECT *, {lenient('"Original Amount"')} AS "Amt_Float" FROM credit_raw)"""

SQL["quality_summary"] = with_(*F2) + _RAWAMT + "\n" + "\nUNION ALL\n".join([
    _qual("DEBT", "debt"), _qual("CREDIT", "credit"),
    _qual("DEBT_RAW", "debt_rawq"), _qual("CREDIT_RAW", "credit_rawq")])


def _outl(label: str, src: str) -> str:
    return f"""SELECT '{label}' AS pile, n_rows, round(mean, 2) AS mean, round(std, 2) AS std,
       round(threshold, 2) AS threshold,
       (SELECT count(*) FROM {src} WHERE "Amt_Float" > threshold) AS n_outliers,
       (SELECT max("Amt_Float") FROM {src} WHERE "Amt_Float" > threshold) AS max_outlier
FROM (SELECT n_rows, mean, std, CASE WHEN n_rows > 10 AND std > 0 THEN mean + 3 * std END AS threshold
      FROM (SELECT count(*) AS n_rows,
                   CAST(sum(CAST("Amt_Float" AS {MONEY})) AS DOUBLE) / count(*) AS mean,
                   stddev_samp("Amt_Float") AS std FROM {src}) m) t"""


SQL["quality_outliers"] = with_(*F2) + _outl("DEBT", "debt") + "\nUNION ALL\n" + _outl("CREDIT", "credit")


def _dups(label: str, src: str) -> str:
    return f"""SELECT '{label}' AS pile, "Card", "Operation Number", "Accounting_Ref", count(*) AS n
FROM {src} WHERE "Card" IS NOT NULL AND "Operation Number" IS NOT NULL AND "Accounting_Ref" IS NOT NULL
GROUP BY ALL HAVING count(*) > 1"""


SQL["quality_dup_keys"] = with_(*F1) + _dups("DEBT", "debt") + "\nUNION ALL\n" + _dups("CREDIT", "credit")

SQL["key_intersect"] = with_(*F1) + f"SELECT {K} FROM debt INTERSECT SELECT {K} FROM credit"
SQL["key_except"] = with_(*F1) + f"SELECT {K} FROM debt EXCEPT SELECT {K} FROM credit"
SQL["pile_union"] = with_(*F1) + """
SELECT "Card", "Operation Number", "Original Amount", source_file, "Accounting_Ref", "Amt_Float" FROM debt
UNION ALL
SELECT "Card", "Operation Number", NULL AS "Original Amount", source_file, "Accounting_Ref", "Amt_Float" FROM credit"""

SQL["pile_totals"] = with_(*F1) + f"""
, d2r AS ({raw_f2('x', 'DEBT').split(' AS (', 1)[1]}
, c2r AS ({raw_f2('x', 'CREDIT').split(' AS (', 1)[1]}
, {clean('d2', 'd2r')}, {clean('c2', 'c2r')}
SELECT 'F1_DEBT' AS pile, count(*) AS n_rows, count(DISTINCT ({K})) AS n_keys FROM debt
UNION ALL SELECT 'F1_CREDIT', count(*), count(DISTINCT ({K})) FROM credit
UNION ALL SELECT 'F2_DEBT', count(*), count(DISTINCT ({K})) FROM d2
UNION ALL SELECT 'F2_CREDIT', count(*), count(DISTINCT ({K})) FROM c2"""

SQL["last_business_day"] = """
SELECT strftime(d, '%Y-%m-%d') AS order_date,
       strftime(b, '%Y-%m-%d') AS last_business_day,
       strftime(b, '%d-%m-%Y') AS business_date_text,
       'BASE 1 PENDIENTES DE CONCILIAR LINEALIZADO (' || strftime(b, '%d-%m-%Y') || ')' AS output_name
FROM (SELECT d, d - CAST(CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS INTEGER) AS b
      FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) x) y"""


# --- duplicate files (F3) and cross-pile checks ----------------------------------

def raw_f3(name: str) -> str:
    m = money_text("price")
    m1 = money_text("price + 1")
    return f"""sizes AS (SELECT m, count(*) AS n FROM base GROUP BY m),
big AS (SELECT b.* FROM base b WHERE b.m = (SELECT m FROM sizes ORDER BY n DESC, m ASC LIMIT 1)),
{name} AS (
  SELECT card AS "Card", op AS "Operation Number", {m} AS "Original Amount", 'm2d-recu ' || m || '.xlsx' AS source_file FROM base
  UNION ALL SELECT card, op, {m}, 'm2d-recu ' || m || ' copy-a.xlsx' FROM big
  UNION ALL SELECT card, op, {m1}, 'm2d-recu ' || m || ' copy-b.xlsx' FROM big
  UNION ALL SELECT card, CASE WHEN pk % 20 = 0 THEN op || 'W' ELSE op END, {m}, 'm2d-recu ' || m || ' copy-c.xlsx' FROM big)"""


_NUL = "'<N>'"


def _r(c: str) -> str:
    return f"coalesce({c}, {_NUL})"


def intra_ctes(p: str, pile: str) -> str:
    """CTEs (prefixed ``p``) for the file-pair verdicts of ``pile``: every pair of
    files is judged, then one row is kept for each copy and one for each two
    classes of files with equal keys."""
    return f"""{p}fk AS (SELECT DISTINCT source_file AS f, "Card" AS c, "Operation Number" AS o FROM {pile})
, {p}ks AS (SELECT f, count(*) AS n_keys,
                string_agg({_r('c')} || chr(1) || {_r('o')}, chr(2) ORDER BY {_r('c')}, {_r('o')}) AS kset
         FROM {p}fk GROUP BY f)
, {p}rr AS (SELECT source_file AS f, {_r('"Card"')} || chr(1) || {_r('"Operation Number"')} || chr(1)
                || {_r('"Original Amount"')} || chr(1) || {_r('CAST("Amt_Float" AS VARCHAR)')} AS rep FROM {pile})
, {p}rs AS (SELECT f, count(*) AS n_rows, string_agg(rep, chr(2) ORDER BY rep) AS rset FROM {p}rr GROUP BY f)
, {p}files AS (SELECT {p}rs.f, n_rows, n_keys, kset, rset FROM {p}rs JOIN {p}ks ON {p}rs.f = {p}ks.f)
, {p}two AS (SELECT x.f AS f1, y.f AS f2, x.n_rows, x.n_keys, x.kset AS k1, y.kset AS k2, x.rset AS r1, y.rset AS r2
         FROM {p}files x JOIN {p}files y ON x.n_rows = y.n_rows AND x.f < y.f)
, {p}shared AS (SELECT f1, f2, count(*) AS n_overlap FROM {p}two
         JOIN {p}fk x ON x.f = f1
         JOIN {p}fk y ON y.f = f2 AND x.c IS NOT DISTINCT FROM y.c AND x.o IS NOT DISTINCT FROM y.o
         WHERE k1 <> k2 GROUP BY ALL)
, {p}found AS (SELECT t.*, CASE WHEN k1 = k2 AND r1 = r2 THEN 'DUPLICATE' WHEN k1 = k2 THEN 'SUSPICIOUS'
                                WHEN n_overlap / greatest(n_keys, 1) * 100.0 > 90 THEN 'WARNING' END AS verdict, n_overlap
         FROM {p}two t LEFT JOIN {p}shared s ON t.f1 = s.f1 AND t.f2 = s.f2)
, {p}pairs AS (
SELECT min(f1) AS file1, f2 AS file2, 'DUPLICATE' AS verdict, CAST(100.0 AS DOUBLE) AS overlap_pct, n_rows
FROM {p}found WHERE verdict = 'DUPLICATE' GROUP BY f2, n_rows
UNION ALL
SELECT min(f1), min(f2), 'SUSPICIOUS', CAST(100.0 AS DOUBLE), n_rows FROM {p}found t
WHERE verdict = 'SUSPICIOUS' AND NOT EXISTS (SELECT 1 FROM {p}found d WHERE d.verdict = 'DUPLICATE' AND d.f2 = t.f2)
GROUP BY f2, n_rows
UNION ALL
SELECT min(f1), max(f2), 'WARNING', round(max(n_overlap / greatest(n_keys, 1) * 100.0), 6), n_rows
FROM {p}found WHERE verdict = 'WARNING' GROUP BY k1, k2, n_rows)"""


SQL["intra_file_pairs"] = (with_(raw_f3("f3_raw"), clean("pile", "f3_raw"), intra_ctes("", "pile"))
                           + "SELECT * FROM pairs")

SQL["file_clusters"] = (with_(raw_f3("f3_raw"), clean("pile", "f3_raw"), intra_ctes("", "pile"))
                        .replace("WITH ", "WITH RECURSIVE ", 1) + """,
reach AS (SELECT file1 AS a, file2 AS b FROM pairs UNION SELECT file2, file1 FROM pairs
  UNION SELECT r.a, CASE WHEN p.file1 = r.b THEN p.file2 ELSE p.file1 END
  FROM reach r JOIN pairs p ON r.b IN (p.file1, p.file2)),
members AS (SELECT a AS file, least(a, min(b)) AS cluster FROM reach GROUP BY a),
keysets AS (SELECT source_file AS file, md5(string_agg(DISTINCT coalesce("Card", '~') || '|' || coalesce("Operation Number", '~'),
  ',' ORDER BY coalesce("Card", '~') || '|' || coalesce("Operation Number", '~'))) AS k FROM pile GROUP BY 1)
SELECT cluster, m.file, n_files, n_key_sets FROM members m JOIN (
  SELECT cluster, count(*) AS n_files, count(DISTINCT k) AS n_key_sets
  FROM members JOIN keysets USING (file) GROUP BY 1) c USING (cluster)""")

_CMP = '"Card", "Operation Number", "Original Amount"'


def _scen(body) -> str:
    """Both scenarios: clean = F1 DEBT vs F1 CREDIT; self = DEBT vs DEBT."""
    return with_(*F1) + "\n" + body("clean", "debt", "credit") + "\nUNION ALL\n" + body("self", "debt", "debt")


SQL["cross_exact"] = _scen(lambda s, a, b: f"""SELECT '{s}' AS scenario, true AS same_columns,
  (SELECT count(*) FROM {a}) AS n_debt, (SELECT count(*) FROM {b}) AS n_credit,
  ((SELECT count(*) FROM {a}) = (SELECT count(*) FROM {b})
   AND NOT EXISTS (SELECT {_CMP} FROM {a} EXCEPT ALL SELECT {_CMP} FROM {b})
   AND NOT EXISTS (SELECT {_CMP} FROM {b} EXCEPT ALL SELECT {_CMP} FROM {a})) AS exact_match""")

SQL["cross_overlap"] = _scen(lambda s, a, b: f"""SELECT '{s}' AS scenario, nd AS n_debt_keys, nc AS n_credit_keys,
  nov AS n_overlap, round(nov / greatest(nd, 1) * 100.0, 6) AS overlap_pct,
  (nov / greatest(nd, 1) * 100.0 > 95 AND nd = nc) AS flagged
FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT {K} FROM {a})) AS nd,
             (SELECT count(*) FROM (SELECT DISTINCT {K} FROM {b})) AS nc,
             (SELECT count(*) FROM (SELECT {K} FROM {a} INTERSECT SELECT {K} FROM {b})) AS nov) t""")

SQL["cross_fingerprint"] = _scen(lambda s, a, b: f"""SELECT '{s}' AS scenario, nd AS n_debt, nc AS n_credit,
  sd AS debt_sum, sc AS credit_sum, round(sd / nd, 6) AS debt_mean, round(sc / nc, 6) AS credit_mean,
  (abs(sd - sc) < 0.01 AND abs(sd / nd - sc / nc) < 0.01 AND nd = nc) AS flagged
FROM (SELECT (SELECT count(*) FROM {a}) AS nd, (SELECT count(*) FROM {b}) AS nc,
             (SELECT CAST(sum(CAST("Amt_Float" AS {MONEY})) AS DOUBLE) FROM {a}) AS sd,
             (SELECT CAST(sum(CAST("Amt_Float" AS {MONEY})) AS DOUBLE) FROM {b}) AS sc) t""")


def _types(src: str) -> str:
    return ("(SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT "
            + r"""regexp_extract("Accounting_Ref", '^\s*(\S+)', 1) AS t FROM """ + src + ") x)")


SQL["cross_types"] = _scen(lambda s, a, b: f"""SELECT '{s}' AS scenario, {_types(a)} AS debt_types,
  {_types(b)} AS credit_types, ({_types(a)} = {_types(b)}) AS flagged""")


# --- linearized report (F4 round trip) ----------------------------------------------

_F4J = """f4 AS (SELECT l.*, o.o_orderdate, c.c_custkey, c.c_name,
    'tarjetas_' || lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') || '.txt' AS report_file,
    ((l.l_orderkey + l.l_linenumber + l.l_partkey) % 5 = 0) AS sel5,
    ((l.l_orderkey + l.l_partkey) % 7 = 0) AS sel7,
    ((l.l_partkey + l.l_suppkey) % 11 = 0) AS sel11,
    ((l.l_orderkey + l.l_suppkey) % 13 = 0) AS sel13,
    (l.l_partkey % 17 = 0) AS sel17
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)"""

_CUSTF = """cf AS (SELECT c_custkey, c_name,
    'tarjetas_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '.txt' AS report_file FROM customer)"""


def _records(blank_amount: bool) -> str:
    afect = ("CASE WHEN sel17 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + 1 AS DOUBLE) END"
             if blank_amount else "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + 1 AS DOUBLE)")
    return "WITH " + _F4J + f"""
SELECT report_file, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS "TARJETA",
  CASE WHEN c_custkey % 13 = 0 THEN 'UNKNOWN' ELSE c_name END AS "NOMBRE",
  lpad(CAST((l_orderkey * 8 + l_linenumber) % 1000000 AS VARCHAR), 6, '0') AS "OPERAC",
  '01' AS "RS", l_returnflag || l_linestatus || 'MV' AS "MOVIM", '604' AS "MONEDA ORIGINAL",
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS "IMPORTE ORIGINAL", 'SOL' AS "MONEDA VISA",
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS "IMPORT VISA", 'USD' AS "MONEDA AFECTADO",
  {afect} AS "IMPORTE AFECTADO", 'AHO' AS "TIPO CUENTA",
  '194-' || CAST(l_partkey AS VARCHAR) || '-0-' || CAST(l_suppkey AS VARCHAR) AS "CUENTA AFECTADA",
  strftime(l_shipdate, '%d%m%Y') AS "FECOPE", '234248' AS "HORA", strftime(o_orderdate, '%d%m%Y') AS "FBASE1",
  '06-27' AS "EXPIRACION",
  'T' || CAST(l_suppkey AS VARCHAR) AS "TERMINAL", l_returnflag AS "TIPO",
  CAST(l_orderkey AS VARCHAR) AS "IDENTIFICACION", 'SUPP ' || CAST(l_suppkey AS VARCHAR) AS "ESTABLECIMIENTO",
  'LIMA' AS "CIUDAD", 'PE' AS "PAIS", CAST(l_partkey AS VARCHAR) AS "BIN ADQUIR.", 'N' AS "PIN",
  CAST(l_linenumber AS VARCHAR) AS "VIS.REFER",
  CASE WHEN sel13 THEN '' ELSE '05' END AS "TRNX", CASE WHEN sel13 THEN '' ELSE '7' END AS "CAVV",
  CASE WHEN sel13 THEN '' ELSE CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) END AS "POS.C.CODE"
FROM f4"""


SQL["linearize_fixed"] = _records(True)
SQL["linearize_split"] = _records(True)
SQL["linearize_delim"] = _records(False)
SQL["report_run"] = _records(True)
SQL["report_run_count"] = f"SELECT count(*) AS records FROM ({_records(True)}) r"

SQL["line_counts"] = "WITH " + _F4J + ", " + _CUSTF + """
SELECT report_file, CAST(sum(n) AS BIGINT) AS n_lines FROM (
  SELECT report_file, 2 AS n FROM cf
  UNION ALL
  SELECT report_file, 2 + CAST(sel7 AS INTEGER) + CAST(sel11 AS INTEGER) + 5 * CAST(sel5 AS INTEGER) FROM f4) t
GROUP BY report_file"""

SQL["report_holders"] = "WITH " + _CUSTF + """
SELECT report_file, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS "TARJETA",
  CASE WHEN c_custkey % 13 = 0 THEN 'UNKNOWN' ELSE c_name END AS "NOMBRE" FROM cf"""


# --- run verdicts (gates) ----------------------------------------------------------------

def _iss(gate, check, sev, blocking, pile, subject="NULL", n="NULL", value="NULL") -> str:
    return (f"'{gate}' AS gate, '{check}' AS \"check\", {sev} AS severity, {blocking} AS blocking, "
            f"'{pile}' AS pile, CAST({subject} AS VARCHAR) AS subject, CAST({n} AS BIGINT) AS n, "
            f"CAST({value} AS DOUBLE) AS value")


def _quality_issue_rows(label: str, src: str) -> list[str]:
    q = f"(SELECT * FROM ({_qual(label, src)}) x)"
    o = f"(SELECT * FROM ({_outl(label, src)}) x)"
    d = (f"(SELECT count(*) AS g FROM (SELECT \"Card\", \"Operation Number\", \"Accounting_Ref\" FROM {src} WHERE \"Card\" IS NOT NULL AND "
         f"\"Operation Number\" IS NOT NULL AND \"Accounting_Ref\" IS NOT NULL GROUP BY ALL "
         f"HAVING count(*) > 1) y)")
    rows = [
        f"SELECT {_iss('G4', 'negative_amounts', chr(39) + 'WARN' + chr(39), 'false', label, n='n_negative')} FROM {q} t WHERE n_negative > 0",
        f"SELECT {_iss('G4', 'zero_amounts', chr(39) + 'WARN' + chr(39), 'false', label, n='n_zero')} FROM {q} t WHERE n_zero > 0",
        f"SELECT {_iss('G4', 'high_outliers', chr(39) + 'WARN' + chr(39), 'false', label, n='n_outliers', value='max_outlier')} FROM {o} t WHERE n_outliers > 0",
        f"SELECT {_iss('G4', 'duplicate_keys_in_file', chr(39) + 'WARN' + chr(39), 'false', label, n='g')} FROM {d} t WHERE g > 0",
        f"SELECT {_iss('G4', 'empty_card', chr(39) + 'ERROR' + chr(39), 'true', label, n='n_empty_card')} FROM {q} t WHERE n_empty_card > 0",
        f"SELECT {_iss('G4', 'empty_operation', chr(39) + 'ERROR' + chr(39), 'true', label, n='n_empty_op')} FROM {q} t WHERE n_empty_op > 0",
        f"SELECT {_iss('G4', 'whitespace_card', chr(39) + 'ERROR' + chr(39), 'true', label, n='n_whitespace_card')} FROM {q} t WHERE n_whitespace_card > 0",
    ]
    return rows


def _run_issues_sql(fixture) -> str:
    e, w = "'ERROR'", "'WARN'"
    intra = [f"""SELECT 'G1' AS gate, 'intra_pile_' || lower(verdict) AS "check",
       CASE WHEN verdict = 'WARNING' THEN 'WARN' ELSE 'ERROR' END AS severity, true AS blocking,
       '{lab}' AS pile, file1 || ' <> ' || file2 AS subject, CAST(n_rows AS BIGINT) AS n,
       CAST(overlap_pct AS DOUBLE) AS value FROM {p}pairs""" for p, lab in (("d_", "DEBT"), ("c_", "CREDIT"))]
    empty = [f"SELECT {_iss('G2', 'empty_pile', e, 'true', lab, n='c')} FROM (SELECT count(*) AS c FROM {src}) t WHERE c = 0"
             for src, lab in (("debt", "DEBT"), ("credit", "CREDIT"))]
    ex = _scen_one("cross_exact")
    ovl = _scen_one("cross_overlap")
    fpr = _scen_one("cross_fingerprint")
    typ = _scen_one("cross_types")
    cross = [
        f"SELECT {_iss('G3', 'cross_exact_match', e, 'true', 'DEBT/CREDIT', n='n_debt')} FROM ({ex}) t WHERE exact_match",
        f"SELECT {_iss('G3', 'cross_key_overlap', e, 'true', 'DEBT/CREDIT', n='n_overlap', value='overlap_pct')} FROM ({ovl}) t WHERE flagged",
        f"SELECT {_iss('G3', 'cross_amount_fingerprint', e, 'true', 'DEBT/CREDIT', n='n_debt', value='debt_sum')} FROM ({fpr}) t WHERE flagged",
        f"SELECT {_iss('G3', 'cross_same_type', w, 'true', 'DEBT/CREDIT', subject='debt_types')} FROM ({typ}) t WHERE flagged",
    ]
    qual = _quality_issue_rows("DEBT", "debt") + _quality_issue_rows("CREDIT", "credit")
    oc = f"(SELECT c.* FROM credit c WHERE NOT EXISTS (SELECT 1 FROM debt d WHERE {JOIN_NS}))"
    od = f"(SELECT d.* FROM debt d WHERE NOT EXISTS (SELECT 1 FROM credit c WHERE {JOIN_NS}))"
    ocs = (f"(SELECT count(DISTINCT ({K})) AS k, CAST(sum(CAST(\"Amt_Float\" AS {MONEY})) AS DOUBLE) AS tot "
           f"FROM {oc} x)")
    ods = (f"(SELECT count(DISTINCT ({K})) AS k, CAST(sum(CAST(\"Amt_Float\" AS {MONEY})) AS DOUBLE) AS tot, "
           f"(SELECT count(DISTINCT ({K})) FROM debt) AS nk FROM {od} x)")
    rate = "round(100.0 * (nk - k) / greatest(nk, 1), 6)"
    match = [
        f"SELECT {_iss('G5', 'no_match', e, 'true', 'DEBT/CREDIT', n='m')} FROM (SELECT count(*) AS m FROM debt d JOIN credit c ON {JOIN_EQ}) t WHERE m = 0",
        f"SELECT {_iss('G6', 'orphan_credits', e, 'true', 'CREDIT', n='k', value='tot')} FROM {ocs} t WHERE k > 0",
        f"SELECT {_iss('G7', 'orphan_debts', chr(39) + 'INFO' + chr(39), 'false', 'DEBT', n='k', value='tot')} FROM {ods} t WHERE k > 0",
        f"SELECT {_iss('G7', 'debt_match_rate', chr(39) + 'INFO' + chr(39), 'false', 'DEBT', n='nk', value=rate)} FROM {ods} t WHERE k > 0",
    ]
    body = "\nUNION ALL\n".join(intra + empty + cross + qual + match)
    return with_(*fixture, intra_ctes("d_", "debt"), intra_ctes("c_", "credit")) + body


def _scen_one(name: str) -> str:
    """The 'clean' scenario body of a cross check (debt vs credit)."""
    full = SQL[name]
    body = full[len(with_(*F1)) + 1:]
    return body.split("\nUNION ALL\n")[0]


SQL["run_issues"] = _run_issues_sql(F2)
SQL["run_issues_clean"] = _run_issues_sql(F1)
SQL["run_issues_copies"] = _run_issues_sql((raw_f3("f3_raw"), clean("debt", "f3_raw"), raw_f1("credit_raw", "CREDIT"),
                                            clean("credit", "credit_raw")))
_DEBT_ONLY = (raw_f1("debt_raw", "DEBT"), clean("debt", "debt_raw"))
SQL["run_issues_empty"] = _run_issues_sql((*_DEBT_ONLY, "credit AS (SELECT * FROM debt WHERE false)"))
SQL["run_issues_self"] = _run_issues_sql((*_DEBT_ONLY, "credit AS (SELECT * FROM debt)"))
SQL["run_issues_disjoint"] = _run_issues_sql(
    (*F1[:3], clean("returned", "credit_raw"),
     """credit AS (SELECT * REPLACE ("Operation Number" || 'Z' AS "Operation Number") FROM returned)"""))


# --- workbook piles ---------------------------------------------------------------------------

_SMALLEST = """smallest AS (SELECT source_file FROM debt_raw GROUP BY source_file
                 ORDER BY count(*) ASC, source_file ASC LIMIT 1)"""

SQL["workbook_pile"] = with_(*F1, _SMALLEST) + """
SELECT "Card", "Operation Number", "Original Amount", source_file, "Accounting_Ref", "Amt_Float" FROM debt
WHERE source_file NOT IN (SELECT source_file FROM smallest)"""

SQL["workbook_file_errors"] = with_(*F1, _SMALLEST) + """
SELECT source_file AS file, 'missing_key_columns' AS reason FROM smallest
UNION ALL SELECT 'm2d-recu corrupt.xlsx', 'unreadable'"""

SQL["land_latest"] = with_(*F1) + 'SELECT "Card", "Operation Number", "Original Amount" FROM debt_raw'

SQL["land_stream"] = SQL["land_latest"]

SQL["key_set_equal"] = _scen(lambda s, a, b: f"""SELECT '{s}' AS scenario,
  ((SELECT count(*) FROM (SELECT DISTINCT {K} FROM {a})) = (SELECT count(*) FROM (SELECT DISTINCT {K} FROM {b}))
   AND (SELECT count(*) FROM (SELECT DISTINCT {K} FROM {a})) =
       (SELECT count(*) FROM (SELECT {K} FROM {a} INTERSECT SELECT {K} FROM {b}))) AS key_sets_equal""")


# --- csv piles --------------------------------------------------------------------------------

_BROKEN = """(source_file IN (SELECT source_file FROM smallest)
             AND right("Operation Number", 1) IN ('1', '3', '5', '7', '9'))"""
_CSV = (*F1[:2], _SMALLEST,
        f"debt_files AS (SELECT * REPLACE (replace(source_file, '.xlsx', '.csv') AS source_file) "
        f"FROM debt_raw WHERE NOT {_BROKEN})",
        "credit_files AS (SELECT * REPLACE (replace(source_file, '.xlsx', '.csv') AS source_file) FROM credit_raw)",
        f"broken AS (SELECT * REPLACE (replace(source_file, '.xlsx', '.csv') AS source_file) "
        f"FROM debt_raw WHERE {_BROKEN})",
        clean("debt", "debt_files"), clean("credit", "credit_files"))

SQL["csv_pile"] = with_(*_CSV) + """
SELECT "Card", "Operation Number", "Original Amount", "Amt_Float", source_file, "Accounting_Ref" FROM debt
UNION ALL
SELECT "Card", "Operation Number", "Original Amount", "Amt_Float", source_file, "Accounting_Ref" FROM credit"""

SQL["csv_pile_minimal"] = with_(*_CSV, minimal("old", "debt_files")) + """
SELECT * FROM old UNION ALL
SELECT "Card", "Operation Number", NULL, 'm2d-recu 1.1.2026 noamount.csv' FROM broken"""

SQL["csv_file_errors"] = with_(*_CSV) + """
SELECT DISTINCT source_file AS file, 'missing_key_columns' AS reason FROM broken
UNION ALL SELECT DISTINCT 'm2d-recu 1.1.2026 noamount.csv', 'missing_amount' FROM broken"""

SQL["csv_reconcile"] = with_(*_CSV) + SQL["breakdown_by_debt"][len(with_(*F1)):]

SQL["csv_mass_match"] = with_(*_CSV) + f"""
SELECT d."Card", d."Operation Number", d."Amt_Float" AS "Amt_Float_DEBT", c."Amt_Float" AS "Amt_Float_CREDIT"
FROM debt d JOIN credit c ON {JOIN_EQ}"""

SQL["inventory"] = with_(*F1) + "SELECT DISTINCT source_file AS folder, TRUE AS has_bytes FROM debt_raw"

SQL["first_names"] = with_(*F1) + "SELECT DISTINCT source_file AS folder FROM debt_raw ORDER BY 1 LIMIT 10"


# --- whole runs -----------------------------------------------------------------------------------

_REPORT = f"""
, totals AS (SELECT d."Accounting_Ref" AS "Accounting_Ref_DEBT", c."Accounting_Ref" AS "Accounting_Ref_CREDIT",
    count(*) AS "Count_Operations", CAST(sum(CAST(d."Amt_Float" AS {MONEY})) AS DOUBLE) AS "Total_Conciliated_Amount"
  FROM debt d JOIN credit c ON {JOIN_EQ} GROUP BY 1, 2)
SELECT report, totals.* FROM totals,
  (SELECT unnest(['By_Debt_File', 'By_Credit_File', 'Detailed_Audit_Log']) AS report) r"""

SQL["reconcile_report"] = with_(*_CSV) + _REPORT

SQL["reconcile_blocked"] = f"""
WITH issues AS ({SQL["run_issues"]})
SELECT *, CASE (SELECT min(gate) FROM issues WHERE blocking)
    WHEN 'G1' THEN 'INTRA_PILE_DUPLICATES' WHEN 'G2' THEN 'EMPTY_PILE' WHEN 'G3' THEN 'PILES_LOOK_ALIKE'
    WHEN 'G4' THEN 'DATA_QUALITY_ERRORS' WHEN 'G5' THEN 'NO_MATCH' WHEN 'G6' THEN 'ORPHAN_CREDITS' ELSE 'OK' END AS status,
  CAST(CASE WHEN (SELECT count(*) FROM issues WHERE blocking) > 0 THEN 0 ELSE 3 END AS BIGINT) AS n_tables
FROM issues"""

_OLD = (*_CSV, minimal("d_whole", "debt_files"), minimal("c_old", "credit_files"),
        """d_old AS (SELECT * FROM d_whole UNION ALL
  SELECT "Card", "Operation Number", NULL, 'm2d-recu 1.1.2026 noamount.csv' FROM broken)""")

SQL["mass_match_audit"] = with_(*_OLD) + f"""
SELECT d."Card", d."Operation Number", d."Original Amount" AS "Original Amount_DEBT",
  d."Origin_File" AS "Origin_File_DEBT", c."Original Amount" AS "Original Amount_CREDIT",
  c."Origin_File" AS "Origin_File_CREDIT"
FROM d_old d JOIN c_old c ON {JOIN_NS}"""

SQL["mass_match_bridging"] = with_(*_OLD) + f"""
SELECT c."Origin_File" AS "Origin_File_CREDIT", count(DISTINCT d."Origin_File") AS n_debt_files
FROM d_old d JOIN c_old c ON {JOIN_NS}
GROUP BY 1 HAVING count(DISTINCT d."Origin_File") >= 2"""

SQL["csv_line_ends"] = with_(*_CSV) + """
SELECT "Card", CASE WHEN right("Operation Number", 1) IN ('0', '2', '4', '6', '8')
    THEN substr("Operation Number", 1, 1) || chr(10) || substr("Operation Number", 2) ELSE "Operation Number" END
    AS "Operation Number", "Original Amount", "Amt_Float", source_file, "Accounting_Ref" FROM debt"""
