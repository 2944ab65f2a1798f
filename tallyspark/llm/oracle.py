"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

# Checksums of single bytes by the reflected polynomial, as a list of 256.
_CRC_TABLE = """(
  select list(v order by b) from (
    select b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) as v
    from (select unnest(range(0, 256))::BIGINT as b)))"""


def _crc32(hex_text: str, table: str) -> str:
    """CRC-32 of the bytes that ``hex_text`` spells; ``table`` is the list."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, length({hex_text}) // 2 + 1),
        lambda i: ('0x' || substr({hex_text}, (2 * i - 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)))"""


_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


MERKLE = f"""
with recursive crc as (select {_CRC_TABLE} as crc_list),
rows as (
  select *, case when {_crc32("hex(doc_id::VARCHAR)", "crc_list")} % 3 = 0
    then translate(text, {_UPPER}, {_LOWER}) else text end as tampered
  from documents, crc),
d as (
  select doc_id, lang, {_leaf("text")} as leaf, {_leaf("tampered")} as other,
    row_number() over (partition by lang order by doc_id) - 1 as idx, count(*) over (partition by lang) as n
  from rows),
t as (
  select lang, 0 as lvl, idx, leaf as node, n from d
  union all
  select lang, lvl + 1, idx // 8, sha256(string_agg(node, '' order by idx)), max((n + 7) // 8)
  from t where n > 1 group by lang, lvl, idx // 8),
s as (
  select lang, node as subroot, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n
  from t where n = 1),
u as (
  select 0 as lvl, idx, subroot as node, n from s
  union all
  select lvl + 1, idx // 8, sha256(string_agg(node, '' order by idx)), max((n + 7) // 8)
  from u where n > 1 group by lvl, idx // 8),
meetings as (
  select d.doc_id, t.lvl as step,
    string_agg(t.node, '' order by t.idx) filter (where t.idx < d.idx // (8 ** t.lvl)::BIGINT) as before,
    string_agg(t.node, '' order by t.idx) filter (where t.idx > d.idx // (8 ** t.lvl)::BIGINT) as after
  from d join t on t.lang is not distinct from d.lang and t.n > 1
    and t.idx // 8 = d.idx // (8 ** (t.lvl + 1))::BIGINT
  group by d.doc_id, t.lvl
  union all
  select d.doc_id, 1000 + u.lvl,
    string_agg(u.node, '' order by u.idx) filter (where u.idx < s.idx // (8 ** u.lvl)::BIGINT),
    string_agg(u.node, '' order by u.idx) filter (where u.idx > s.idx // (8 ** u.lvl)::BIGINT)
  from d join s on s.lang is not distinct from d.lang
    join u on u.n > 1 and u.idx // 8 = s.idx // (8 ** (u.lvl + 1))::BIGINT
  group by d.doc_id, u.lvl),
steps as (
  select doc_id, row_number() over (partition by doc_id order by step) as k,
    coalesce(before, '') as before, coalesce(after, '') as after
  from meetings),
folded as (
  select doc_id, 0::BIGINT as k, other as node from d
  union all
  select f.doc_id, f.k + 1, sha256(x.before || f.node || x.after)
  from folded f join steps x on x.doc_id = f.doc_id and x.k = f.k + 1)
select d.doc_id, d.leaf, s.subroot, r.node as root,
  sha256(coalesce((select string_agg(before || after, '' order by k) from steps x where x.doc_id = d.doc_id), ''))
    as proof_sha256,
  f.node as folded_root, f.node = r.node as verified
from d join s on s.lang is not distinct from d.lang
  join (select node from u where n = 1) r on true
  join (select doc_id, arg_max(node, k) as node from folded group by doc_id) f on f.doc_id = d.doc_id
"""

IMPORTANCE = f"""
with crc as (select {_CRC_TABLE} as crc_list),
texts as (
  select 0 as side, doc_id as id, text from documents
  union all select 1, item_id, text from benchmark),
words as (
  select side, id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts),
features as (
  select side, id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f
  from words),
known as (
  select f, {_crc32("h", "crc_list")} % 10000 as bucket from (select distinct f, hex(f) as h from features), crc),
counts as (
  select bucket, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t
  from features join known using (f) group by bucket),
gains as (
  select bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) over () + 10000)
    / ((s + 1)::DOUBLE * (sum(t) over () + 10000))))::BIGINT as gain
  from counts),
weights as (
  select id, count(*) as n_features, sum(gain)::BIGINT as weight
  from features join known using (f) join gains using (bucket) where side = 0 group by id),
scored as (
  select x.id as doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(w) as n_words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('42:' || x.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT as score
  from words x left join weights y on x.id = y.id where side = 0),
ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place,
    count(*) filter (where n_words >= 20) over () as n
  from scored)
select doc_id, n_features::BIGINT as n_features, weight, score, n_words::BIGINT as n_words,
  case when n_words >= 20 and place <= 5 * n // 100 then place end as rank
from ranked
"""
