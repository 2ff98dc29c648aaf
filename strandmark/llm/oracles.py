"""SQL that says the same as a query, where SQL can."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP3 = f"""
with item as (select item_id::varchar item, {WORDS} w from benchmark),
cut as (select item, w[i:i+9] w from item, lateral (select unnest(range(1, greatest(1, len(w) - 9) + 1)) i) where len(w) > 0),
win as (select array_to_string(w, ' ') win, len(w) n, list(distinct item) items from cut group by all),
doc as (select doc_id, {WORDS} w from documents),
place as (select doc_id, p, n, array_to_string(w[p:p+n-1], ' ') win from doc, (select distinct n from win) s, lateral (select unnest(range(1, greatest(0, len(w) - n + 1) + 1)) p)),
hit as (select doc_id, p, win.n, items from place join win on place.win = win.win and place.n = win.n),
hits as (select doc_id, count(distinct q) n_hit from hit, lateral (select unnest(range(p, p + n)) q) group by doc_id),
named as (select doc_id, count(distinct i) n_items, string_agg(distinct i, ',' order by i) items from (select doc_id, unnest(items) i from hit) group by doc_id)
select doc.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join hits on doc.doc_id = hits.doc_id left join named on doc.doc_id = named.doc_id
"""

OP5 = r"""
with d as (select doc_id, text, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint size from documents),
s as (select source, sum(size)::bigint source_size, [5.0::double, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] w from d group by source),
l as (select *, 2.0::double * source_size cap, (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by 2.0::double * source_size / w, source is null, source rows between current row and unbounded following) lv from s),
t as (select source, source_size, case when (select count(*) from l where lv * w < cap) = 0 then cap else least(cap, (select arg_min(lv, cap / w) from l where lv * w < cap) * w) end target from l),
r as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end rate, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, 'null') || '|' || coalesce(text, 'null')), 1, 12))::bigint / 281474976710656.0::double u from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size)::bigint taken from r
"""


#: Texts as hexadecimal digits of their bytes, so that strings of 50 bytes are strings of 100 digits.
OP9 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
w as (select doc_id, p, substr(h, (2 * p + 1)::bigint, 100) s from d, lateral (select unnest(range(0, n - 49)) p) where n >= 50),
m as (select s, min(doc_id) least from w group by s having count(*) > 1),
hit as (select w.doc_id, p from w join m on w.s = m.s where least < w.doc_id),
isle as (select doc_id, p, sum(new) over (partition by doc_id order by p rows unbounded preceding) k from (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end new from hit)),
run as (select doc_id, min(p) a, max(p) + 50 b from isle group by doc_id, k),
gap as (select doc_id, a, coalesce(lag(b) over (partition by doc_id order by a), 0) f, b - a size, max(b) over (partition by doc_id) last from run),
kept as (select gap.doc_id, count(*) n_spans, sum(size) n_removed, string_agg(substr(h, (2 * f + 1)::bigint, (2 * (a - f))::bigint), '' order by a) || substr(any_value(h), (2 * any_value(last) + 1)::bigint) h from gap join d on d.doc_id = gap.doc_id group by gap.doc_id)
select d.doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept.h, d.h))) kept_sha256 from d left join kept on d.doc_id = kept.doc_id
"""


def _item(c: str) -> str:
    return f"coalesce(octet_length(encode(({c})::varchar))::varchar || ':' || ({c})::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_item, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: Bit by bit: after each byte of the id, eight steps (-1).
CRC32 = "xor(list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: case when x >= 0 then xor(a, x::bigint) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint), 4294967295::bigint)"
HALVED = "list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"
STEP = "case when (i >> level) & 1 = 1 then 'L' else 'R' end || coalesce(h[xor(i >> level, 1) + 1], '')"

OP11 = f"""
with recursive d as (select row_number() over () k, doc_id, coalesce('=' || lang, '') tree, {_leaf("n_chars")} leaf, {CRC32} % 7 = 0 hit, {_leaf("n_chars + 1")} bad from documents),
p as (select *, (row_number() over (partition by tree order by doc_id nulls first, leaf) - 1)::bigint i from d),
lv as (select tree, 0::bigint as level, list(leaf order by i) h from p group by tree union all select tree, level + 1, {HALVED} from lv where len(h) > 1),
sub as (select tree, h[1] subroot, (row_number() over (order by tree) - 1)::bigint i from lv where len(h) = 1),
top as (select 0::bigint as level, list(subroot order by i) h from sub union all select level + 1, {HALVED} from top where len(h) > 1),
up as (select k, list({STEP} order by level) s from p join lv on p.tree = lv.tree and len(h) > 1 group by k),
above as (select tree, list({STEP} order by level) s from sub join top on len(h) > 1 group by tree),
w as (select p.*, subroot, (select h[1] from top where len(h) = 1) root, list_concat(coalesce(up.s, []), coalesce(above.s, [])) s from p join sub on p.tree = sub.tree left join up on p.k = up.k left join above on p.tree = above.tree),
f as (select *, list_reduce(s, lambda a, x: case when x[1] = 'L' then sha256(x[2:] || a) else sha256(a || x[2:]) end, case when hit then bad else leaf end) folded_root from w)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: x[2:]), '')) proof_sha256, folded_root, folded_root = root verified from f
"""

OP13 = """
with q as (select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
m as (select payload_digest, max(page_id) f from q where payload_bytes >= 1000 group by payload_digest having count(*) > 1)
select page_id, payload_bytes, q.payload_digest, case when f is null or page_id = f then 'response' else 'revisit' end record_type, case when page_id is distinct from f then f end refers_to from q left join m on q.payload_digest = m.payload_digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op5_mixing": OP5, "op9_substring_dedup": OP9, "op11_merkle_manifest": OP11, "op13_warc_index": OP13}
