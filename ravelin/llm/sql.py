"""DuckDB SQL for those queries of this subpackage that SQL can express, written from their contracts.

Components, windows and spans are counted here by plain joins and window functions, which suit small tables only.
"""

from __future__ import annotations

import string

from ravelin.llm.quality_rules import STOP_WORDS

#: Words between ASCII white space.
SPACED = r"'[^\x20\x09-\x0D]+'"
#: Runs of anything but ASCII other than digits and letters.
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lower(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _next(n: int) -> str:
    """n words in succession, joined by a space."""
    return "concat_ws(' ', word, " + ", ".join(f"lead(word, {k}) over x" for k in range(1, n)) + ")"


TEXTS = "t as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents)"

OP6 = rf"""with {TEXTS}, w as (select r, regexp_extract_all(text, {SPACED}) as w, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) as l from t),
    p as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from w),
    g as (select r, i, {_next(5)} as gram, lead(word, 4) over x is not null as whole from p window x as (partition by r order by i)),
    d as (select r, i from (select r, i, count(*) over (partition by r, gram) as n from g where whole) where n > 1),
    h as (select r, count(distinct j) as n_repeat_words from (select r, unnest(range(i, i + 5)) as j from d) group by r),
    m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, len(list_filter(w, lambda y: list_contains({_list([*STOP_WORDS, *(v.capitalize() for v in STOP_WORDS)])}, y))) as n_stop from t join w using (r) left join h using (r)),
    q as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, case when n_words = 0 then 0.0::double else word_chars / n_words end as rule_mean_word_chars, case when n_words = 0 then 0.0::double else n_symbols / n_words end as rule_symbols_per_word,
        case when n_words = 0 then 0.0::double else (n_stop + 3) / n_words end as rule_padded_stop_word_share, case when n_lines = 0 then 0.0::double else n_dup_lines / n_lines end as rule_dup_line_share from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rule_mean_word_chars between 2 and 14 and rule_symbols_per_word <= 0.25 and rule_padded_stop_word_share >= 0.03 and rule_dup_line_share <= 0.5 as kept,
    rule_mean_word_chars, rule_symbols_per_word, rule_padded_stop_word_share, rule_dup_line_share from q"""

OP10 = rf"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {ALNUM}) as w from documents),
    b as (select item_id, regexp_extract_all({_lower("coalesce(text, '')")}, {ALNUM}) as w from benchmark), i as (select item_id, w, least(len(w), 13) as s from b where len(w) > 0),
    g as (select distinct cast(item_id as varchar) as item, s, unnest(list_transform(range(1, len(w) - s + 2), lambda k: array_to_string(w[k : k + s - 1], ' '))) as gram from i),
    o as (select r, s, unnest(range(1, len(w) - s + 2)) as pos, unnest(list_transform(range(1, len(w) - s + 2), lambda k: array_to_string(w[k : k + s - 1], ' '))) as gram from d, (select distinct s from i) where len(w) >= s),
    f as (select r, pos, o.s, item from o join g on o.gram = g.gram and o.s = g.s),
    h as (select r, count(distinct j) as n_hit from (select distinct r, unnest(range(pos, pos + s)) as j from f) group by r),
    n as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from f) group by r)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join h using (r) left join n using (r)"""

OP7 = rf"""with {TEXTS}, w as (select r, doc_id, regexp_extract_all(text, {SPACED}) as w from t), p as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from w),
    g as (select r, i, sha256({_next(35)}) as gram, lead(word, 34) over x is not null as whole from p window x as (partition by r order by i)),
    d as (select r, i from (select r, i, count(*) over (partition by gram) as n from g where whole) where n > 1),
    h as (select distinct r, unnest(range(i, i + 35)) as i from d),
    k as (select r, string_agg(word, ' ' order by i) as kept, count(*) as n_kept from p anti join h using (r, i) group by r)
    select doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (r)"""

OP2 = rf"""with recursive w as (select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {SPACED}) as w from documents),
    u as (select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k : k + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as shingle from w), k as (select shingle, row_number() over () as sid from (select distinct shingle from u)),
    s as (select doc_id, sid from u join k using (shingle)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    c as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.sid = b.sid and a.doc_id < b.doc_id group by 1, 2),
    l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 85 * (x.n + y.n - both_)),
    e as (select a, b from l union all select b, a from l),
    reach as (select doc_id as a, doc_id as b from documents union select reach.a, e.b from reach join e on reach.b = e.a),
    m as (select a as doc_id, min(b) as component_id from reach group by a)
    select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from m left join n using (doc_id)"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = (_ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_-]{20,}")
_MATCHES = " union all ".join(f"select r, {k} as kind, unnest(regexp_extract_all(text, '{p}')) as value, unnest(regexp_split_to_array(text, '{p}')) as gap, unnest(range(len(regexp_extract_all(text, '{p}')) + 1)) as i from t" for k, p in enumerate(_PATTERNS))

OP5 = rf"""with {TEXTS}, x as ({_MATCHES}), y as (select r, kind, value, case kind when 0 then regexp_extract(value, '{_ASSIGN}', 2) else value end as secret, sum(length(gap) + coalesce(length(value), 0)) over (partition by r, kind order by i) as stop from x),
    z as (select r, kind, secret, cast(stop - length(value) as bigint) as start, cast(stop as bigint) as stop from y where value is not null and case kind when 0 then length(secret) >= 12 when 1 then length(value) >= 18 when 2 then length(value) >= 16 else regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]') end),
    c as (select * from z where kind < 3 union all select z.* from z where kind = 3 and not exists (select 1 from z b where b.kind < 3 and b.r = z.r and b.start < z.stop and z.start < b.stop)),
    o as (select secret, count(distinct coalesce('s' || source, 'n')) <= 1 as live from c join t using (r) group by secret),
    j as (select r, kind, start, stop, live, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop as said from c join o using (secret)),
    n as (select r, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex, string_agg(said, ',' order by start, kind, stop) filter (where kind < 3) as base,
        string_agg(said, ',' order by start, kind, stop) filter (where kind < 3 or live) as spans, count(*) filter (where live) as n_live, count(*) filter (where not live and kind < 3) as n_copied from j group by r)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied from t left join n using (r)"""

OP8 = "select doc_id, lang, source, n_chars, sha256(coalesce(text, '')) as text_sha256, true as compacted from documents"

OP12 = rf"""with v as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    k as (select conv_id, turn, role, text, len(regexp_extract_all(text, {SPACED})) as w from v),
    a as (select conv_id, list({{'r': role, 't': text, 'w': w}} order by turn nulls first, md5(strlen(role) || ':' || role || text)) as turns from k group by conv_id),
    crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) as row_),
    h as (select conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda y: cast(ascii(y) as bigint))), lambda c, b: xor(c >> 8, row_[(xor(c, b) & 255) + 1])), 4294967295) % 4 as h from a, crc),
    b as (select h.conv_id, list_concat(coalesce(f.turns, [])[1 : h.h], h.turns[h.h + 1 :]) as path from h left join a f on f.conv_id = h.conv_id - h.conv_id % 20),
    m as (select conv_id, len(path) as n, unnest(range(0, len(path) + 1)) as depth, path from b),
    p as (select conv_id, n, depth, list_transform(path[1:depth], lambda y: {{'r': y.r, 't': y.t}}) as key, list_transform(path[1 : depth - 1], lambda y: {{'r': y.r, 't': y.t}}) as up, case when depth > 0 then path[depth].w else 0 end as w from m),
    n as (select depth, key, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = depth), '')) as ends_sha256 from p group by depth, key),
    c as (select depth - 1 as depth, up as key, count(*) as n_children from n where depth > 0 group by 1, 2),
    g as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (depth, key)),
    s as (select t.depth, t.key, count(*) filter (where u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.w) as saved_tokens from g t join g u on u.depth >= t.depth and u.key[1 : t.depth] = t.key group by 1, 2)
    select g.conv_id, g.depth, x.conv_id as parent_conv_id, g.n_convs, g.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, g.ends_sha256 from g join s using (depth, key) left join g x on x.depth = g.depth - 1 and x.key = g.up"""

OP13 = """with q as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
        from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.r as ar, a.vec_id as anchor_id, x.r as xr, x.vec_id as vec_id, a.label = x.label as same, cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda k: a.q[k] * x.q[k])) as bigint) as score from q a join q x on a.r <> x.r where a.vec_id % 50 = 0),
    p as (select * from (select *, row_number() over (partition by ar order by score desc, vec_id, xr) as k from s where same) where k <= 5),
    n as (select p.anchor_id, p.ar, p.k, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.ar, p.k order by s.score desc, s.vec_id, s.xr) as rank
        from p join s on s.ar = p.ar and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
    select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3"""

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": OP2,
    "op5_secrets": OP5,
    "op6_quality_rules": OP6,
    "op7_substring_dedup": OP7,
    "op8_shards": OP8,
    "op10_decontamination": OP10,
    "op12_prefix_trie": OP12,
    "op13_hard_negatives": OP13,
}
