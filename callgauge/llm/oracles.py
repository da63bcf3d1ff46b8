"""DuckDB statements for the operators that SQL can express, written from the contracts."""

MIX = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as place
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         [3, 1, 2][1 + ((row_number() over (order by source collate C nulls last) - 1) % 3)::int] as weight
  from d group by source
), r as (
  select *, 2 * source_size as cap, 2 * source_size / weight as ratio from s
), l as (
  select ratio, (1.5 * (select sum(source_size) from s) - coalesce(sum(cap) over w, 0))::double
         / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from r window w as (order by ratio rows between unbounded preceding and 1 preceding)
), g as (
  select arg_min(level, ratio) as level from l where level <= ratio
), t as (
  select source, source_size, least(cap::double, (select level from g) * weight) as target from r
), p as (
  select d.*, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end as whole
  from d join t on d.source is not distinct from t.source
), q as (
  select *, sum(size) over (partition by source order by place, size rows unbounded preceding) - size / 2 as middle from p
)
select doc_id, size, source_size, target,
       (size * (whole + case when middle <= target - whole * source_size then 1 else 0 end))::bigint as taken
from q
"""

DECONTAMINATE = """
with t as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark
), g as (
  select distinct item_id, least(len(words), 10) as size, words[s.unnest : s.unnest + least(len(words), 10) - 1] as gram
  from b, unnest(range(1, greatest(len(words) - 10, 0) + 2)) s where len(words) > 0
), w as (
  select doc_id, p.unnest as pos, words[p.unnest] as word, words from t, unnest(range(1, len(words) + 1)) p
), m as (
  select w.doc_id, g.item_id, w.pos, g.size from g join w on w.word = g.gram[1]
  where w.words[w.pos : w.pos + g.size - 1] = g.gram
), h as (
  select doc_id, count(distinct pos + o.unnest) as n_hit from m, unnest(range(0, size)) o group by doc_id
), i as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, item_id::varchar as item_id from m) group by doc_id
)
select t.doc_id, coalesce(len(t.words), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from t left join h using (doc_id) left join i using (doc_id)
"""

CHAT = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, role || text as x, length(role || text) + 17
         + (length(role) - length(replace(role, '\', ''))) + (length(text) - length(replace(text, '\', '')))
         + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
         + (length(text) - length(replace(text, '[INST]', ''))) // 6
         + (length(text) - length(replace(text, '[/INST]', ''))) // 7 as chars
  from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from e group by conv_id
"""

WARC = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex,
         max(page_id) over (partition by sha1(payload)) as winner
  from p
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31)::int, 1)), '') as payload_digest,
       case when page_id = winner or winner is null then 'response' else 'revisit' end as record_type,
       case when page_id = winner then null else winner end as refers_to
from d
"""

EMBEDDINGS = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
), ok as (
  select vec_id, label, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) as norm from v
  where vec_id is not null and label is not null and len(x) > 0 and list_count(x) = len(x)
    and len(list_filter(x, lambda y: isfinite(y))) = len(x) and len(list_filter(x, lambda y: y <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id
  where list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93
), reach as (
  select vec_id as node, vec_id as root from embeddings
  union
  select l.b, reach.root from reach join l on l.a = reach.node
), c as (
  select node, min(root) as component_id from reach group by node
), n as (
  select a, count(*) as n from l group by a
)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, coalesce(e.vec_id = component_id, false) as kept
from embeddings e left join c on c.node = e.vec_id left join n on n.a = e.vec_id
"""

#: Levels of a tree that the statement has: up to 16 ** LEVELS leaves in one.
LEVELS = 6


def _tree(name: str, leaves: str) -> str:
    """Tables of a 16-ary tree over ``leaves`` (grp, pos, d, n): nodes by level as ``name_k`` with the digests beside each."""
    steps = []
    for k in range(LEVELS):
        nodes = leaves if k == 0 else f"""(select grp, pos // 16 as pos, case when min(n) > 1 then sha256(string_agg(d, '' order by pos)) else min(d) end as d,
            (min(n) + 15) // 16 as n from {name}_{k - 1} group by grp, pos // 16)"""
        steps.append(f"""{name}_{k} as (
  select *, coalesce(string_agg(d, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(d, '') over (w rows between 1 following and unbounded following), '') as r
  from {nodes} x window w as (partition by grp, pos // 16 order by pos)
)""")
    steps.append(f"{name}_top as (select grp, case when min(n) > 1 then sha256(string_agg(d, '' order by pos)) else min(d) end as d from {name}_{LEVELS - 1} group by grp)")
    return ",\n".join(steps)


def _way(name: str, base: str, digest: str) -> str:
    """``base`` (grp, pos, ``digest``, ``proof``) carried up through the levels of a tree."""
    for k in range(LEVELS):
        base = f"""(select b.* replace (b.proof || t.l || t.r as proof, case when t.n > 1 then sha256(t.l || b.{digest} || t.r) else b.{digest} end as {digest})
  from {base} b join {name}_{k} t on t.grp = b.grp and t.pos = b.pos // {16**k})"""
    return base


def _field(column: str, value: str | None = None) -> str:
    text = value or f"{column}::varchar"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""

MERKLE = f"""
with d as (
  select doc_id, coalesce('=' || source, '') as grp, sha256({_HEAD} || {_field("text")}) as leaf,
         sha256({_HEAD} || {_field("text", _LOWER)}) as lowered, coalesce({_CRC} % 5 = 0, false) as tried
  from documents
), a as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos, leaf as d, count(*) over (partition by grp) as n from d
), {_tree("t", "(select grp, pos, d, n from a)")}, s as (
  select grp as source, d as subroot, 0 as grp, row_number() over (order by grp collate C) - 1 as pos, d, count(*) over () as n from t_top
), {_tree("u", "(select grp, pos, d, n from s)")}, x as (
  select * from {_way("t", "(select *, case when tried then lowered else leaf end as f, '' as proof from a)", "f")}
), y as (
  select * from {_way("u", "(select x.doc_id, x.leaf, x.f, x.proof, s.grp, s.pos, s.subroot from x join s on s.source = x.grp)", "f")}
)
select doc_id, leaf, subroot, u_top.d as root, sha256(proof) as proof_sha256, f as folded_root, f = u_top.d as verified
from y, u_top
"""
