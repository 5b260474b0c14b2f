"""DuckDB SQL for the operators of this subpackage that SQL can express, over the same Parquet tables."""

from __future__ import annotations

CASCADE_SQL = r"""
with texts as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
parts as (
    select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from texts
),
places as (select row_id, words, unnest(range(1, len(words) - 3)) as i from parts),
windows as (select row_id, i, array_to_string(words[i : i + 4], ' ') as w from places),
repeated as (select row_id, i from windows qualify count(*) over (partition by row_id, w) > 1),
steps as (select row_id, least(5, coalesce(lead(i) over (partition by row_id order by i) - i, 5)) as step from repeated),
covered as (select row_id, sum(step) as n from steps group by row_id),
counts as (
    select doc_id, cast(len(words) as bigint) as n_words,
        cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
        len(lines) as n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as upper,
        length(text) - length(replace(text, '!', '')) as marks
    from parts left join covered using (row_id)
),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_symbols > 3 * n_words
        or 10 * n_dup_lines > 3 * n_lines or 10 * upper > 6 * word_chars or 10 * marks > 5 * n_words) as kept
from judged
"""

TOP_SQL = """
with base as (
    select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) as bigint) as score
    from base q join base c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 5
"""


def manifest_sql(fanout: int = 16) -> str:
    """The manifest level by level: nodes of all levels, the siblings of each leaf, and the fold over them."""
    field = lambda x: f"coalesce(cast(strlen(cast({x} as varchar)) as varchar) || ':' || cast({x} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bits = "list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda b, z: xor(b >> 1, 3988292384 * (b & 1)))"
    codes = "list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))"
    crc = f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), {codes}), lambda a, c: {bits}))"
    up = f"select name, level + 1, idx // {fanout}, sha256(string_agg(digest, '' order by idx)), max((n + {fanout - 1}) // {fanout})"
    joined = lambda cond: f"coalesce(string_agg(x.digest, '' order by x.idx) filter (where x.idx {cond} m.rank // power({fanout}, x.level)::bigint), '')"
    siblings = lambda nodes: f"{joined('<')} as l, {joined('>')} as r from members m join {nodes} x on x.name = m.name and x.n > 1 and x.idx // {fanout} = m.rank // power({fanout}, x.level + 1)::bigint group by all"
    return f"""
with recursive leaves as (
    select row_number() over () as row_id, doc_id, coalesce('=' || source, '') as name, {leaf("text")} as leaf,
        case when {crc} % 5 = 0 then {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} end as tampered
    from documents
),
numbered as (
    select *, row_number() over (partition by name order by doc_id nulls first, leaf) - 1 as rank, count(*) over (partition by name) as n from leaves
),
nodes(name, level, idx, digest, n) as (
    select name, 0, rank, leaf, n from numbered
    union all
    {up} from nodes where n > 1 group by name, level, idx // {fanout}
),
subroots as (select name, digest, row_number() over (order by name) - 1 as rank, count(*) over () as n from nodes where n = 1),
tops(name, level, idx, digest, n) as (
    select '', 0, rank, digest, n from subroots
    union all
    {up} from tops where n > 1 group by name, level, idx // {fanout}
),
low as (with members as (select row_id, name, rank from numbered) select m.row_id, x.level as step, {siblings("nodes")}),
high as (with members as (select name as own, '' as name, rank from subroots) select m.own, x.level + 100 as step, {siblings("tops")}),
steps as (
    select row_id, step, l, r from low
    union all
    select row_id, step, l, r from high join numbered on own = name
),
path as (select row_id, l, r, row_number() over (partition by row_id order by step) as pos, count(*) over (partition by row_id) as n from steps),
fold(row_id, pos, h) as (
    select row_id, cast(0 as bigint), coalesce(tampered, leaf) from leaves
    union all
    select row_id, path.pos, sha256(l || h || r) from fold join path using (row_id) where path.pos = fold.pos + 1
),
ends as (select row_id, max_by(h, pos) as folded_root from fold group by row_id),
proofs as (select row_id, sha256(string_agg(l || r, '' order by pos)) as proof_sha256 from path group by row_id)
select doc_id, leaf, s.digest as subroot, (select digest from tops where n = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256,
    folded_root, folded_root = (select digest from tops where n = 1) as verified
from numbered m join subroots s using (name) join ends using (row_id) left join proofs using (row_id)
"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Lloyd's rounds written out: each round's codebook is the one before it, replaced where an entry is used."""
    sql = f"""
with base as (
    select row_number() over () as row_id, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
size as (select max(len(v)) // {parts} as width from base),
cut as (select row_id, vec_id, part, v[part * width + 1 : (part + 1) * width] as p from base, size, (select unnest(range({parts})) as part)),
book0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, p as z from cut where vec_id is not null qualify entry < {entries}),
"""
    near = "select row_id, part, p, min((list_sum(list_transform(list_zip(p, z), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), entry)) as best from cut join {book} using (part) group by row_id, part, p"
    for i in range(rounds):
        sql += f"""near{i} as materialized ({near.format(book=f"book{i}")}),
means{i} as (
    select part, entry, list(m order by pos) as z from (
        select part, entry, pos, cast(floor(sum(p[pos]) / count(*)) as bigint) as m
        from (select part, best[2] as entry, p, unnest(range(1, len(p) + 1)) as pos from near{i}) group by part, entry, pos
    ) group by part, entry
),
book{i + 1} as materialized (select part, entry, coalesce(means{i}.z, book{i}.z) as z from book{i} left join means{i} using (part, entry)),
"""
    return (
        sql
        + f"""last as materialized ({near.format(book=f"book{rounds}")}),
coded as (select row_id, string_agg(format('{{:02x}}', best[2]), '' order by part) as code, cast(sum(best[1]) as bigint) as error from last group by row_id),
digest as (select sha256(string_agg(list_aggregate(z, 'string_agg', ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from base join coded using (row_id), digest
"""
    )
