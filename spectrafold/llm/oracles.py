"""SQL for DuckDB that gives the rows of the operators' queries, where SQL can: all pairs, all seats, recursion."""

from __future__ import annotations

from .secret_scan import KINDS, MAX_REPOS, NEAR

#: Upper and lower case of the letters that count as such.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"


def seats(rows: str, group: str, child: str, weight: str, seats: str, out: str) -> str:
    """The highest quotients weight / (1, 3, 5, ...) of each group, listed one by one."""
    return f"""(select {group}, {child}, count(*) as {out} from (select {group}, {child}, {seats}, row_number() over (partition by {group} order by {weight} / (2 * k - 1) desc, {child}) as n
      from (select *, unnest(range(1, cast({seats} as bigint) + 1)) as k from {rows} where {weight} > 0)) where n <= {seats} group by {group}, {child})"""


def mix(block_words: int = 32, shard_words: int = 16384, band: int = 1024, most: int = 3, seed: str = "mix-1") -> str:
    return f"""with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as bigint) as size from documents),
    per as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as src from sized group by source),
    ranked as (select *, (src - 1) % 3 + 1 as weight, {most} * source_size as cap from per),
    filled as (select *, sum(source_size) over () as all_words, sum(weight) over () - coalesce(sum(weight) over before, 0) as left_weight, sum(source_size) over () - coalesce(sum(cap) over before, 0) as left_words
      from ranked window before as (order by cap::double / weight, src rows between unbounded preceding and 1 preceding)),
    level as (select arg_min(left_words::double, (cap::double / weight, src)) as lw, arg_min(left_weight::double, (cap::double / weight, src)) as lq from filled where cap * left_weight::double > weight * left_words::double),
    sources as (select source, src, source_size, least(cap::double, coalesce(weight * lw / lq, cap::double)) as target, cast(least({block_words}, greatest(1, floor(all_words / 4096))) as bigint) as words,
      cast(round(all_words::double / least({block_words}, greatest(1, floor(all_words / 4096)))) as bigint) as all_seats, 0 as g, cast(greatest(1, ceil(source_size / {shard_words}.0::double)) as bigint) as shards from filled, level),
    won as {seats('sources', 'g', 'src', 'target', 'all_seats', 'source_seats')},
    named as (select sources.*, coalesce(source_seats, 0) as source_seats from sources left join won using (src)),
    keyed as (select d.doc_id, d.source, d.size, source_size, target, src, words, source_seats, md5('{seed}|' || coalesce(cast(d.doc_id as varchar), '')) as key, shards from sized d join named s on d.source is not distinct from s.source),
    placed as (select *, cast(('0x' || substr(key, 1, 8)) as bigint) % shards as shard from keyed),
    begun as (select *, coalesce(sum(size) over (partition by src, shard order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start from placed),
    cells as (select src, shard, cast(floor(shard / {band}) as bigint) as band, sum(size)::double as length, any_value(words) as words, any_value(source_seats) as source_seats from begun group by 1, 2),
    bands as (select src, band, sum(length) as length, any_value(source_seats) as source_seats from cells group by 1, 2),
    wonb as {seats('bands', 'src', 'band', 'length', 'source_seats', 'band_seats')},
    inb as (select cells.*, src * 1000000 + band as g, band_seats from cells join wonb using (src, band)),
    wonc as {seats('inb', 'g', 'shard', 'length', 'band_seats', 'quota')},
    dealt as (select src, shard, cast(ceil(length / words) as bigint) as blocks, least(coalesce(quota, 0), {most} * cast(ceil(length / words) as bigint)) as quota from cells left join wonc on g = src * 1000000 + band and wonc.shard = cells.shard where length > 0) ,
    turns as (select src, shard, blocks, quota // blocks as epochs, quota % blocks as extra from dealt),
    blocks as (select src, shard, extra, unnest(range(0, blocks)) as block from turns where extra > 0),
    drawn as (select src, shard, block from (select *, row_number() over (partition by src, shard order by md5('{seed}|' || src || '|' || shard || '|' || block), block) as n from blocks) where n <= extra),
    spans as (select *, unnest(range(cast(start // words as bigint), cast((start + size - 1) // words as bigint) + 1)) as block from begun where size > 0),
    parts as (select src, shard, start, sum(least(start + size, (block + 1) * words) - greatest(start, block * words)) as part from spans join drawn using (src, shard, block) group by 1, 2, 3)
    select b.doc_id, b.size, b.source_size, b.target, cast(case when b.size = 0 then 0 else coalesce(t.epochs, 0) * b.size + coalesce(p.part, 0) end as bigint) as taken, b.source
    from begun b left join turns t using (src, shard) left join parts p on b.size > 0 and p.src = b.src and p.shard = b.shard and p.start = b.start""".replace("cells left join wonc on g = src * 1000000 + band and wonc.shard = cells.shard", "(select *, src * 1000000 + band as g from cells) c left join wonc using (g, shard)")


def components(nodes: str, links: str) -> str:
    """reached(id, component): the smallest id that links lead to; links hold both directions."""
    return f"""walk(id, other) as (select id, id from {nodes} union select walk.id, y from walk join {links} on x = walk.other),
    reached as (select id, min(other) as component from walk group by id)"""


def jaccard(size: int = 4, percent: int = 85) -> str:
    return f"""with recursive w as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') as w from documents),
    sets as (select id, list_distinct(case when len(w) >= {size} then [array_to_string(w[i:i + {size - 1}], ' ') for i in range(1, len(w) - {size - 2})] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
    rows as (select id, len(s) as n, unnest(s) as shingle from sets),
    pairs as (select a.id as a, b.id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as shared from rows a join rows b on a.shingle = b.shingle and a.id < b.id group by 1, 2),
    near as (select a, b from pairs where 100 * shared >= {percent} * (n + m - shared)), links as (select a as x, b as y from near union all select b, a from near), {components('sets', 'links')}
    select sets.id as doc_id, cast(len(s) as bigint) as n_shingles, component as component_id from sets join reached using (id)"""


def near_vectors(cosine: float = 0.93) -> str:
    return f"""with recursive fine as (select vec_id as id, label, embedding::double[] as v from embeddings where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0),
    near as (select a.id as a, b.id as b from fine a join fine b on a.label = b.label and len(a.v) = len(b.v) and a.id < b.id where list_cosine_similarity(a.v, b.v) >= {cosine}),
    links as (select a as x, b as y from near union all select b, a from near), nodes as (select vec_id as id from embeddings), {components('nodes', 'links')}
    select id as vec_id, (select count(*) from links where x = id) as n_links, component as component_id, id = component as kept from reached"""


def hard_negatives(divisor: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    """All pairs of anchors and rows, by their whole-numbered products."""
    return f"""with fine as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
      where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from fine a join fine b on a.vec_id % {divisor} = 0 and a.vec_id != b.vec_id and len(a.v) = len(b.v)),
    positives as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scored where same) where n <= {positives}),
    ranked as (select anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by anchor_id, p.vec_id order by s.score desc, s.vec_id) as integer) as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
      from positives p join scored s using (anchor_id) where not s.same and {low} * p.score <= 100 * s.score and 100 * s.score <= {high} * p.score)
    select * from ranked where rank <= {negatives}"""


def secrets(max_owners: int = 2, max_repos: int = MAX_REPOS, near: int = NEAR) -> str:
    """Matches lie between the pieces that splitting leaves. A use of a value is what stands around it, copies once; owners are taken one by one until those taken hold all uses."""
    parts = []
    for order, (kind, pattern, least, group) in enumerate(KINDS):
        sql = pattern.replace("'", "''")
        value = f"regexp_extract(m, '{sql}', {group})" if group else "m"
        parts.append(f"""select id, doc_id, source, {order} as ord, '{kind}' as kind, stop - length(m) as start, stop, {value} as value, place from (select id, doc_id, source, m[i] as m, list_sum([length(g[j]) + length(m[j]) for j in range(1, i + 1)])::bigint as stop,
            [right(coalesce(case when i > 1 then m[i - 1] end, '') || g[i], {near}), left(coalesce(g[i + 1], '') || coalesce(m[i + 1], ''), {near})] as place
          from (select id, doc_id, source, regexp_extract_all(text, '{sql}', 0) as m, string_split_regex(text, '{sql}') as g, unnest(range(1, len(regexp_extract_all(text, '{sql}', 0)) + 1)) as i from docs)) where length({value}) >= {least}""")
    left = """left0 as (select uses.* from uses join held using (value) where alone <= {n})"""
    for i in range(max_owners):
        left += f""", each{i} as (select value, owner, max(sole) as sole, count(*) as n from left{i} join (select value, place, min(owner) = max(owner) as sole from left{i} group by 1, 2) using (value, place) group by 1, 2),
    taken{i} as (select value, arg_max(owner, (sole, n, owner)) as owner from each{i} group by 1),
    left{i + 1} as (select * from left{i} l where not exists (select 1 from left{i} o join taken{i} t using (value, owner) where o.value = l.value and o.place = l.place))"""
    return f"""with docs as (select row_number() over () as id, doc_id, source, coalesce(text, '') as text from documents), spans as ({' union all '.join(parts)}),
    uses as (select distinct value, place, coalesce('=' || source, '') as owner from spans),
    lone as (select value, count(distinct owner) as alone from (select value, place, min(owner) as owner from uses group by 1, 2 having min(owner) = max(owner)) group by 1),
    held as (select value, coalesce(any_value(alone), 0) as alone from uses left join lone using (value) group by 1 having count(distinct owner) > {max_owners}),
    {left.format(n=max_owners)},
    many as (select value from held where alone > {max_owners} union select value from left{max_owners}),
    everywhere as (select value from spans group by 1 having least(count(distinct place), count(distinct coalesce(doc_id, -1))) > {max_repos}),
    judged as (select s.*, case when value in (select value from many union select value from everywhere) then 'example' when regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= 8 then 'live' else 'weak' end as verdict from spans s),
    every as (select distinct id, start, ord, stop, kind from judged union select distinct id, stop - length(value), {len(KINDS)}, stop, 'live' from judged where verdict = 'live'),
    listed as (select id, string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord, stop) as spans, string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord, stop) filter (kind != 'live') as base from every group by 1),
    counted as (select id, {', '.join(f"count(*) filter (kind = '{k[0]}') as n_{k[0]}" for k in KINDS)}, count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example from judged group by 1)
    select doc_id, {', '.join(f'coalesce(n_{k[0]}, 0) as n_{k[0]}' for k in KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
    from docs left join listed using (id) left join counted using (id)"""
