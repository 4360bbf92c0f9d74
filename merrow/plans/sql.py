"""DuckDB SQL for the registered queries, over the same views of the driver tables."""

from __future__ import annotations

from merrow.sources.views import CUTOFF, NOW

_UNITS = "cast(round(cast(greatest(0.0, least(1.0, {})) as decimal(20,18)) * 1000000) as bigint)"

_VIEWS = {
    "interactions": """
  select event_id as id, user_id, json_extract(props, '$.k')::bigint as item_id, kind as interaction_type,
    case when kind = 'rated' then (round(least(value, 100.0) / 5) / 2)::decimal(5,2) end as value, ts as occurred_at
  from (select *, case event_type when 'view' then 'viewed' when 'click' then 'liked' when 'error' then 'disliked' when 'signup' then 'wishlisted'
    else case when event_id % 2 = 0 then 'rated' else 'played' end end as kind from events)""",
    "items": """
  select d.doc_id as id, array_to_string(string_split(text, ' ')[1:4], ' ') as title, 'doc-' || d.doc_id as slug, text as description,
    (date '2015-01-01' + (d.doc_id % 3650)::int)::date as release_date, source as developer,
    (4 + 4 * quality - 2 * toxic + (d.doc_id % 10) / 10)::decimal(4,2) as average_rating, (n_chars % 5000)::int as rating_count,
    (coalesce(c.n, 0) + (d.doc_id % 97) / 10)::decimal(10,4) as popularity_score, lang, source
  from documents d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l on l.doc_id = d.doc_id
  left join (select item_id, count(*) as n from interactions group by item_id) c on c.item_id = d.doc_id""",
    "taxonomy": """
  select distinct * from (
    select id, 'genre' as family, lang as slug from items union all select id, 'tag', source from items
    union all select id, 'platform', 'p' || id % 4 from items union all select id, 'platform', 'p' || id % 6 from items)""",
    "part_items": """
  select p_partkey as id, p_name as title, 'part-' || p_partkey as slug, p_brand as developer, p_size as rating_count, p_retailprice::decimal(10,4) as popularity_score from part""",
    "part_genres": "select p_partkey as id, lower(p_type) as slug, p_type as name from part",
    "part_tags": "select distinct id, slug, slug as name from (select p_partkey as id, unnest(string_split(p_name, ' ')) as slug from part)",
    "part_platforms": """
  select distinct l_partkey as id, 'n' || s_nationkey as slug, 'n' || s_nationkey as name from lineitem join supplier on l_suppkey = s_suppkey""",
    "preferences": """
  select user_id, 'game' as preference_type, 'doc-' || item_id as value from (
    select user_id, item_id, row_number() over (partition by user_id order by count(*) desc, item_id) as place from interactions
    where interaction_type = 'viewed' group by user_id, item_id) where place <= 3
  union all select user_id, t, v from (
    select user_id, unnest(['genre', 'tag', 'platform', 'game']) as t,
      unnest(['en', 'src' || user_id % 20, 'p' || user_id % 6, case when user_id % 10 = 0 then 'doc-999999999' end]) as v
    from (select distinct user_id from events)) where v is not null""",
    "known": "select distinct family, slug from taxonomy union all select 'game', slug from items",
    "users": """
  select user_id as id, created_at, case when not legacy then created_at end as consented_at,
    case when not legacy then case when user_id % 5 = 0 then 'v0' else 'v1' end end as consent_version,
    case when not legacy then created_at + to_days((user_id % 30 + 1)::int) end as expires_at,
    case when legacy or user_id % 7 = 0 then created_at + to_days(10) end as revoked_at
  from (select user_id, min(ts) as created_at, user_id % 11 = 0 as legacy from events group by user_id)""",
    "rec_events": "select 'gen-' || event_id as generation_id, user_id, ts as generated_at from events where event_type = 'view'",
    "log": """
  select * exclude (dimension, newer), case when interaction_type <> 'viewed' and newer is not null then greatest(occurred_at, newer) end as superseded_at from (
    select *, lag(occurred_at) over (partition by user_id, item_id, dimension order by occurred_at desc, id desc) as newer
    from (select *, case when interaction_type in ('liked', 'disliked') then 'reaction' else interaction_type end as dimension from interactions))""",
    "active": "select * from log where superseded_at is null and interaction_type <> 'viewed'",
    "state": """
  select user_id, item_id, max(interaction_type) filter (interaction_type in ('liked', 'disliked')) as reaction,
    max(occurred_at) filter (interaction_type in ('liked', 'disliked')) as reaction_at,
    bool_or(interaction_type = 'played') as played, bool_or(interaction_type = 'wishlisted') as wishlisted,
    max(value) filter (interaction_type = 'rated') as rating, max(occurred_at) filter (interaction_type = 'rated') as rating_at,
    max(occurred_at) as latest_at
  from active group by user_id, item_id""",
    "token": """
  select doc_id, word, row_number() over (partition by doc_id order by i) as i from (
    select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents))
  where length(word) >= 2""",
    "tf": """
  select 'doc-' || doc_id as slug, term, count(*) as tf from (
    select doc_id, word as term from token
    union all select doc_id, word || ' ' || next from (select doc_id, word, lead(word) over (partition by doc_id order by i) as next from token) where next is not null)
  group by all""",
    "idf": "select term, count(*) as df, ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from tf group by term",
    "baseline": """
  select slug, (case when hb - lb <= 1e-15 then 0.5 else (blended - lb) / (hb - lb) end * 700000
    + case when hs - ls <= 1e-15 then 0.5 else (signal - ls) / (hs - ls) end * 300000) / 1000000 as popularity
  from (select *, min(blended) over () as lb, max(blended) over () as hb, min(signal) over () as ls, max(signal) over () as hs from (
    select slug, popularity_score::double as signal,
      rating_count::double / (rating_count + 50.0::double) * (coalesce(average_rating::double, m) / 10) + 50.0::double / (rating_count + 50.0::double) * (m / 10) as blended
    from items, (select coalesce(sum(average_rating::double * rating_count) / nullif(sum(rating_count::double) filter (average_rating is not null), 0), 5.0) as m from items)))""",
    "document": """
  select slug, tw || tw || [g, g, g] || [t, t, t] || [d] || dw as w from (
    select slug, regexp_extract_all(lower(strip_accents(title)), '[a-z0-9]+') as tw, regexp_extract_all(lower(strip_accents(coalesce(description, ''))), '[a-z0-9]+') as dw,
      'genre_' || replace(lang, '-', '_') as g, 'tag_' || replace(source, '-', '_') as t,
      'developer_' || array_to_string(regexp_extract_all(lower(strip_accents(source)), '[a-z0-9]+'), '_') as d from items)""",
    "content_token": """
  select slug, word, row_number() over (partition by slug order by i) as i from (select slug, unnest(w) as word, generate_subscripts(w, 1) as i from document)
  where length(word) >= 2""",
    "content_tf": """
  select slug, term, count(*) as tf from (
    select slug, word as term from content_token
    union all select slug, word || ' ' || next from (select slug, word, lead(word) over (partition by slug order by i) as next from content_token) where next is not null)
  group by all""",
    "content_idf": "select term, count(*) as df, ln((1 + (select count(*) from items)) / (1 + count(*))) + 1 as idf from content_tf group by term",
    "weight": """
  select slug, term, raw / sqrt(sum(raw * raw) over (partition by slug)) as weight from (select slug, term, (1 + ln(tf)) * idf as raw from content_tf join content_idf using (term))""",
    "context": """
  select user_id, coalesce(list_sort(list(distinct value) filter (preference_type = 'game')), []) as selected,
    coalesce(list_sort(list(distinct value) filter (preference_type = 'genre')), []) as genres, coalesce(list_sort(list(distinct value) filter (preference_type = 'tag')), []) as tags,
    coalesce(list_sort(list(distinct value) filter (preference_type = 'platform')), []) as platforms, 5 + user_id % 6 as top_k
  from preferences p where exists (select 1 from known k where k.family = p.preference_type and k.slug = p.value) group by user_id""",
    # what a context picks and prefers: its content ranking starts from these
    "asked": "select * from context",
    "wanted_term": """
  select user_id, term, (1 + ln(tf)) * idf as raw from (
    select user_id, term, count(*) as tf from (
      select user_id, word as term from wanted_token union all select user_id, word || ' ' || next from (
        select user_id, word, lead(word) over (partition by user_id order by i) as next from wanted_token) where next is not null) group by all) join content_idf using (term)""",
    "wanted_token": """
  select user_id, word, row_number() over (partition by user_id order by i) as i from (
    select user_id, unnest(w) as word, generate_subscripts(w, 1) as i from (
      select user_id, list_transform(genres, lambda x: 'genre_' || replace(x, '-', '_')) || list_transform(tags, lambda x: 'tag_' || replace(x, '-', '_')) as w from asked))
  where length(word) >= 2""",
    "vector": """
  select user_id, term, w / sqrt(sum(w * w) over (partition by user_id)) as weight from (
    select user_id, term, sum(w) as w from (
      select m.user_id, term, m / sqrt(sum(m * m) over (partition by m.user_id)) * case when len(genres) + len(tags) > 0 then 0.65::double else 1 end as w
      from (select user_id, term, sum(weight) / any_value(len(selected)) as m from (select *, unnest(selected) as slug from asked) join weight using (slug) group by user_id, term) m
      join asked a on a.user_id = m.user_id
      union all select w.user_id, term, raw / sqrt(sum(raw * raw) over (partition by w.user_id)) * case when len(selected) > 0 then 0.35::double else 1 end
      from wanted_term w join asked a on a.user_id = w.user_id)
    where user_id in (select user_id from asked where len(genres) + len(tags) = 0 union all select user_id from wanted_term)
    group by user_id, term)""",
    "scored": f"""
  select user_id, slug, content_units, platform_units, popularity_units,
    (content_units * 800000 + 500000) // 1000000 + (platform_units * 100000 + 500000) // 1000000 + (popularity_units * 100000 + 500000) // 1000000 as base_units
  from (
    select s.user_id, s.slug, content_units,
      {_UNITS.format("case when len(platforms) > 0 then len(list_intersect(has, platforms)) / len(platforms)::double else 0.0 end")} as platform_units,
      {_UNITS.format("popularity")} as popularity_units
    from (select user_id, slug, {_UNITS.format("sum(v.weight * w.weight)")} as content_units from vector v join weight w using (term) group by user_id, slug) s
    join asked a on a.user_id = s.user_id join (select slug, list(distinct slug_1) as has from (
      select i.slug, t.slug as slug_1 from items i join taxonomy t on t.id = i.id and t.family = 'platform') group by slug) h on h.slug = s.slug
    join baseline b on b.slug = s.slug where content_units > 0 and not list_contains(selected, s.slug))""",
    "source": """
  select * from (select *, row_number() over (partition by user_id order by occurred_at desc, slug)::int as place from (
    select user_id, slug, case when reaction = 'liked' then 'liked' when reaction is null and rating >= 7 then 'rating' end as kind,
      case when reaction = 'liked' then reaction_at else rating_at end as occurred_at from state join items on items.id = item_id) where kind is not null) where place <= 5""",
    "slug_state": "select state.*, slug from state join items on items.id = item_id",
}
# each view and what it reads
_NEEDS = {
    "document": ["items"], "content_token": ["document"], "content_tf": ["content_token"], "content_idf": ["content_tf", "items"], "weight": ["content_tf", "content_idf"],
    "context": ["preferences", "known"], "asked": ["context"], "wanted_token": ["asked"], "wanted_term": ["wanted_token", "content_idf"], "vector": ["asked", "weight", "wanted_term"],
    "scored": ["vector", "weight", "asked", "taxonomy", "baseline"], "source": ["state", "items"], "slug_state": ["state", "items"],
} | {"items": ["interactions"], "taxonomy": ["items"], "preferences": ["interactions"], "known": ["taxonomy", "items"], "log": ["interactions"], "active": ["log"], "state": ["active"], "tf": ["token"], "idf": ["tf"], "baseline": ["items"]}


#: Views that a query reads several times.
_REUSED = {"content_tf", "content_idf", "weight", "asked", "wanted_term", "vector", "scored", "state", "source"}


def _with(views: str, query: str, instead: dict[str, str] | None = None) -> str:
    """A query after the views that it reads, some of them with a text of its own."""
    order: list[str] = []
    texts = _VIEWS | (instead or {})

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    heads = ",\n".join(f"{n} as materialized ({texts[n]})" if n in _REUSED else f"{n} as ({texts[n]})" for n in order)
    return f"with {heads}\n{query}"


_ITEM_COLUMNS = "id, slug, average_rating, rating_count, release_date, popularity_score"
_ORDERS = {"popularity": "popularity_score desc, id", "rating": "average_rating desc nulls last, rating_count desc, id", "release": "release_date desc nulls last, id", "title": "lower(title), id"}

ORACLE_SQL: dict[str, str] = {f"catalog_page_{s}": _with("items", f"select {_ITEM_COLUMNS}, count(*) over () as total, ceil(count(*) over () / 20.0)::bigint as total_pages from items order by {o} limit 20 offset 20") for s, o in _ORDERS.items()} | {
    "catalog_deep_pages": _with("items", ", placed as (" + " union all ".join(
        f"select '{sort}' as sort, row_number() over (order by {order}) as place, id, (select greatest(1, (count(*) + 19) // 20) from items) as last from items" for sort, order in _ORDERS.items()) + """
), paged as (select *, (place - 1) // 20 + 1 as page from placed)
select sort, page, place, id from paged where page in (1, (last + 1) // 2, last)"""),
    "catalog_search_literal": _with("part_items", r"select q, count(id) as total, ceil(count(id) / 20.0)::bigint as total_pages from (select unnest(['red', 'WIDGET', '%', '_', '\']) as q) left join part_items on contains(lower(title), lower(q)) group by q"),
    "catalog_filter_taxonomy": _with("part_items part_genres part_tags part_platforms", """
select id, title, popularity_score from part_items where contains(lower(title), 'r') and id in (select id from part_genres where slug = 'economy')
  and id in (select id from part_tags where slug = 'red') and id in (select id from part_platforms where slug = 'n3') order by popularity_score desc, id limit 50"""),
    "catalog_nested": _with("part_items part_genres part_tags part_platforms", """
select i.id, coalesce(g.v, '') as genres, coalesce(t.v, '') as tags, coalesce(p.v, '') as platforms from part_items i
left join (select id, string_agg(name, ',' order by name, slug) as v from part_genres group by id) g on g.id = i.id
left join (select id, string_agg(name, ',' order by name, slug) as v from part_tags group by id) t on t.id = i.id
left join (select id, string_agg(name, ',' order by name, slug) as v from part_platforms group by id) p on p.id = i.id"""),
    "catalog_item": _with("part_items part_genres part_tags part_platforms", """
select id, title, (select count(*) from part_genres g where g.id = i.id)::int as genres, (select count(*) from part_tags g where g.id = i.id)::int as tags,
  (select count(*) from part_platforms g where g.id = i.id)::int as platforms from part_items i where id = 7"""),
    "catalog_items": _with("part_items part_genres part_tags part_platforms", """
select id, title, (select count(*) from part_genres g where g.id = i.id)::int as genres, (select count(*) from part_tags g where g.id = i.id)::int as tags,
  (select count(*) from part_platforms g where g.id = i.id)::int as platforms from part_items i"""),
    "catalog_changes": _with("items", """
select slug, 'removed' as change from items where id % 9 = 0
union all select slug, 'changed' from items where id % 9 <> 0 and id % 7 = 0
union all select slug || '-b', 'added' from items where id % 10 = 1"""),
    "model_states": """
select * from (values ('same', 'ready', null), ('changed', 'unavailable', 'catalog_stale'), ('invalid', 'unavailable', 'catalog_invalid'), ('none', 'not_configured', null)) t("case", status, reason)""",
    "feature_checks": _with("items", """
select rule, slug as key from items, (select unnest(['document_empty', 'row_without_weights']) as rule) where id % 17 = 0"""),
    "catalog_scan": _with("part_items part_genres part_tags part_platforms", """
select i.slug, i.popularity_score::double as popularity_score, coalesce(g.v, '') as genres, coalesce(t.v, '') as tags, coalesce(p.v, '') as platforms from part_items i
left join (select id, string_agg(slug, ',' order by slug) as v from part_genres group by id) g on g.id = i.id
left join (select id, string_agg(slug, ',' order by slug) as v from part_tags group by id) t on t.id = i.id
left join (select id, string_agg(slug, ',' order by slug) as v from part_platforms group by id) p on p.id = i.id"""),
    "taxonomy_lists": _with("part_genres part_tags part_platforms", """
select 'genre' as family, slug, name, count(distinct id) as items from part_genres group by all union all
select 'tag', slug, name, count(distinct id) from part_tags group by all union all select 'platform', slug, name, count(distinct id) from part_platforms group by all"""),
    "resolve_ids": _with("interactions items", "select user_id as request_id, n.id as place, item_id * 40 as id, i.slug from interactions n left join items i on i.id = item_id * 40 where item_id is not null"),
    "popularity_baseline": _with("baseline", f"select slug, {_UNITS.format('popularity')} as popularity_units from baseline"),
    "term_frequency": _with("tf", "select slug, count(*) as terms, sum(tf)::bigint as occurrences, max(tf) as most from tf group by slug"),
    "document_frequency_idf": _with("idf", "select term, df, round(idf, 9) as idf from idf"),
    "tfidf_weights": _with("tf idf", """
select slug, term, round(raw / sqrt(sum(raw * raw) over (partition by slug)), 6) as weight from (select slug, term, (1 + ln(tf)) * idf as raw from tf join idf using (term))"""),
    "context_checks": _with("preferences items", """
, c as (select user_id as context_id, list(value order by value) filter (preference_type = 'game') as selected, (5 + user_id % 6) * 3 as top_k from preferences group by user_id)
select context_id, 'top_k_out_of_range' as reason from c where top_k not between 1 and 20
union all select distinct context_id, 'selected_unknown' from (select context_id, unnest(selected) as slug from c) where slug not in (select slug from items)"""),
    "active_feedback": _with("state", "select * from state"),
    "feedback_pages": _with("state items", """
select item_id, slug, reaction, played, wishlisted, rating, latest_at, count(*) over () as total from state join items on items.id = item_id where user_id = 3 order by latest_at desc, item_id limit 20"""),
    "feedback_pages_all": _with("state items", """
select * from (
  select user_id, row_number() over (partition by user_id order by latest_at desc, item_id)::int as place, item_id, slug, reaction, played, wishlisted, rating, latest_at,
    count(*) over (partition by user_id) as total from state join items on items.id = item_id) where place <= 20"""),
    "recommend_evidence": _with("scored context weight items taxonomy", """
, placed as (
  select * from (select s.*, top_k, selected, genres, tags, platforms, row_number() over (
    partition by s.user_id order by base_units desc, content_units desc, popularity_units desc, slug)::int as rank from scored s join context c on c.user_id = s.user_id) where rank <= top_k
), close as (
  select p.user_id, p.slug, k.picked, cast(round(cast(least(1.0, sum(a.weight * b.weight)) as decimal(20,18)) * 1000000) as bigint) as units
  from placed p, unnest(selected) k(picked), weight a, weight b where a.slug = p.slug and b.slug = k.picked and a.term = b.term group by all
), near as (
  select user_id, c.slug, list({'slug': picked, 'title': title, 'units': units} order by units desc, picked) as "similar"
  from close c join items i on i.slug = c.picked where units > 0 group by all
), has as (
  select i.slug, list({'slug': t.slug, 'name': t.slug} order by t.slug) filter (family = 'genre') as genres, list({'slug': t.slug, 'name': t.slug} order by t.slug) filter (family = 'tag') as tags,
    list({'slug': t.slug, 'name': t.slug} order by t.slug) filter (family = 'platform') as platforms from items i join taxonomy t on t.id = i.id group by i.slug
), facts as (
  select p.user_id, p.rank, p.slug, base_units, content_units, platform_units, popularity_units, coalesce("similar"[1:3], []) as "similar",
    list_filter(h.genres, lambda v: list_contains(p.genres, v.slug)) as matching_genres, list_filter(h.tags, lambda v: list_contains(p.tags, v.slug)) as matching_tags,
    list_filter(h.platforms, lambda v: list_contains(p.platforms, v.slug)) as matching_platforms
  from placed p join has h on h.slug = p.slug left join near n on n.user_id = p.user_id and n.slug = p.slug
), told as (
  select *, list_filter([
    case when len("similar") > 0 then 'Its content profile is similar to ' || array_to_string(list_transform("similar"[1:2], lambda v: v.title), ', ') || '.' end,
    case when len(matching_genres) > 0 then 'It matches your preferred genres: ' || array_to_string(list_transform(matching_genres[1:3], lambda v: v.name), ', ') || '.' end,
    case when len(matching_tags) > 0 then 'It matches your preferred tags: ' || array_to_string(list_transform(matching_tags[1:3], lambda v: v.name), ', ') || '.' end,
    case when len(matching_platforms) > 0 then 'It is available on preferred platforms: ' || array_to_string(list_transform(matching_platforms[1:3], lambda v: v.name), ', ') || '.' end,
    case when popularity_units >= 700000 then 'Its catalog rating and popularity signals provide supporting evidence.' end], lambda x: x is not null) as found from facts
)
select user_id as context_id, rank, slug, base_units, array_to_string(list_transform("similar", lambda x: x.slug || ':' || x.units), ',') as "similar",
  array_to_string(list_transform(matching_genres, lambda x: x.slug), ',') as matching_genres, array_to_string(list_transform(matching_tags, lambda x: x.slug), ',') as matching_tags,
  array_to_string(list_transform(matching_platforms, lambda x: x.slug), ',') as matching_platforms,
  array_to_string(list_transform([('content', content_units, 800000), ('platform', platform_units, 100000), ('popularity', popularity_units, 100000)],
    lambda x: x[1] || ':' || x[2] || ':' || x[3] || ':' || (x[2] * x[3] + 500000) // 1000000), ',') as components,
  array_to_string(shown, ' ') as reasons, shown[1] as summary
from (select *, case when len(found) > 0 then found else ['Its catalog content is related to the context you selected.'] end as shown from told)"""),
    "supersession_backfill": _with("log", "select id, user_id, item_id, interaction_type, superseded_at from log"),
    "positive_sources": _with("state items", """
select * from (select *, row_number() over (partition by user_id order by occurred_at desc, slug)::int as place from (
  select user_id, slug, case when reaction = 'liked' then 'liked' when reaction is null and rating >= 7 then 'rating' end as kind,
    case when reaction = 'liked' then reaction_at else rating_at end as occurred_at from state join items on items.id = item_id) where kind is not null) where place <= 5"""),
    "replace_state": _with("interactions", f"""
, before as (
  select *, case when interaction_type in ('liked', 'disliked') then 'reaction' else interaction_type end as dimension from interactions where occurred_at < timestamp '{NOW}'
), old as (
  select *, interaction_type <> 'viewed' and row_number() over (partition by user_id, item_id, dimension order by occurred_at desc, id desc) = 1 as open from before
), after as (
  select *, case when interaction_type in ('liked', 'disliked') then 'reaction' else interaction_type end as dimension from interactions
  where occurred_at >= timestamp '{NOW}' and interaction_type <> 'viewed'
), wanted as (
  select user_id, item_id, interaction_type, value from after qualify row_number() over (partition by user_id, item_id, dimension order by occurred_at desc, id desc) = 1
), touched as (select distinct user_id, item_id from wanted), done as (
  select o.user_id, case when o.open and t.user_id is not null and not (w.user_id is not null and w.value is not distinct from o.value) then 'closed' else 'kept' end as change,
    o.open and not (t.user_id is not null and not (w.user_id is not null and w.value is not distinct from o.value)) as active
  from old o left join touched t using (user_id, item_id) left join wanted w on w.user_id = o.user_id and w.item_id = o.item_id and w.interaction_type = o.interaction_type
  union all select w.user_id, 'inserted', true from wanted w where not exists (
    select 1 from old o where o.open and o.user_id = w.user_id and o.item_id = w.item_id and o.interaction_type = w.interaction_type and o.value is not distinct from w.value)
)
select user_id, change, count(*) as rows, count(*) filter (active) as active from done group by all"""),
    "preferences_pivot": _with("preferences", """
select user_id, coalesce(string_agg(value, ',' order by value) filter (preference_type = 'game'), '') as selected, coalesce(string_agg(value, ',' order by value) filter (preference_type = 'genre'), '') as genres,
  coalesce(string_agg(value, ',' order by value) filter (preference_type = 'tag'), '') as tags, coalesce(string_agg(value, ',' order by value) filter (preference_type = 'platform'), '') as platforms
from preferences group by user_id"""),
    "preferences_replace": _with("preferences", """
, desired as (
  select user_id, preference_type, value from preferences where user_id % 3 = 0 and preference_type in ('game', 'genre')
  union all select distinct user_id, 'platform', 'p' || user_id % 5 from preferences where user_id % 3 = 0)
select coalesce(p.user_id, d.user_id) as user_id, coalesce(p.preference_type, d.preference_type) as preference_type, coalesce(p.value, d.value) as value, 1::decimal(4,3) as weight,
  case when p.user_id is null then 'inserted' when d.user_id is null and p.user_id % 3 = 0 then 'deleted' else 'kept' end as change
from preferences p full join desired d on p.user_id = d.user_id and p.preference_type = d.preference_type and p.value = d.value"""),
    "unknown_references": _with("preferences known", "select user_id as request_id, preference_type as family, value as slug from preferences p where not exists (select 1 from known k where k.family = p.preference_type and k.slug = p.value)"),
    "stale_references": _with("preferences known", """
select * from (select user_id, reference, row_number() over (partition by user_id order by reference)::int as place from (
  select distinct user_id, preference_type || ':' || value as reference from preferences p where not exists (select 1 from known k where k.family = p.preference_type and k.slug = p.value))) where place <= 26"""),
    "upsert_classify": _with("part_items part_tags", f"""
, old as (select i.slug, title, popularity_score, t.tags, i.id from part_items i join (select id, list(slug order by slug) as tags from part_tags group by id) t on t.id = i.id)
select slug, title, case when id % 4 <> 3 and id % 5 = 0 then popularity_score - 1 else popularity_score end as popularity_score,
  array_to_string(list_sort(case when id % 4 <> 3 and id % 7 = 0 then list_append(tags, 'sale') else tags end), ',') as tags,
  case when id % 4 <> 3 and (id % 5 = 0 or id % 7 = 0) then timestamp '{NOW}' else timestamp '{CUTOFF}' end as updated_at,
  case when id % 4 = 3 then 'kept' when id % 5 = 0 or id % 7 = 0 then 'updated' else 'unchanged' end as outcome from old
union all select slug || '-b', title, popularity_score, array_to_string(tags, ','), timestamp '{NOW}', 'inserted' from old where id % 10 = 0"""),
    "quality_checks": _with("items log users preferences", """
, item as (
  select id, case id % 13 when 0 then 'Not A Slug' when 1 then repeat('a', 221) else slug end as slug, case when id % 13 = 2 then repeat('t', 201) else title end as title,
    case when id % 13 = 3 then 11 else average_rating end as average_rating, case when id % 13 = 4 then -1 else rating_count end as rating_count,
    case when id % 13 = 5 then -1 else popularity_score end as popularity_score from items
), entry as (
  select id, case when id % 50 = 1 and interaction_type <> 'rated' then 'shared' else interaction_type end as kind, case when id % 50 = 0 then 11 else value end as value, occurred_at,
    case when id % 50 = 2 then occurred_at - interval 1 day else superseded_at end as superseded_at from log
), saved as (
  select user_id || ':' || preference_type || ':' || value as key, case when tag and user_id % 7 = 0 then 'mood' else preference_type end as kind, case when tag and user_id % 7 = 1 then '' else value end as value,
    case when tag and user_id % 7 = 2 then 2 else 1 end as weight from (select *, preference_type = 'tag' as tag from preferences)
), person as (
  select id, consent_version, consented_at, case when id % 9 = 0 then consented_at else expires_at end as expires_at, revoked_at from users
)
select 'items' as "table", 'slug_format' as rule, id::varchar as key from item where not regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$')
union all select 'items', 'slug_length', id::varchar from item where length(slug) > 220
union all select 'items', 'title_length', id::varchar from item where length(title) > 200
union all select 'items', 'average_rating_range', id::varchar from item where average_rating not between 0 and 10
union all select 'items', 'rating_count_range', id::varchar from item where rating_count < 0
union all select 'items', 'popularity_range', id::varchar from item where popularity_score < 0
union all select 'interactions', 'type_known', id::varchar from entry where kind not in ('viewed', 'liked', 'disliked', 'played', 'wishlisted', 'rated')
union all select 'interactions', 'value_only_for_ratings', id::varchar from entry where case when kind = 'rated' then value is null or value not between 0 and 10 else value is not null end
union all select 'interactions', 'superseded_after', id::varchar from entry where superseded_at < occurred_at
union all select 'preferences', 'type_known', key from saved where kind not in ('genre', 'tag', 'platform', 'game')
union all select 'preferences', 'value_length', key from saved where length(value) not between 1 and 220
union all select 'preferences', 'weight_range', key from saved where weight not between 0 and 1
union all select 'users', 'consent_lifecycle', id::varchar from person
where not coalesce(consent_version is null and consented_at is null and expires_at is null and revoked_at is not null, false)
  and not coalesce(length(trim(consent_version)) > 0 and consented_at is not null and expires_at > consented_at, false)"""),
    "unique_checks": _with("log part_items", """
select 'interactions' as "table", 'one_active' as rule, user_id || ':' || item_id || ':' || d as key, count(*) as n
from (select user_id, item_id, case when interaction_type in ('liked', 'disliked') then 'reaction' else interaction_type end as d from log where interaction_type <> 'viewed') group by user_id, item_id, d having count(*) > 1
union all select 'part_items', 'title', title, count(*) from part_items group by title having count(*) > 1"""),
    "fk_checks": _with("interactions items rec_events users", """
select 'interactions' as "table", 'item_id' as rule, ref::varchar as key, count(*) as n from (select item_id + case when id % 20 = 0 then 10000000 else 0 end as ref from interactions)
where ref is not null and ref not in (select id from items) group by ref
union all select 'rec_events', 'user_id', user_id::varchar, count(*) from rec_events where user_id not in (select id from users) group by user_id"""),
    "feedback_checks": _with("state", """
, changed as (
  select user_id || ':' || item_id as key, part, case when part = 0 then rating + 5 when part <> 4 then rating end as rating,
    case when part = 1 and reaction is not null then 'meh' when part <> 4 then reaction end as reaction, case when part not in (2, 4) then reaction_at end as reaction_at,
    case when part not in (3, 4) then rating_at end as rating_at, played and part <> 4 as played, wishlisted and part <> 4 as wishlisted
  from (select *, item_id % 10 as part from state)
)
select 'feedback' as "table", 'reaction_known' as rule, key from changed where reaction not in ('liked', 'disliked')
union all select 'feedback', 'reaction_time', key from changed where (reaction is null) <> (reaction_at is null)
union all select 'feedback', 'rating_range', key from changed where rating not between 0 and 10
union all select 'feedback', 'rating_time', key from changed where (rating is null) <> (rating_at is null)
union all select 'feedback', 'has_a_value', key from changed where reaction is null and rating is null and not coalesce(played, false) and not coalesce(wishlisted, false)"""),
    "retention_preview": _with("rec_events users", f"""
select e as events, x as expired_users, r as revoked_users, e + x + r as eligible from (select count(*) as e from rec_events where generated_at <= timestamp '{CUTOFF}'),
  (select count(*) filter (consented_at is not null and revoked_at is null and expires_at <= timestamp '{NOW}') as x, count(*) filter (revoked_at <= timestamp '{NOW}') as r from users)"""),
    "retention_purge": _with("rec_events users interactions preferences", f"""
, gone as (select id from users where consented_at is not null and revoked_at is null and expires_at <= timestamp '{NOW}')
select id as user_id, count(*) as rows, 'users' as "table" from users where id not in (select id from gone) group by id
union all select user_id, count(*), 'events' from rec_events where generated_at > timestamp '{CUTOFF}' and user_id not in (select id from gone) group by user_id
union all select user_id, count(*), 'interactions' from interactions where user_id not in (select id from gone) group by user_id
union all select user_id, count(*), 'preferences' from preferences where user_id not in (select id from gone) group by user_id"""),
    "revoke_cohort": _with("users", f"""
select id, case when p then timestamp '{NOW}' else revoked_at end as revoked_at, p as processed from (
  select *, coalesce(consented_at is not null and revoked_at is null and created_at <= timestamp '{CUTOFF}' and expires_at > timestamp '{NOW}', false) as p from users)"""),
    "session_status": _with("users", f"""
select id, case when consented_at is null or revoked_at is not null or expires_at <= timestamp '{NOW}' then 'required' when consent_version <> 'v1' then 'consent_outdated' else 'active' end as status from users"""),
    "legacy_backfill": _with("users", f"select id, md5('legacy-revoked-v1:key-' || id) || lpad(lower(to_hex(id)), 32, '0') as anonymous_token_digest, timestamp '{NOW}' as revoked_at from users"),
    "half_step_ratings": _with("interactions", "select id, value * 2 = floor(value * 2) and value between 0 and 10 as half_step, (value + 0.25) * 2 = floor((value + 0.25) * 2) and value + 0.25 between 0 and 10 as quarter_more from interactions where interaction_type = 'rated'"),
}

# a disliked pick doesn't count, and who has nothing left isn't ranked
_EFFECTIVE = """
  select * from (select * replace (list_filter(selected, lambda s: not coalesce(list_contains(d.slugs, s), false)) as selected)
    from context left join (select user_id, list(slug) as slugs from slug_state where reaction = 'disliked' group by user_id) d using (user_id))
  where len(selected) + len(genres) + len(tags) > 0"""
_ADJUSTED = f"""
, profile as (
  select user_id, term, m / sqrt(sum(m * m) over (partition by user_id)) as weight from (
    select user_id, term, sum(weight) / any_value(k) as m from (select user_id, slug, count(*) over (partition by user_id) as k from source) join weight using (slug) group by user_id, term)
), affinity as (
  select user_id, slug, {_UNITS.format("sum(p.weight * w.weight)")} as units from profile p join weight w using (term) group by user_id, slug
), eligible as (
  select s.*, case when k.user_id is not null then coalesce(a.units, 0) else 0 end as affinity_units,
    case when k.user_id is not null then 900000 else 1000000 end::bigint as base_weight, case when k.user_id is not null then 100000 else 0 end::bigint as affinity_weight,
    case when f.played then 500000 else 1000000 end::bigint as played_factor,
    concat_ws(',', case when k.user_id is not null then 'feedback_affinity' end, case when f.played then 'played_adjustment' end) as adjustments
  from scored s left join (select distinct user_id from source) k on k.user_id = s.user_id left join affinity a on a.user_id = s.user_id and a.slug = s.slug
  left join slug_state f on f.user_id = s.user_id and f.slug = s.slug
  where f.reaction is distinct from 'disliked' and not exists (select 1 from source o where o.user_id = s.user_id and o.slug = s.slug)
), parted as (
  select *, (base_units * base_weight + 500000) // 1000000 as base_contribution, (affinity_units * affinity_weight + 500000) // 1000000 as affinity_contribution from eligible
), final as (
  select *, (pre_played_units * played_factor + 500000) // 1000000 as final_units from (select *, base_contribution + affinity_contribution as pre_played_units from parted)
), placed as (
  select f.*, row_number() over (partition by f.user_id order by final_units desc, pre_played_units desc, base_units desc, affinity_units desc, content_units desc, popularity_units desc, f.slug)::int as rank
  from final f
)"""
_KEY = b"a key of the test tables".ljust(64, b"\0")
_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in _KEY) for pad in (0x36, 0x5C))
ORACLE_SQL |= {
    "pseudonymise_users": _with("users", f"select id, sha256('{_OUTER}'::blob || unhex(sha256('{_INNER}'::blob || encode('session:token-' || id)))) as digest from users"),
    "content_documents": _with("document", """
select slug, length(d)::int as characters, (greatest(n, 0) + greatest(n - 1, 0))::int as terms, sha256(d) as sha256 from (
  select slug, array_to_string(w, ' ') as d, len(list_filter(w, lambda x: length(x) >= 2)) as n from document)"""),
    "model_summary": _with("items content_tf content_idf", "select (select count(*) from items) as items, (select count(*) from content_idf) as terms, (select count(*) from content_tf) as weights, 0::bigint as problems"),
    "content_recommend": _with("scored context", """
, placed as (
  select *, row_number() over (partition by user_id order by base_units desc, content_units desc, popularity_units desc, slug)::int as rank from scored)
select c.user_id as context_id, slug, content_units, platform_units, popularity_units, base_units, rank, case when slug is null then 'no_content_support' else 'recommendations' end as reason
from context c left join placed p on p.user_id = c.user_id and rank <= top_k"""),
    "recommend_by_ids": _with("scored context items", """
, placed as (
  select *, row_number() over (partition by user_id order by base_units desc, content_units desc, popularity_units desc, slug)::int as rank from scored)
select c.user_id as context_id, p.rank, i.id, i.title, i.developer, i.average_rating::double as average_rating, i.rating_count, p.base_units,
  case when c.user_id % 5 = 0 then 'unknown_items' when p.slug is null then 'no_content_support' else 'recommendations' end as reason
from context c left join placed p on p.user_id = c.user_id and rank <= top_k and c.user_id % 5 <> 0 left join items i on i.slug = p.slug"""),
    "session_renew": _with("users", f"""
select id, case when go then 'v1' else consent_version end as consent_version, case when go then timestamp '{NOW}' else consented_at end as consented_at,
  case when go then timestamp '{NOW}' + to_days(90) else expires_at end as expires_at
from (select *, coalesce(id % 3 = 0 and consented_at is not null and revoked_at is null and expires_at > timestamp '{NOW}' and consent_version <> 'v1', false) as go from users)"""),
    "delete_users": _with("rec_events users interactions preferences", """
select id as user_id, count(*) as rows, 'users' as "table" from users where id % 4 <> 1 group by id
union all select user_id, count(*), 'events' from rec_events where user_id % 4 <> 1 group by user_id
union all select user_id, count(*), 'interactions' from interactions where user_id % 4 <> 1 group by user_id
union all select user_id, count(*), 'preferences' from preferences where user_id % 4 <> 1 group by user_id"""),
    "legacy_events": "select event_id as id, user_id, 'legacy-' || event_id as generation_id, 'legacy-v1' as event_schema_version from events where event_type = 'view'",
    "feedback_recommend": _with("slug_state scored source context weight", _ADJUSTED + """
select c.user_id, slug, content_units, platform_units, popularity_units, base_units, affinity_units, base_weight, affinity_weight, played_factor, base_contribution, affinity_contribution,
  pre_played_units, final_units, final_units - pre_played_units as played_delta_units, adjustments, rank,
  case when slug is not null then 'recommendations' when a.user_id is null then 'insufficient_context' when s.user_id is not null then 'no_eligible_candidates' else 'no_content_support' end as reason
from context c left join placed p on p.user_id = c.user_id and rank <= c.top_k left join asked a on a.user_id = c.user_id left join (select distinct user_id from scored) s on s.user_id = c.user_id""",
        {"asked": _EFFECTIVE}),
}

ORACLE_SQL["catalog_search_indexed"] = ORACLE_SQL["catalog_search_literal"]
ORACLE_SQL["catalog_scan_bucketed"] = ORACLE_SQL["catalog_scan"]
ORACLE_SQL["retention_in_place"] = ORACLE_SQL["retention_purge"]
ORACLE_SQL["upsert_in_place"] = f"""select * exclude (outcome) from ({ORACLE_SQL["upsert_classify"]})"""
ORACLE_SQL["state_in_place"] = f"""select user_id, sum(rows)::bigint as rows, sum(active)::bigint as active from ({ORACLE_SQL["replace_state"]}) group by user_id"""
_FOUND = f"""(select * from ({ORACLE_SQL["quality_checks"]}) where "table" = 'items')"""
ORACLE_SQL["quality_split"] = f"""
select rule, count(*) as n from {_FOUND} group by rule
union all select 'clean', (select count(*) from documents) - count(distinct key) from {_FOUND}
union all select 'rejected', count(distinct key) from {_FOUND}"""

# decimals and dates are compared as doubles and text
_PLAIN = {
    "average_rating::double": [f"catalog_page_{s}" for s in _ORDERS],
    "popularity_score::double": [*(f"catalog_page_{s}" for s in _ORDERS), "catalog_filter_taxonomy", "upsert_classify", "upsert_in_place"],
    "release_date::varchar": [f"catalog_page_{s}" for s in _ORDERS],
    "rating::double": ["active_feedback", "feedback_pages", "feedback_pages_all"],
    "weight::double": ["preferences_replace"],
}
for _cast, _names in _PLAIN.items():
    for _name in _names:
        ORACLE_SQL[_name] = f"select * replace ({_cast} as {_cast.partition(':')[0]}) from ({ORACLE_SQL[_name]})"
