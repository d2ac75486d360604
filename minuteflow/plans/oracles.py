"""The registered queries in SQL for DuckDB."""

from __future__ import annotations

from minuteflow.sources.tables import CLICKS_SQL, ITEMS_SQL, MEETINGS_SQL, SEARCHES_SQL

BLANK = "('', '-', '--', 'na', 'n/a', 'none', 'null')"


def term(column: str, words: str) -> str:
    return f"coalesce(regexp_matches(lower({column}), '(^|[^a-z0-9]){words}([^a-z0-9]|$)'), false)"


def placeholder(column: str) -> str:
    return f"regexp_replace(replace(replace(replace(lower(coalesce({column}, '')), '—', '-'), '–', '-'), '－', '-'), '\\s+', '', 'g')"


def meaningful(column: str) -> str:
    return f"({placeholder(column)} not in {BLANK})"


def owned(column: str = "owner") -> str:
    return f"(lower(trim(coalesce({column}, ''))) not in {BLANK})"


WITH = f"with {MEETINGS_SQL}, {ITEMS_SQL}"
MI = f"{WITH} "


def recency(date: str) -> str:
    age = f"greatest(datediff('day', {date}::date, date '2001-08-01'), 0)"
    return f"case when {age} <= 30 then 5.0::double when {age} <= 90 then 3.0::double when {age} <= 180 then 1.0::double else 0.0::double end"


def fields(weights: dict[str, float], words: str) -> str:
    return " + ".join(f"case when {term(f, words)} then {w}::double else 0 end" for f, w in weights.items())


ITEM_W = {"content": 8.0, "owner": 5.0, "planned_date": 3.0, "actual_completed_date": 3.0, "tracking_result": 4.0}
TASK = f"(case when {owned()} then 2.0::double else 0 end + case when {meaningful('planned_date')} then 2.0::double else 0 end + case when {meaningful('actual_completed_date')} then 0 else 2.0::double end + case when {meaningful('tracking_result')} then 0 else 1.0::double end)"

SIMILAR = "(q = 'red ring' or q like '%red ring%' or 'red ring' like '%' || q || '%' or len(list_intersect(list_distinct(string_split(q, ' ')), ['red', 'ring'])) / greatest(len(list_distinct(string_split(q, ' '))), 2) >= 0.5)"

RANKED = f"""{WITH}, {CLICKS_SQL},
cl as (select *, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) as q from clicks),
mf as (select meeting_id, 0.5 * count(*) + 0.5 * sum(({SIMILAR})::int) as f from cl group by 1),
itf as (select item_id, count(*) + 0.5 * sum(({SIMILAR})::int) as f from cl group by 1),
si as (select i.*, {fields(ITEM_W, 'red ring')} as kw, case when {term('content', 'red ring')} then 4.0::double else 0 end + case when {term('owner', 'red ring')} then 3.0::double else 0 end as st, coalesce(f, 0)::double as fb from items i left join itf using (item_id)),
pm as (select meeting_id, sum(kw) as kw, sum(st) as st, sum(fb) as fb, string_agg(item_id, ',' order by kw + st + fb desc, item_no, item_id) as matched_items from si where kw > 0 group by 1),
r as (select m.meeting_id, meeting_name, meeting_date, coalesce(pm.kw, 0)::double as keyword_score, coalesce(pm.st, 0)::double as structure_score, 0.0::double as task_score, (coalesce(mf.f, 0) + coalesce(pm.fb, 0))::double as feedback_score,
  {recency('meeting_date')} as recency_score, coalesce(case when pm.meeting_id is not null then 'content' end, '') as matched_fields, coalesce(matched_items, '') as matched_items
  from meetings m left join pm using (meeting_id) left join mf using (meeting_id)),
ranked as (select meeting_id, meeting_name, meeting_date, keyword_score, structure_score, task_score, feedback_score, recency_score, keyword_score + structure_score + task_score + feedback_score + recency_score as final_score, matched_fields, matched_items from r where keyword_score > 0 or structure_score > 0 or feedback_score > 0)
select * from ranked"""

TOKENS = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9][A-Za-z0-9._/-]*'), lambda x: lower(x)), lambda x: x not in ('meeting', 'minutes', 'record')))"
RELATED_MEETINGS = f"""{WITH},
att as (select distinct meeting_id, unnest(attendees) as t from meetings),
own as (select distinct meeting_id, trim(owner) as t from items where trim(coalesce(owner, '')) <> ''),
kw as (select distinct meeting_id, unnest({TOKENS.format('meeting_name')}) as t from meetings union select distinct meeting_id, unnest({TOKENS.format('content')}) from items),
a as (select meeting_id, count(distinct t) as n from att where meeting_id <> '7' and t in (select t from att where meeting_id = '7') group by 1),
o as (select meeting_id, count(distinct t) as n from own where meeting_id <> '7' and t in (select t from own where meeting_id = '7') group by 1),
k as (select meeting_id, count(distinct t) as n from kw where meeting_id <> '7' and t in (select t from kw where meeting_id = '7') group by 1),
s as (select m.meeting_id, meeting_name, meeting_date, responsible_unit = (select responsible_unit from meetings where meeting_id = '7') as same, coalesce(a.n, 0) as shared_attendees, coalesce(o.n, 0) as shared_owners, coalesce(k.n, 0) as shared_keywords
  from meetings m left join a using (meeting_id) left join o using (meeting_id) left join k using (meeting_id) where meeting_id <> '7')
select meeting_id, meeting_name, meeting_date, (case when same then 4 else 0 end + least(2 * shared_attendees, 6) + least(3 * shared_owners, 6) + least(2 * shared_keywords, 6))::bigint as score, shared_attendees, shared_owners, shared_keywords,
  array_to_string(list_filter([case when same then 'same_unit' end, case when shared_attendees > 0 then 'shared_attendees' end, case when shared_owners > 0 then 'shared_owners' end, case when shared_keywords > 0 then 'shared_keywords' end], lambda x: x is not null), ',') as reasons
from s where case when same then 4 else 0 end + shared_attendees + shared_owners + shared_keywords > 0 order by score desc, meeting_date, meeting_id limit 50"""

STATUS = f"""case when {meaningful('actual_completed_date')} then 'completed' when {placeholder('tracking_result')} in ('-', '--') or lower(tracking_result) like '%na%' or lower(tracking_result) like '%n/a%' then 'not_applicable'
  when regexp_matches(lower(coalesce(tracking_result, '')), 'closed|completed|done|resolved') then 'completed' when regexp_matches(lower(coalesce(tracking_result, '')), 'pending|in +progress|ongoing|follow up') then 'in_progress' else 'pending' end"""
SOURCE = f"case when {meaningful('actual_completed_date')} then 'actual_completed_date' when st in ('not_applicable', 'completed', 'in_progress') then 'tracking_result' else '' end"
STATUSES = f"""st0 as (select *, {STATUS} as st from items),
statuses as (select * replace (case when {meaningful('planned_date')} then planned_date end as planned_date, case when {meaningful('actual_completed_date')} then actual_completed_date end as actual_completed_date),
  st as status, {SOURCE} as status_source, case when {SOURCE} = 'actual_completed_date' then 'high' when st = 'in_progress' then 'medium' when st = 'pending' then 'low' else 'high' end as status_confidence from st0)"""

ISSUES = """iss as (select i.*, meeting_date, product || ' / ' || regulation as title, array_to_string(list_sort([lower(product), regexp_replace(lower(regulation), '[^a-z0-9_ ]', '', 'g')]), '|') as signature from items i left join meetings using (meeting_id)),
issues as (select *, 'issue_' || substring(sha1(signature), 1, 12) as issue_id from iss),
chain as (select *, lag(item_id) over w as previous_item_id, lead(item_id) over w as next_item_id, row_number() over w as sequence_no from issues window w as (partition by issue_id order by coalesce(meeting_date, ''), coalesce(meeting_id, ''), item_no, item_id))"""
CO = """co0 as (select product as l, regulation as r, count(*) as n from items group by all), co1 as (select l as "left", r as "right", n as count from co0 union all select r, l, n from co0),
co as (select *, round(count / max(count) over (partition by "left"), 4) as weight from co1)"""
RELATION = "{0} select meeting_id, item_id, {1} as matched_entity from items join meetings using (meeting_id) where {2}"
PSEUDO = "'{0}_' || upper(substring(sha256('salt' || chr(0) || '{1}' || chr(0) || {2}), 1, 10))"
FUSED = f"""{WITH}, g as (select item_id from items where {owned()} and owner like '%000000007%'), s as (select item_id from items where product = 'red ring' and owner like '%7'), v as (select item_id from items where regulation = 'Brand#21' and item_no = '01'),
ctx as (select item_id from s union select item_id from v), kept as (select * from g where item_id in (select item_id from ctx)),
f as (select item_id, 'RESPONSIBLE_BY' as matched_relation, 'graph' as evidence_source, 4.0::double as graph_score from kept union all select item_id, null, 'structured', 5.0 from s where item_id not in (select item_id from kept)
  union all select item_id, null, 'semantic', 0.75 from v where item_id not in (select item_id from kept union select item_id from s))"""

PROMO = f"{WITH}, {ISSUES}"
NAMED = f"""{WITH}, named as (select * from items join meetings using (meeting_id) where contains('WHICH ITEMS HAS THE 1-URGENT MACHINERY REVIEW MEETING?', upper(meeting_name)))"""
COMPOSED = f"""{WITH}, {ISSUES}, composed as (select * from issues where {owned()} and owner like '%#00000000%' and lower(regulation) like '%brand#2%' and (contains(lower(content), 'gear') or contains(lower(title), 'gear'))
  and meeting_id in (select meeting_id from meetings) order by meeting_date desc nulls first, item_no, item_id limit 100)"""

FIRST_NAMED = f"""{WITH}, named as (select meeting_id, (case when contains('WHICHITEMSHASTHE1-URGENTMACHINERYREVIEWMEETING?', upper(meeting_id)) then 100 else 0 end) + (case when contains('WHICHITEMSHASTHE1-URGENTMACHINERYREVIEWMEETING?', upper(replace(meeting_name, ' ', ''))) then 100 else 0 end)
    + coalesce((select sum(10 + length(t)) from (select unnest(['HAS', 'THE', '1-URGENT', 'MACHINERY', 'REVIEW']) as t) where contains(upper(meeting_id), t) or contains(upper(replace(meeting_name, ' ', '')), t) or contains(upper(document_id), t)), 0) as score from meetings),
near as (select meeting_id from named where score > 0 and score >= greatest(0.75 * (select max(score) from named), (select max(score) from named) - 10)),
firsts as (select items.*, m.meeting_name from items join meetings m using (meeting_id) where meeting_id in (select meeting_id from near) order by meeting_id, item_no::int, item_no, item_id limit {{}})"""

EDGE_COUNTS = f"""{WITH}, {STATUSES}, {ISSUES}, {CO}
select relation, n::bigint as edges from (
  select 'HAS_MEETING' as relation, count(*) as n from meetings union all select 'HAS_ITEM', count(*) from items union all select 'BELONGS_TO_UNIT', count(*) from meetings
  union all select 'CHAIRED_BY', count(*) from meetings union all select 'RECORDED_BY', count(*) from meetings union all select 'ATTENDED_BY', count(*) * 3 from meetings
  union all select 'HAS_PLANNED_DATE', count(*) from statuses where planned_date is not null union all select 'HAS_COMPLETED_DATE', count(*) from statuses where actual_completed_date is not null
  union all select 'RESPONSIBLE_BY', count(*) from items where {owned()} union all select 'MENTIONS', (select count(*) * 2 from items) + (select count(*) from meetings)
  union all select 'MENTIONS_PRODUCT', count(*) from items union all select 'MENTIONS_REGULATION', count(*) from items union all select 'HAS_ACTION', count(*) from items
  union all select 'ASSIGNED_TO', count(*) from items where {owned()} union all select 'TARGETS_PRODUCT', count(*) from items union all select 'CONSTRAINED_BY', count(*) from items
  union all select 'TRACKS_ISSUE', count(*) from items union all select 'FOLLOW_UP_OF', count(previous_item_id) from chain union all select 'CO_OCCURS_WITH', count(*) from co) where n > 0"""

SPOKEN = f"""{WITH}, {STATUSES}, {ISSUES},
spoken as (select * replace (content || case item_no when '03' then ' approved' when '04' then ' critical risk' when '05' then ' agreed on a minor delay' else '' end as content) from statuses),
texts as (select *, trim(regexp_replace(content || coalesce(' ' || tracking_result, ''), '\\s+', ' ', 'g')) as text from spoken),
titled as (select *, case when length(text) <= 96 then text else left(text, 95) || '...' end as title from texts)"""
DECIDED, RISKY = "item_no in ('03', '05')", "item_no in ('04', '05')"


def pseudo(kind: str, value: str) -> str:
    return PSEUDO.format(kind, kind.lower(), value)


ORACLES = {
    "ranked_search": RANKED,
    "ranked_search_page": RANKED + " order by meeting_date desc, final_score desc, meeting_id desc limit 10 offset 10",
    "answered_search": RANKED.removesuffix("select * from ranked").rstrip() + f""", {STATUSES},
p as (select * from ranked order by meeting_date desc, final_score desc, meeting_id desc limit 10 offset 10),
listed as (select si.meeting_id, string_agg(si.item_id || '/' || s.status, '|' order by si.kw + si.st + si.fb desc, si.item_no, si.item_id) as items from si join statuses s using (item_id) where kw > 0 group by 1),
marks as (select meeting_id, regexp_replace(content, '(red ring)', '<mark>\\1</mark>', 'i') as mark, min(row(item_no, item_id)) as place from si where {term('content', 'red ring')} group by all),
marked as (select meeting_id, string_agg('content=' || mark, '|' order by place) as snippets from (select * from marks qualify row_number() over (partition by meeting_id order by place) <= 8) group by 1)
select p.meeting_id, document_id, final_score, coalesce(snippets, '') as snippets, coalesce(items, '') as items, (select count(*) from ranked) as result_count
from p join meetings m using (meeting_id) left join listed using (meeting_id) left join marked using (meeting_id)""",
    "ranked_search_keyword_order": RANKED + " order by keyword_score desc, final_score desc, meeting_date, meeting_id limit 20",
    "ranked_search_filtered": f"""{WITH}, f as (select *, {fields(ITEM_W, 'blue bolt')} as kw, {TASK} as task from items where {owned()} and not {meaningful('actual_completed_date')}),
pm as (select meeting_id, sum(kw) as kw, sum(case when {term('content', 'blue bolt')} then 4.0 else 0 end)::double as st, sum(task) as task, count(*) as n from f group by 1)
select meeting_id, kw::double as keyword_score, task::double as task_score, (kw + st + task + {recency('meeting_date')})::double as final_score, n::bigint as n_items from meetings join pm using (meeting_id)
where meeting_date between '1999-01-01' and '2000-06-30' and responsible_unit = 'NATION_3'""",
    "task_scores": f"{WITH} select meeting_id, sum({TASK})::double as task_score from items group by 1",
    "recency_scores": f"{WITH} select meeting_id, {recency('meeting_date')} as recency_score from meetings",
    "item_status": f"{WITH}, {STATUSES} select item_id, status, status_source, status_confidence, planned_date, actual_completed_date from statuses",
    "meeting_feedback": f"with {CLICKS_SQL}, c as (select *, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) as q from clicks) select meeting_id, count(*) as all_clicks, sum((q in ('red ring', 'red ring check'))::int)::bigint as similar_clicks from c group by 1",
    "search_stats": f"""{WITH}, {CLICKS_SQL}, {SEARCHES_SQL}, v as (select 'query' as kind, query as value from searches where trim(query) <> '' union all select 'meeting', meeting_id from clicks union all select 'item', item_id from clicks union all select 'owner', owner from items where {owned()}),
c as (select kind, value, count(*) as count from v group by all) select kind, value, count from c qualify row_number() over (partition by kind order by count desc, value) <= 10""",
    "parsed_forms": f"""{WITH}, {STATUSES}, k as (select *, row_number() over (partition by meeting_id order by item_no, item_id) - 1 as k from items)
select k.meeting_id as document_id, (2 + k.k // 3)::int as page_number, lpad((k.k + 1 + k.meeting_id::bigint % 5)::varchar, 2, '0') as item_no, trim(regexp_replace(k.content, '\\s+', ' ', 'g')) as content,
  nullif(k.owner, '--') as owner, nullif(k.planned_date, '- -') as planned_date, nullif(k.actual_completed_date, '--') as actual_completed_date, case k.tracking_result when 'in  progress' then 'in progress' when '—' then null else k.tracking_result end as tracking_result, case when k.tracking_result = '—' and status = 'not_applicable' then 'pending' else status end as status
from k join statuses using (item_id)""",
    "parsed_form_heads": f"""{WITH}, h as (select meeting_id, meeting_name, meeting_date, responsible_unit, attendees, '會議記錄單時間:' || strftime(meeting_date::date, '%Y年%m月%d日') || '會議名稱:' || meeting_name || '權責單位:' || responsible_unit || '出席人員:' || array_to_string(attendees, '、') || '項次' as raw
  from meetings m where exists (select 1 from items i where i.meeting_id = m.meeting_id))
select meeting_id as document_id, meeting_name, meeting_date, responsible_unit, array_to_string(attendees, '|') as attendees, case when length(regexp_replace(raw, '\\s+', '', 'g')) < 80 then 'needs_ocr' else 'parsed' end as status from h""",
    "recent_searches": f"with {SEARCHES_SQL} select search_id, query from searches order by created_at desc, search_id limit 10",
    "related_meetings": RELATED_MEETINGS,
    "list_meetings": f"{WITH} select meeting_id, meeting_name, meeting_date from meetings where meeting_date >= '2000-01-01' and len(list_filter(attendees, lambda a: regexp_matches(lower(a), 'guest#3'))) > 0",
    "list_items": f"{WITH} select item_id, owner, tracking_result from items where lower(tracking_result) like '%closed%' and owner like '%00000001%'",
    "meeting_detail": f"{WITH} select m.meeting_id, meeting_name, item_id, item_no, content from meetings m left join items using (meeting_id) where m.meeting_id = '7'",
    "list_documents": f"{WITH} select meeting_id as document_id, meeting_name || '.pdf' as original_filename, status from meetings where meeting_id::int % 9 <> 0 and meeting_name like '%machinery%' and status = 'parsed'",
    "soft_delete": f"{WITH} select case when meeting_id = '7' then 'deleted' else status end as status, meeting_id = '7' or meeting_id::int % 9 = 0 as is_deleted, count(*) as n from meetings group by all",
    "cooccurrence": f'{WITH}, {CO} select "left", "right", count, weight from co',
    "graph_edges": EDGE_COUNTS,
    "reread_graph": f"""{WITH}, n as (select *, meeting_id::bigint as k from meetings), i as (select items.*, k from items join n using (meeting_id) where not (k % 7 = 0 or k % 11 = 0) or (k % 11 <> 0 and item_no = '01')),
e as (select 'HAS_ITEM' as relation, meeting_id from i union all select 'BELONGS_TO_UNIT', meeting_id from n where k % 11 <> 0 union all select 'HAS_PLANNED_DATE', meeting_id from i where {meaningful('planned_date')}
  union all select 'RESPONSIBLE_BY', meeting_id from i where {owned()} union all select 'MENTIONS_PRODUCT', meeting_id from i where product like '% %'
  union all select 'CO_OCCURS_WITH', null from (select distinct product, regulation from items) cross join (values (1), (2)))
select relation, count(*) as edges, count(distinct meeting_id) as meetings from e group by 1""",
    "issues": f"{WITH}, {ISSUES} select item_id, issue_id, title, signature from issues",
    "follow_up_chain": f"{WITH}, {ISSUES} select item_id, previous_item_id from chain where previous_item_id is not null",
    "related_keywords": f"""{WITH}, {CO}, b as (select "right" as keyword, weight, count from co where upper("left") = 'RED RING' union all select "left", weight, count from co where upper("right") = 'RED RING')
select keyword, max(weight) as weight, max(count) as count from b group by 1 order by 2 desc, 3 desc, 1 limit 10""",
    "keyword_hits": f"{WITH} select meeting_id, item_id, product as matched_keyword from items join meetings using (meeting_id) where product = 'red ring' union select meeting_id, item_id, 'machinery' from items join meetings using (meeting_id) where meeting_name like '%machinery review'",
    "responsible_items": RELATION.format(WITH, "owner", f"{owned()} and owner like '%000000007%'"),
    "date_items": RELATION.format(WITH, "actual_completed_date", "actual_completed_date like '%2000-04%'"),
    "product_items": RELATION.format(WITH, "product", "product = 'red ring'"),
    "regulation_items": RELATION.format(WITH, "regulation", "lower(regulation) like '%brand#21%'"),
    "meeting_people": f"{WITH} select meeting_id, item_id, t as matched_entity from (select meeting_id, unnest(attendees) as t from meetings) join items using (meeting_id) where lower(t) like '%guest#3%'",
    "meeting_people_all": f"""{WITH}, p as (select meeting_id, chairperson as person, 'CHAIRED_BY' as relation, 'chaired' as field from meetings union select meeting_id, recorder, 'RECORDED_BY', 'recorded' from meetings
  union select meeting_id, unnest(attendees || [chairperson, recorder]), 'ATTENDED_BY', 'attended' from meetings)
select distinct meeting_id, item_id, person as matched_entity, relation as matched_relation, field as matched_field from p join items using (meeting_id) where upper(person) like '%#000000007%'""",
    "planned_items": f"{WITH} select meeting_id, item_id, planned_date as matched_entity, 'planned_date' as matched_field from items join meetings using (meeting_id) where planned_date like '%2000-04-1%'",
    "unit_meetings": f"{WITH} select meeting_id, item_id, responsible_unit as matched_entity, 'responsible_unit' as matched_field from meetings join items using (meeting_id) where contains(lower(responsible_unit), 'nation_3')",
    "meeting_items_by_question": f"""{WITH}, s as (select meeting_id, (upper(meeting_name) like '%URGENT%')::int + (upper(meeting_name) like '%MACHINERY%')::int as match_score from meetings)
select meeting_id, item_id, match_score::bigint as match_score from s join items using (meeting_id) where match_score = (select max(match_score) from s)""",
    "meeting_items_by_name": f"{NAMED} select meeting_id, item_id, 100::bigint as match_score, meeting_name as matched_entity from named",
    "meeting_items_by_id": f"""{WITH}, s as (select *, case when contains('LIST ITEMS OF MEETING #1027', meeting_id) then 95 else 0 end as match_score from meetings)
select meeting_id, item_id, match_score::bigint as match_score, meeting_name as matched_entity from s join items using (meeting_id) where match_score = 95 order by meeting_date desc nulls first, item_no, item_id limit 40""",
    "composite_search": f"""{WITH}, {STATUSES} select meeting_id, item_id, 'action_' || item_id as matched_node_id, status, 3.8::double as graph_score from statuses join meetings m using (meeting_id)
where product = 'red ring' and lower(responsible_unit) like '%nation!_1%' escape '!' and actual_completed_date is null and statuses.status not in ('completed', 'not_applicable')""".replace("select meeting_id, item_id, 'action_' || item_id as matched_node_id, status,", "select meeting_id, item_id, 'action_' || item_id as matched_node_id, statuses.status as status,"),
    "composite_issues": f"{COMPOSED} select item_id, title as matched_entity, issue_id as matched_node_id, 'TRACKS_ISSUE' as matched_relation, 'issues' as matched_field, 4.5::double as graph_score from composed",
    "composite_evidence": f"""{COMPOSED}, e as (select item_id, 'MeetingItem' as source_type, item_id as source_value, 'TRACKS_ISSUE' as relation, 'Issue' as target_type, issue_id as target_value, title as target_label from composed
  union all select item_id, 'MeetingItem', item_id, 'RESPONSIBLE_BY', 'Person', owner, owner from composed where {owned()} and owner like '%#00000000%'
  union all select item_id, 'MeetingItem', item_id, 'MENTIONS_REGULATION', 'Regulation', regulation, regulation from composed
  union all select item_id, 'MeetingItem', item_id, 'MENTIONS', 'Keyword', product, product from composed where contains(product, 'gear')
  union all select item_id, 'MeetingItem', item_id, 'MENTIONS', 'Keyword', regulation, regulation from composed where contains(lower(regulation), 'gear'))
select distinct * from e""",
    "follow_up_items": f"""{PROMO} select c.item_id, c.previous_item_id, c.meeting_id, p.meeting_id as previous_meeting_id, 4.4::double as graph_score
from chain c join items p on c.previous_item_id = p.item_id join meetings m on m.meeting_id = c.meeting_id where contains(upper(c.content), 'PROMO') or contains(upper(p.content), 'PROMO') or contains(upper(c.title), 'PROMO')""",
    "issue_timeline": f"""{PROMO} select issue_id, item_id, previous_item_id, split_part(previous_item_id, '-', 1) as previous_meeting_id, next_item_id, split_part(next_item_id, '-', 1) as next_meeting_id, title as matched_entity,
  row_number() over (partition by issue_id order by coalesce(meeting_date, ''), coalesce(meeting_id, ''), item_no, item_id) as sequence_no from chain where contains(upper(content), 'PROMO') or contains(upper(title), 'PROMO') or contains(upper(signature), 'PROMO')""",
    "timeline_evidence": f"""{PROMO}, t as (select * from chain where contains(upper(title), 'RED RING'))
select item_id, 'MeetingItem' as source_type, item_id as source_value, 'TRACKS_ISSUE' as relation, 'Issue' as target_type, issue_id as target_value from t
union all select item_id, 'MeetingItem', item_id, 'FOLLOW_UP_OF', 'MeetingItem', previous_item_id from t where previous_item_id is not null
union all select item_id, 'MeetingItem', next_item_id, 'FOLLOW_UP_OF', 'MeetingItem', item_id from t where next_item_id is not null""",
    "graph_search": f"""{WITH}, {STATUSES}, i as (select s.*, m.meeting_date, 'Check the ' as x from statuses s join meetings m using (meeting_id)),
c as (select * from i where product = 'red ring' and status = 'pending' order by meeting_date desc nulls first, item_no, item_id limit 100),
r as (select * from i where {owned()} and contains(owner, '000000007') order by meeting_date desc nulls first, item_no, item_id, owner limit 100),
a as (select meeting_id, item_id, meeting_date, 3.8::double as graph_score, null as matched_keyword, substring(trim(regexp_replace(concat_ws(' ', content, tracking_result), '\\s+', ' ', 'g')), 1, 96) as matched_entity, 'HAS_ACTION' as matched_relation, 'composite' as retrieval_mode from c
  union all select meeting_id, item_id, meeting_date, 4.0, null, owner, 'RESPONSIBLE_BY', 'relation' from r
  union all select meeting_id, item_id, meeting_date, 3.0, product, product, 'MENTIONS', 'keyword' from i where product = 'red ring')
select meeting_id, item_id, graph_score, matched_keyword, matched_entity, matched_relation, retrieval_mode from a order by graph_score desc, coalesce(meeting_date, ''), item_id limit 100""",
    "graph_search_keywords": f"""{WITH}, {CO}, rel as (select keyword, max(weight) as weight, max(count) as n from (select "right" as keyword, weight, count from co where upper("left") = 'RED RING' union all select "left", weight, count from co where upper("right") = 'RED RING') group by 1 order by 2 desc, 3 desc, 1 limit 8),
k as (select item_id, meeting_id, unnest([product, regulation]) as kw from items union select item_id, meeting_id, regexp_extract(meeting_name, '(\\w+) review$', 1) from items join meetings using (meeting_id)),
s as (select k.item_id, m.meeting_date, case when kw = 'red ring' then 3.0::double else greatest(round(2.5 * weight, 2), 0.5)::double end as graph_score, kw as matched_keyword from k join meetings m using (meeting_id) left join rel on upper(kw) = upper(rel.keyword) where kw = 'red ring' or rel.keyword is not null)
select item_id, graph_score, matched_keyword from s order by graph_score desc, coalesce(meeting_date, ''), item_id limit 3000""",
    "graph_search_structural": f"{NAMED} select item_id, 5.2::double as graph_score, meeting_name as matched_entity, 'structural' as retrieval_mode from named order by meeting_date desc nulls first, item_no, item_id limit 30",
    "graph_search_dates": f"{WITH} select item_id, 4.0::double as graph_score, planned_date as matched_entity, 'relation' as retrieval_mode from items join meetings using (meeting_id) where planned_date = '2000-04-11' order by meeting_date desc nulls first, item_no, item_id limit 30",
    "graph_search_follow_up": f"""{PROMO}, t as (select * from chain where contains(upper(title), 'RED RING') order by issue_id, coalesce(meeting_date, ''), coalesce(meeting_id, ''), item_no, item_id limit 80)
select item_id, 4.7::double as graph_score, title as matched_entity, 'TRACKS_ISSUE' as matched_relation, 'follow_up' as retrieval_mode from t""",
    "graph_nodes": f"""{WITH}, {STATUSES}, {ISSUES}, n as (select 'Document' as type, document_id as id from meetings union select 'Meeting', meeting_id from meetings union select 'Meeting', meeting_id from items union select 'MeetingItem', item_id from items
  union select 'Unit', responsible_unit from meetings union select 'Person', unnest(attendees || [chairperson, recorder]) from meetings union select 'Person', owner from items where {owned()}
  union select 'Date', planned_date from statuses union select 'Date', actual_completed_date from statuses union select 'Keyword', unnest([product, regulation]) from items union select 'Keyword', regexp_extract(meeting_name, '(\\w+) review$', 1) from meetings
  union select 'Product', product from items union select 'Regulation', regulation from items union select 'ActionItem', 'action_' || item_id from items union select 'Issue', issue_id from issues)
select type, count(*) as n from n where trim(coalesce(id, '')) <> '' group by 1""",
    "related_items": f"""{WITH}, t as (select * from items where item_id = (select min(item_id) from items)), tw as (select {TOKENS.format('meeting_name')} as w from meetings where meeting_id = (select meeting_id from t)),
w as (select distinct item_id, unnest({TOKENS.format('content')}) as k from items), sh as (select item_id, count(*) as n from w where k in (select k from w where item_id = (select item_id from t)) group by 1),
s as (select i.item_id, i.meeting_id, i.item_no, i.content, least(3 * coalesce(n, 0), 6) + case when trim(coalesce(i.owner, '')) <> '' and trim(i.owner) = trim(t.owner) then 4 else 0 end
  + case when substring(coalesce(i.planned_date, ''), 1, 7) <> '' and substring(coalesce(i.planned_date, ''), 1, 7) = substring(coalesce(t.planned_date, ''), 1, 7) then 2 else 0 end
  + case when list_has_any({TOKENS.format('meeting_name')}, (select w from tw)) then 2 else 0 end + case when (trim(coalesce(i.tracking_result, '')) = '') = (trim(coalesce(t.tracking_result, '')) = '') then 1 else 0 end as score
  from items i cross join t left join meetings m on m.meeting_id = i.meeting_id left join sh on sh.item_id = i.item_id where i.item_id <> t.item_id)
select item_id, meeting_id, item_no, content, score::bigint as score from s where score > 0 order by score desc, meeting_id, item_no, item_id limit 50""",
    "highlight_snippets": f"""{WITH}, s as (select item_id, content || ' before the next release of the catalogue; see the notes of the last review' as t from items),
f as (select *, case when regexp_matches(lower(t), '(^|[^a-z0-9])red ring([^a-z0-9]|$)') then 'red ring' when regexp_matches(lower(t), '(^|[^a-z0-9])bolt([^a-z0-9]|$)') then 'bolt' end as q from s),
p as (select *, length(regexp_extract(lower(t), '^(.*?(^|[^a-z0-9]))' || q || '([^a-z0-9]|$)', 1)) as n0 from f where q is not null)
select item_id, case when n0 > 20 then '...' else '' end || substring(t, greatest(n0 - 20, 0) + 1, least(n0, 20)) || '<mark>' || substring(t, n0 + 1, length(q)) || '</mark>' || substring(t, n0 + length(q) + 1, 30) || case when n0 + length(q) + 30 < length(t) then '...' else '' end as snippet from p""",
    "keywords": f"""{WITH}, c as (select product as p from items), k as (select 'Check the ' || p || ' for' as name, 'english_phrase' as type, 'regex_phrase' as method from c
  union all select 'the ' || p, 'product', 'regex_product_phrase' from c where split_part(p, ' ', 2) in ('ring', 'bolt', 'gear', 'gizmo', 'plate', 'rod', 'widget', 'anvil')
  union all select p, 'product', 'regex_product_phrase' from c where split_part(p, ' ', 2) in ('ring', 'bolt', 'gear', 'gizmo', 'plate', 'rod', 'widget', 'anvil')) select name, type, method, count(*) as n from k group by all""",
    "point_ids": f"""{WITH}, h as (select meeting_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || meeting_id::blob) as d from meetings)
select meeting_id, substring(d, 1, 8) || '-' || substring(d, 9, 4) || '-5' || substring(d, 14, 3) || '-' || substring('89ab', (strpos('0123456789abcdef', substring(d, 17, 1)) - 1) % 4 + 1, 1) || substring(d, 18, 3) || '-' || substring(d, 21, 12) as id from h""",
    "product_meeting_counts": f"{WITH} select product, count(distinct meeting_id) as meeting_count from items group by 1 order by 2 desc, 1 limit 20",
    "person_item_counts": f"{WITH} select owner as person, count(distinct item_id) as item_count from items where {owned()} group by 1 order by 2 desc, 1 limit 20",
    "meetings_with_both": f"{WITH} select meeting_id from items where regulation in ('Brand#2', 'Brand#3') group by 1 having count(distinct regulation) = 2",
    "product_regulation_counts": f"{WITH} select product, regulation, count(distinct item_id) as item_count from items group by all",
    "issues_without_follow_up": f"{WITH}, {ISSUES} select issue_id, count(*) as item_count from chain group by 1 having count(previous_item_id) = 0 and count(next_item_id) = 0",
    "product_people": f"{WITH} select owner as person, count(distinct item_id) as item_count from items where product = 'red ring' and {owned()} group by 1",
    "node_expansion": f"{WITH} select 'MENTIONS_PRODUCT' as relation, 'MeetingItem' as type, item_id as id, 'in' as direction from items where product = 'red ring' order by item_id limit 50",
    "vector_search": "with q as (select embedding from embeddings where vec_id = 3), s as (select vec_id as id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as c from embeddings e, q) select id, round(c, 5) as score from s where c >= 0.2 order by c desc, id limit 20",
    "embedding_texts": f"""{WITH} select item_id, md5(concat_ws(chr(10), 'meeting_name: ' || meeting_name, 'content: ' || content, case when {meaningful('owner')} then 'owner: ' || owner end, case when {meaningful('planned_date')} then 'planned_date: ' || planned_date end,
  case when {meaningful('tracking_result')} then 'tracking_result: ' || tracking_result end)) as digest from items join meetings using (meeting_id)""",
    "evidence_fusion": f"{FUSED} select item_id, matched_relation, evidence_source, graph_score from f",
    "evidence_trace": f"{FUSED} select 'source' as kind, evidence_source as value, count(*) as count from f group by all union all select 'relation', matched_relation, count(*) from f where matched_relation is not null group by all",
    "meetings_of_question": f"""{WITH}, s as (select meeting_id, document_id, upper(replace(meeting_name, ' ', '')) as n from meetings), q as (select 'WHICHITEMSHASTHEURGENTMACHINERYMEETING12DOC_12' as q),
t as (select unnest(['HAS', 'THE', 'URGENT', 'MACHINERY', '12', 'DOC_12']) as t),
x as (select meeting_id, case when contains(q, upper(meeting_id)) then 100 else 0 end + case when contains(q, n) then 100 else 0 end
  + coalesce((select sum(10 + length(t)) from t where contains(upper(meeting_id), t) or contains(n, t) or contains(upper(document_id), t)), 0) as score from s, q)
select meeting_id, score::bigint as match_score from x where score > 0 and score >= greatest(0.75 * (select max(score) from x), (select max(score) from x) - 10)""",
    "meeting_items_context": f"{FIRST_NAMED.format(60)} select item_id, meeting_name, content from firsts",
    "keyword_context": f"""{WITH} select item_id, meeting_name, content from items left join meetings m using (meeting_id) where {term('meeting_name', 'machinery')} or {term('content', 'blue bolt')}
order by meeting_id, item_no::int, item_no, item_id limit 500""",
    "structured_context": f"""{WITH}, r as (select item_id, 0 as src, 4.0::double as score from items join meetings using (meeting_id) where {owned()} and owner like '%000000007%' union all select item_id, 1, 0.5 + page_number / 10 from items where regulation = 'Brand#21'),
b as (select item_id, min(src) as src, arg_min(score, src) as score from r group by 1) select item_id, meeting_name, content from b join items using (item_id) left join meetings using (meeting_id) order by src, score desc, item_id limit 700""",
    "graph_context": f"""{WITH}, a as (select distinct meeting_id, unnest(attendees || [chairperson, recorder]) as p from meetings), i as (select items.* from items join meetings using (meeting_id))
select 'Meeting(' || meeting_id || ')-[:HAS_ITEM]->MeetingItem(' || item_id || ')-[:RESPONSIBLE_BY]->Person(' || owner || ')' as path, 'complete_evidence' as selection from i where {owned()} and owner like '%000000007%'
union all select 'Meeting(' || meeting_id || ')-[:ATTENDED_BY]->Entity(' || p || '); Meeting(' || meeting_id || ')-[:HAS_ITEM]->MeetingItem(' || item_id || ')', 'complete_evidence' from i join a using (meeting_id) where lower(p) like '%guest#3%'
union all select 'Meeting(' || meeting_id || ')-[:HAS_ITEM]->MeetingItem(' || item_id || ')-[:MENTIONS_PRODUCT]->Product(' || product || ')', 'complete_evidence' from i where product = 'red ring'""",
    "graph_preview": f"""{WITH} select 'Keyword(red ring)-[:MENTIONS {{field: content}}]-MeetingItem(' || item_id || ')<-[:HAS_ITEM]-Meeting(' || meeting_id || ')' as path, 'ranked_preview' as selection
from items join meetings using (meeting_id) where product = 'red ring' order by coalesce(meeting_date, ''), item_id limit 6""",
    "composite_paths": f"""{COMPOSED} select item_id, 'Meeting(' || meeting_id || ')-[:HAS_ITEM]->MeetingItem(' || item_id || '); ' || array_to_string(list_sort(list_filter([
  'MeetingItem(' || item_id || ')-[:TRACKS_ISSUE]->Issue(' || title || ')', 'MeetingItem(' || item_id || ')-[:RESPONSIBLE_BY]->Person(' || owner || ')', 'MeetingItem(' || item_id || ')-[:MENTIONS_REGULATION]->Regulation(' || regulation || ')',
  case when contains(product, 'gear') then 'MeetingItem(' || item_id || ')-[:MENTIONS]->Keyword(' || product || ')' end], lambda x: x is not null)), '; ') as path from composed""",
    "summary_answer": f"""{FIRST_NAMED.format(7)}, o as (select *, row_number() over (order by meeting_id, item_no::int, item_no, item_id) as k from firsts)
select case when any_value(names) = '' then '根據會議記錄，' else '根據 ' || any_value(names) || ' 的會議記錄，' end || '重點可整理為：' || string_agg(content, '；' order by k) filter (where k <= 5) || case when count(*) > 5 then '；另有 ' || (count(*) - 5) || ' 項相關紀錄可作為補充' else '' end || '。' as answer
from o, (select string_agg(meeting_name, '、' order by k) as names from (select meeting_name, min(k) as k from o group by 1 order by 2 limit 3))""",
    "deidentified": f"""{WITH} select meeting_id, {PSEUDO.format('Person', 'person', 'chairperson')} as chairperson, {PSEUDO.format('Unit', 'unit', 'responsible_unit')} as responsible_unit, 'Call person at phone or email on 2001-08-01' as content from meetings""",
    "mapping_export": f"""{WITH} select distinct 'person' as kind, chairperson as original, {PSEUDO.format('Person', 'person', 'chairperson')} as anonymized from meetings
union all select distinct 'unit', responsible_unit, {PSEUDO.format('Unit', 'unit', 'responsible_unit')} from meetings""",
    "status_repair": f"{WITH}, {STATUSES} select s.status, s.status_source, s.status_confidence, count(*) as n from statuses s join items i using (item_id) where s.status <> 'pending' or s.planned_date is distinct from i.planned_date or s.actual_completed_date is distinct from i.actual_completed_date group by all",
    "duplicate_lines": "select l_orderkey || '-' || l_linenumber as key, count(*) as rows from lineitem group by 1 having count(*) > 1",
    "node_properties": f"""{SPOKEN}, kw as (select product as name, 'product' as type, 0.76 as score from items union all select regulation, 'regulation', 0.74 from items union all select regexp_extract(meeting_name, '(\\w+) review$', 1), 'english_phrase', 0.7 from meetings),
people as (select unnest([chairperson, recorder] || attendees) as name from meetings union select trim(owner) from items where {owned()})
select distinct * from (
  select 'Document' as type, document_id as id, 'document_id=' || document_id || '|original_filename=' || document_id || '.pdf' as properties from meetings
  union all select 'Meeting', meeting_id, concat_ws('|', 'meeting_date=' || meeting_date, 'meeting_id=' || meeting_id, 'meeting_name=' || meeting_name, 'responsible_unit=' || responsible_unit) from meetings
  union all select 'MeetingItem', item_id, concat_ws('|', 'actual_completed_date=' || actual_completed_date, 'content=' || content, 'item_id=' || item_id, 'item_no=' || item_no, 'planned_date=' || planned_date, 'status=' || status, 'status_confidence=' || status_confidence, 'status_source=' || status_source) from titled
  union all select 'Date', planned_date, 'date_type=planned|date_value=' || planned_date from statuses where planned_date is not null
  union all select 'Date', actual_completed_date, 'date_type=completed|date_value=' || actual_completed_date from statuses where actual_completed_date is not null
  union all select 'Person', name, 'name=' || name from people where {owned('name')} union all select 'Unit', responsible_unit, 'name=' || responsible_unit from meetings
  union all select 'Keyword', name, 'name=' || name || '|type=' || arg_max(type, score) from kw group by name
  union all select 'Product', product, 'name=' || product from items union all select 'Regulation', regulation, 'name=' || regulation from items
  union all select 'ActionItem', 'action_' || item_id, concat_ws('|', 'action_id=action_' || item_id, 'actual_completed_date=' || actual_completed_date, 'content=' || content, 'planned_date=' || planned_date, 'status=' || status, 'status_confidence=' || status_confidence, 'status_source=' || status_source,
    'title=' || title, 'tracking_result=' || regexp_replace(coalesce(tracking_result, ''), '\\s+', ' ', 'g')) from titled
  union all select 'Decision', 'decision_' || item_id, 'decision_id=decision_' || item_id || '|evidence=' || text || '|title=' || title from titled where {DECIDED}
  union all select 'Risk', 'risk_' || item_id, 'evidence=' || text || '|name=' || title || '|risk_id=risk_' || item_id || '|severity=' || case item_no when '04' then 'high' else 'low' end from titled where {RISKY}
  union all select 'Issue', issue_id, 'issue_id=' || issue_id || '|signature=' || signature || '|title=' || min(title) from issues group by issue_id, signature)""",
    "mention_edges": f"""{WITH} select distinct 'MeetingItem' as src_type, item_id as src_id, product as dst_id, 'content' as field, 0.76::double as score, 'regex' as method from items union select 'MeetingItem', item_id, regulation, 'content', 0.74::double, 'regex' from items
union select 'Meeting', meeting_id, regexp_extract(meeting_name, '(\\w+) review$', 1), 'meeting_name', 0.7::double, 'phrase' from meetings""",
    "cooccurrence_edges": f"""{WITH}, {CO} select "left" as src_id, 'CO_OCCURS_WITH' as relation, "right" as dst_id, count::bigint as count, weight from co""",
    "decision_risk_edges": f"""{WITH}, {ISSUES} select 'MeetingItem' as src_type, item_id as src_id, 'HAS_DECISION' as relation, 'Decision' as dst_type, 'decision_' || item_id as dst_id from items where {DECIDED}
union all select 'MeetingItem', item_id, 'HAS_RISK', 'Risk', 'risk_' || item_id from items where {RISKY}
union all select 'Decision', 'decision_' || item_id, 'DECIDES_ON', 'Issue', issue_id from issues where {DECIDED} union all select 'Risk', 'risk_' || item_id, 'RISK_OF', 'Issue', issue_id from issues where {RISKY}""",
    "semantic_edges": f"""{WITH}, {ISSUES} select 'MeetingItem' as src_type, item_id as src_id, 'RESPONSIBLE_BY' as relation, 'Person' as dst_type, trim(owner) as dst_id from items where {owned()}
union all select 'ActionItem', 'action_' || item_id, 'ASSIGNED_TO', 'Person', trim(owner) from items where {owned()} union all select 'ActionItem', 'action_' || item_id, 'TARGETS_PRODUCT', 'Product', product from items
union all select 'ActionItem', 'action_' || item_id, 'CONSTRAINED_BY', 'Regulation', regulation from items union all select 'MeetingItem', item_id, 'TRACKS_ISSUE', 'Issue', issue_id from issues""",
    "structure_edges": f"""{WITH} select distinct * from (select 'Document' as src_type, document_id as src_id, 'HAS_MEETING' as relation, 'Meeting' as dst_type, meeting_id as dst_id from meetings union all select 'Meeting', meeting_id, 'HAS_ITEM', 'MeetingItem', item_id from items
union all select 'Meeting', meeting_id, 'BELONGS_TO_UNIT', 'Unit', responsible_unit from meetings union all select 'Meeting', meeting_id, 'CHAIRED_BY', 'Person', chairperson from meetings union all select 'Meeting', meeting_id, 'RECORDED_BY', 'Person', recorder from meetings
union all select 'Meeting', meeting_id, 'ATTENDED_BY', 'Person', unnest([chairperson, recorder] || attendees) from meetings
union all select 'MeetingItem', item_id, 'HAS_PLANNED_DATE', 'Date', planned_date from items where {meaningful('planned_date')} union all select 'MeetingItem', item_id, 'HAS_COMPLETED_DATE', 'Date', actual_completed_date from items where {meaningful('actual_completed_date')})""",
    "stored_deidentified": f"""{WITH} select meeting_id, meeting_date, {pseudo('Person', 'chairperson')} as chairperson, {pseudo('Person', 'recorder')} as recorder, {pseudo('Unit', 'responsible_unit')} as responsible_unit,
  {pseudo('Person', 'attendees[1]')} || ',' || {pseudo('Person', 'attendees[2]')} as attendees, 'Review by 人員 and 人員 of 單位: 人員 called 人員 at 電話 or 電子郵件 on 2001-08-01' as raw_text from meetings""",
    "stored_changes": f"{WITH} select count(*)::bigint as seen, count(*)::bigint as changed from meetings",
    "neutral_texts": f"{WITH} select meeting_id, '人員 of 單位, XPerson_0123456789' as content from meetings",
    "deidentified_nodes": f"""{WITH} select distinct 'Person' as type, chairperson as id, 'name=' || {pseudo('Person', 'chairperson')} as properties from meetings union select 'Unit', responsible_unit, 'name=' || {pseudo('Unit', 'responsible_unit')} from meetings
union select 'Meeting', meeting_id, 'meeting_date=' || meeting_date || '|meeting_id=' || meeting_id || '|meeting_name=' || meeting_name || ' with 人員|responsible_unit=' || {pseudo('Unit', 'responsible_unit')} from meetings""",
    "uploaded_documents": f"""{WITH} select 'doc_' || meeting_id as document_id, meeting_name || '.v1.PDF' as original_filename, 'doc_' || meeting_id || '.pdf' as stored_filename, 'uploads/doc_' || meeting_id || '.pdf' as file_path, '.pdf' as file_ext, length(meeting_name)::bigint as file_size,
  'application/pdf' as mime_type, case when meeting_id::int % 3 = 0 then 'minutes' else 'unknown' end as doc_type, 'uploaded' as status, '' as description, 'a|' || responsible_unit as tags,
  case when meeting_id::int % 2 = 0 then meeting_date when meeting_id::int % 5 = 0 then '2001-01-01' else '2001-08-01' end || 'T00:00:00+00:00' as file_modified_at, '2001-08-01T00:00:00+00:00' as created_at, false as is_deleted from meetings""",
    "answered_nothing": "select '查無足夠的會議紀錄脈絡可供回答。' as answer",
    "answered_meeting": f"""{WITH}, c as (select items.* from items join meetings using (meeting_id) where contains(lower(meeting_name), 'urgent machinery review') order by meeting_id, item_no::int, item_no, item_id limit 20)
select printf('evidence_%03d', row_number() over (order by meeting_id, item_id)) as evidence_id, meeting_id, item_id, 'structured' as evidence_source, content as claim from c""",
}
# The same scores as the keyword search's, of which the first 48 rows and of these the best 12 items answer.
ORACLES["answered_keyword"] = ORACLES["graph_search_keywords"].split("select item_id, graph_score, matched_keyword from s order")[0].rstrip() + """,
g as (select * from s order by graph_score desc, coalesce(meeting_date, ''), item_id limit 48), b as (select item_id, max(graph_score) as best from g group by 1 order by 2 desc, 1 limit 12),
e as (select meeting_id, item_id, content, matched_keyword, graph_score from g join b using (item_id) join items using (item_id) order by graph_score desc, meeting_id, item_id, matched_keyword limit 24)
select printf('evidence_%03d', row_number() over (order by graph_score desc, meeting_id, item_id, matched_keyword)) as evidence_id, meeting_id, item_id, 'graph' as evidence_source, content || ' mentions ' || matched_keyword as claim from e"""

NAMED_ITEMS = """named as (select * replace (case when meeting_id in ('1', '2') then '王小明' else owner end as owner) from items)"""
# The newest rows of each part, then the best of both, as explicit routes search no further than the answer's limit.
ORACLES["answered_composite"] = f"""{WITH}, {NAMED_ITEMS}, {STATUSES.replace("from items", "from named")},
own as (select s.*, meeting_date from statuses s join meetings using (meeting_id) where owner = '王小明'),
g as (select * from (select meeting_id, item_id, 'RESPONSIBLE_BY' as matched_relation, 4.0 as score, meeting_date from own order by meeting_date desc nulls first, item_no, item_id limit 15)
  union all select * from (select meeting_id, item_id, 'HAS_ACTION', 3.8, meeting_date from own where item_no in ('01', '03') and actual_completed_date is null and status not in ('completed', 'not_applicable') order by meeting_date desc nulls first, item_no, item_id limit 15))
select meeting_id, item_id, matched_relation from g order by score desc, meeting_date, item_id limit 15"""
ORACLES["planned_questions"] = f"""{WITH}, k as (select item_id, item_no::int as k, product from items)
select item_id, ['risks', 'decisions', 'action_items', 'issues', 'meeting_items', 'action_items', 'meeting_items'][k] as target, ['', '', '王小明', '', '', 'Carol', ''][k] as person_name, '' as unit_name,
  case when k = 3 then 'Conformity stem' else '' end as product_name, case when k in (1, 3) then 'FDA' else '' end as regulation_name, ['not_completed', 'completed', 'not_completed', '', '', '', ''][k] as status,
  case k when 2 then split_part(product, ' ', 1) when 4 then '跨會議' when 5 then 'what' else '' end as keyword, k = 4 as include_followups from k"""
ORACLES["extracted_keywords"] = f"""{WITH}, runs as (select unnest(['標籤更新需於下次審查前完', '成並回覆法規單位']) as r), sizes as (select unnest([2, 3, 4]) as s),
grams as (select distinct substring(r, i, s) as name from (select r, s, unnest(range(1, length(r) - s + 2)) as i from runs, sizes)),
k as (select product as name, 'english_phrase' as type, 0.7::double as score, 'regex_phrase' as method, count(*) as n from items group by 1
  union all select 'Conformity stem', 'product', 0.76, 'regex_product_phrase', count(*) from items
  union all select name, 'chinese_term', 0.38, 'cjk_ngram', (select count(*) from items) from grams where name not in ('單位'))
select * from k"""
ORACLES["extracted_mentions"] = f"""{WITH}, p as (select product, split_part(product, ' ', 2) in ('ring', 'bolt', 'gear', 'gizmo', 'plate', 'rod', 'widget', 'anvil') as cued from items),
t as (select tracking_result || ' UPD' as t from items where tracking_result is not null),
m as (select substring(meeting_name, 3) as t from meetings),
k as (select 'Meeting' as owner_type, 'meeting_name' as field, t as name, 'english_phrase' as type, 0.7::double as score, 'regex_phrase' as method from m
  union all select 'Meeting', 'meeting_name', unnest(regexp_extract_all(t, '[A-Z]+')), 'abbreviation', 0.74, 'regex_abbreviation' from m
  union all select 'MeetingItem' as owner_type, 'content' as field, 'Check the ' || product || ' for' as name, 'english_phrase' as type, 0.7::double as score, 'regex_phrase' as method from p
  union all select 'MeetingItem', 'content', unnest([product, 'the ' || product]), 'product', 0.76, 'regex_product_phrase' from p where cued
  union all select 'MeetingItem', 'tracking_result', 'UPD', 'abbreviation', 0.74, 'regex_abbreviation' from t
  union all select 'MeetingItem', 'tracking_result', regexp_replace(t, '\\s+', ' ', 'g'), 'english_phrase', 0.7, 'regex_phrase' from t where t not like '—%')
select owner_type, field, name, type, score, method, count(*) as n from k group by all"""
ORACLES["vector_index_exact"] = """select query_id, vec_id, round(score, 5) as score, rank from (
  select q.vec_id as query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score,
    row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id)::int as rank
  from embeddings e, embeddings q where q.vec_id % 20 = 0) where rank <= 10"""
ORACLES["expanded_nodes"] = f"""{WITH}, {STATUSES},
linked as (select 'Product:' || product as node_id, item_id, null as rel from statuses union all select 'Regulation:' || regulation, item_id, null from statuses union all select 'Person:' || owner, item_id, null from statuses where {owned()}
  union all select 'Date:' || planned_date, item_id, 'HAS_PLANNED_DATE' from statuses where planned_date is not null
  union all select 'Date:' || actual_completed_date, item_id, 'HAS_COMPLETED_DATE' from statuses where actual_completed_date in (select planned_date from statuses)),
placed as (select node_id, m.meeting_id, meeting_date, item_id, item_no, rel from linked join items using (item_id) join meetings m using (meeting_id)
  union all select 'Unit:' || responsible_unit, meeting_id, meeting_date, null, null, null from meetings),
r as (select *, row_number() over (partition by node_id order by meeting_date desc, item_no nulls last, item_id nulls last, meeting_id, rel)::int as seq from placed)
select node_id, seq, meeting_id, item_id, rel as date_relation from r where seq <= 5"""
ORACLES["expanded_items"] = f"""{WITH}, {STATUSES}, {ISSUES}, named as (select i.* from items i join meetings using (meeting_id)), st as (select s.* from statuses s join meetings using (meeting_id)),
dates as (select item_id, planned_date as d, 'HAS_PLANNED_DATE' as rel from st where planned_date is not null union all select item_id, actual_completed_date, 'HAS_COMPLETED_DATE' from st where actual_completed_date is not null),
texts as (select item_id, trim(regexp_replace(content || coalesce(' ' || tracking_result, ''), '\\s+', ' ', 'g')) as t from named), titled as (select *, case when length(t) <= 96 then t else left(t, 95) || '...' end as title from texts)
select 'Meeting' as kind, count(distinct meeting_id) as n from named union all select 'MeetingItem', count(*) from named union all select 'Product', count(distinct product) from named union all select 'Regulation', count(distinct regulation) from named
union all select 'Person', count(distinct owner) from named where {owned()} union all select 'Date', count(distinct d) from dates union all select 'Keyword', count(distinct k) from (select product as k from named union all select regulation from named)
union all select 'ActionItem', count(distinct title) from titled union all select 'Issue', count(distinct title) from issues join meetings using (meeting_id)
union all select unnest(['HAS_ITEM', 'MENTIONS_PRODUCT', 'MENTIONS_REGULATION', 'HAS_ACTION', 'TRACKS_ISSUE']), count(*) from named union all select 'MENTIONS', 2 * count(*) from named
union all select 'RESPONSIBLE_BY', count(*) from named where {owned()} union all select rel, count(*) from dates group by 1
union all select 'CO_MENTIONED_WITH', count(distinct (product, regulation)) from named union all select 'ASSOCIATED_WITH', count(distinct (owner, product)) from named where {owned()}"""
ORACLES["evaluated_cases"] = f"""{WITH}, own as (select meeting_id as id, meeting_id::bigint as k, meeting_name, array_agg(item_id order by item_id) as ids from items join meetings using (meeting_id) group by all),
seen as (select *, list_filter(ids, lambda x, i: i % 2 = 1) as odd from own), texts as (select *, lower(meeting_name || ' ' || array_to_string(odd, ' ')) as said from seen),
checks as (
  select id, 1 as part, 1 as i, 1 as j, 'expected insufficient-context response' as f from texts where k % 11 = 0
  union all select id, 2, i, 1, 'answer missing expected item_id: ' || x from (select *, unnest(ids[1:2]) as x, unnest(range(len(ids[1:2]))) as i from texts) where not contains(said, x)
  union all select id, 2, i, 2, 'sources missing expected item_id: ' || x from (select *, unnest(ids[1:2]) as x, unnest(range(len(ids[1:2]))) as i from texts) where not list_contains(odd, x)
  union all select id, 3, 1, 1, 'unexpected item_id present: ' || ids[3] from texts where len(ids) >= 3
  union all select id, 4, 1, 1, 'answer missing expected meeting_id: ' || id from texts where not contains(said, id)
  union all select id, 5, 1, 1, 'graph missing expected relation: HAS_ITEM' from texts where k % 3 = 0
  union all select id, 7, 1, 1, 'answer contains forbidden text: 4-not' from texts where contains(said, '4-not')
  union all select id, 8, 1, 1, 'uneven' from texts where k % 5 = 0 and k % 2 = 0),
failed as (select id, string_agg(f, '|' order by part, i, j) as failures from checks group by id)
select id, case when k % 7 = 0 then 'skipped' when k % 13 = 0 or failures is not null then 'failed' else 'passed' end as status, case when k % 7 = 0 then '' when k % 13 = 0 then 'no answer' else coalesce(failures, '') end as failures
from texts left join failed using (id)"""
