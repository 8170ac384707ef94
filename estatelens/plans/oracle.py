"""The DuckDB text each registered query is checked against, written from the definitions, not from the Spark code."""

from __future__ import annotations

import re

from estatelens.operators.messages import MESSAGES
from estatelens.plans.derived import duckdb_sql

STRIP = r'/\*(?s:.*?)(?:\*/|\z)|//[^\n]*|"[^"]*(?:""[^"]*)*(?:"|\z)'
QUAL = r"(?:''[^'']+''|[A-Za-z_]\w*)\[[^\]]*\]"  # quotes doubled for SQL
EXTERNAL = r'(?i)EXTERNALMEASURE\s*\(\s*"((?:[^"]|"")*)"\s*,\s*(\w+)\s*,\s*"DirectQuery to AS - ((?:[^"]|"")*)"\s*\)'
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]+)?([^?#]*)"
CONNECTOR = r'\b([A-Z][A-Za-z0-9]*)\.(?:Database|Databases|DataSource)\s*\(\s*"([^"]*)"(?:\s*,\s*"([^"]*)")?'
FIRST_CALL = r"\b([A-Z][A-Za-z0-9]*(?:\.[A-Za-z][A-Za-z0-9]*)+)\s*\("
SPACES = r"' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)"


def slug_chain(text: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"trim({text}, '-')"


def github(text: str) -> str:
    return slug_chain(f"lower({text})", (r"[^\w\s-]", ""), (r"\s+", "-"), ("-+", "-"))


def wiki(text: str) -> str:
    return slug_chain(f"lower({text})", (r"[:.,/&()!?''\"`]", ""), (r"[^\w\-]+", "-"), ("-+", "-"))


def dash(text: str) -> str:
    return f"case when coalesce({text},'')='' then '—' else {text} end"


def cut(text: str, keep: int, limit: int) -> str:
    return f"case when length({text})>{limit} then left({text},{keep})||'…' else {text} end"


def cell(text: str) -> str:
    return f"replace(replace(coalesce(cast({text} as varchar),''),'|','\\|'),chr(10),' ')"


def letter(text: str) -> str:
    return f"case when regexp_matches(upper(left({text},1)),'^[A-Z]$') then upper(left({text},1)) else '#' end"


# ---- views shared by several oracles ----------------------------------------------------------------------------

V: dict[str, str] = {}
V["o_clean"] = f"select name, table_name, body, regexp_replace(body, '{STRIP}', '', 'g') as clean from e_measures"


def qualified(source: str) -> str:
    return f"""select distinct label, trim(regexp_extract(r, '^''?([^''\\[]+)''?\\[', 1)) as ref_table, trim(regexp_extract(r, '\\[([^\\]]*)\\]$', 1)) as ref_column
 from (select label, unnest(regexp_extract_all(clean, '{QUAL}')) as r from {source}) q where trim(regexp_extract(r, '\\[([^\\]]*)\\]$', 1))<>''"""


def bare(source: str) -> str:
    return f"""select distinct label, trim(unnest(regexp_extract_all(regexp_replace(clean, '{QUAL}', ' ', 'g'), '\\[([^\\]]+)\\]', 1))) as ref_name from {source}"""


V["o_labelled"] = "select name as label, clean from o_clean"
V["o_qual"] = qualified("o_labelled")
V["o_bare"] = bare("o_labelled")
V["o_token"] = "select distinct name, unnest(regexp_extract_all(body, '\\[([^\\[\\]]*)\\]', 1)) as ref_name from e_measures"
V["o_edges"] = "select distinct b.label as src, m.name as dst from o_bare b join e_measures m on lower(m.name)=lower(b.ref_name) where m.name<>b.label"
V["o_cedges"] = "select distinct t.name as src, m.name as dst from o_token t join e_measures m on lower(m.name)=lower(t.ref_name) where m.name<>t.name"
V["o_ext"] = f"""select table_name, name, replace(regexp_extract(body,'{EXTERNAL}',1),'""','"') as remote_name, upper(regexp_extract(body,'{EXTERNAL}',2)) as remote_type
 , replace(regexp_extract(body,'{EXTERNAL}',3),'""','"') as external_model from e_measures where regexp_matches(body,'{EXTERNAL}')"""
V["o_remote"] = """select x.*, nullif(regexp_extract(e.value,'AnalysisServices\\.Database\\s*\\(\\s*"([^"]+)"',1),'') as cluster
 , nullif(regexp_extract(e.value,'AnalysisServices\\.Database\\s*\\(\\s*"[^"]+"\\s*,\\s*"([^"]+)"',1),'') as database
 from o_ext x left join x_expressions e on e.name='DirectQuery to AS - '||x.external_model"""
V["o_bound"] = """select * from (select case when field_type='measure' then 'measure' else 'column' end as kind, *
 , row_number() over (partition by case when field_type='measure' then 'measure' else 'column' end, table_name, field_name, page_id, visual_id order by role='Filter', seq) as rn from x_bindings) b where rn=1"""
V["o_usage"] = """select kind, table_name, field_name, count(*) as usage_count, count(distinct page_id) as page_count
 , bool_or(visual_type in ('slicer','listSlicer','textSlicer','advancedSlicerVisual')) as is_slicer_field from o_bound group by kind, table_name, field_name"""
V["o_fields"] = "select 'measure' as kind, table_name, name as field_name from e_measures union all select 'column', table_name, name from x_columns"
V["o_known"] = "select b.* from o_bound b semi join o_fields f on f.kind=b.kind and f.table_name=b.table_name and f.field_name=b.field_name"
V["o_mcount"] = """select m.table_name, m.name, coalesce(u.usage_count,0) as usage_count, coalesce(u.page_count,0) as page_count
 from e_measures m left join o_usage u on u.kind='measure' and u.table_name=m.table_name and u.field_name=m.name"""
V["o_reach"] = """select name from o_mcount where usage_count>0 union select e.dst from o_reach r join o_edges e on e.src=r.name"""
V["o_creach"] = """select name from o_mcount where usage_count>0 union select e.dst from o_creach r join o_cedges e on e.src=r.name"""
for prefix in ("", "c"):
    V[f"o_{prefix}mstatus"] = f"""select c.*, case when usage_count>0 then 'direct' when r.name is not null then 'indirect' else 'unused' end as status
 from o_mcount c left join o_{prefix}reach r on r.name=c.name"""
V["o_relcols"] = "select from_table as table_name, from_column as name from x_rels union select to_table, to_column from x_rels"
V["o_livecols"] = """select c.table_name, c.name from x_columns c where c.name in
 (select t.ref_name from o_token t join o_mstatus s on s.name=t.name where s.status<>'unused')"""
V["o_livecols_strict"] = """select c.table_name, c.name from x_columns c where (c.table_name, c.name) in
 (select (q.ref_table, q.ref_column) from o_qual q join o_mstatus s on s.name=q.label where s.status<>'unused')"""
for suffix in ("", "_strict"):
    V[f"o_cstatus{suffix}"] = f"""select c.table_name, c.name, coalesce(u.usage_count,0) as usage_count, coalesce(u.page_count,0) as page_count
 , coalesce(u.is_slicer_field,false) as is_slicer_field, case when u.usage_count>0 then 'direct'
   when exists (select 1 from o_relcols r where r.table_name=c.table_name and r.name=c.name)
     or exists (select 1 from o_livecols{suffix} l where l.table_name=c.table_name and l.name=c.name) then 'indirect' else 'unused' end as status
 from x_columns c left join o_usage u on u.kind='column' and u.table_name=c.table_name and u.field_name=c.name"""
V["o_names"] = "select table_name from x_columns union select table_name from e_measures union select group_name from x_calc_items"
V["o_cols"] = "select * from x_columns where not (name='Name' and table_name in (select group_name from x_calc_items))"
V["o_keys"] = """select c.*, coalesce(i.n,0)>0 as is_inferred_pk, o.t is not null as is_fk, o.t as fk_table, o.c as fk_column
 , coalesce(i.n,0) as incoming_refs, coalesce(i.inactive,0) as inactive_refs
 from x_columns c left join (select from_table, from_column, arg_max(to_table,rel_no) as t, arg_max(to_column,rel_no) as c from x_rels group by from_table, from_column) o
   on o.from_table=c.table_name and o.from_column=c.name
 left join (select to_table, to_column, count(*) as n, count(*) filter (not is_active) as inactive from x_rels group by to_table, to_column) i
   on i.to_table=c.table_name and i.to_column=c.name"""
V["o_ckeys"] = "select * from o_keys where not (name='Name' and table_name in (select group_name from x_calc_items))"
V["o_constraints"] = """select *, case when t='' then '—' else t end as constraints from (select *, concat_ws(' ', case when is_key then 'PK' when is_inferred_pk then 'PK*' end
 , case when is_fk then 'FK → '||fk_table||'['||fk_column||']' end, case when incoming_refs>0 then 'Ref ← '||incoming_refs end
 , case when is_calculated then 'CALC' end, case when is_hidden then 'HIDDEN' end) as t from o_ckeys) k"""
V["o_summary"] = """select *, case when origin='auto-date' then 'Auto-date' when is_calc_group then 'Calculation Group' when outgoing>0 and incoming=0 then 'Fact'
   when outgoing=0 and incoming>0 then 'Dimension' when outgoing>0 and incoming>0 then 'Bridge' else 'Disconnected' end as role
 , case when coalesce(parameter_kind,'')='field' then 'field-param' when parameter_kind='compositeModelProxy' then 'proxy' when is_calc_group then 'calcgroup'
   when measure_count>0 and column_count<=1 and lower(table_name) like '%measure%' then 'measure' else 'data' end as table_group
 from (select n.table_name, coalesce(d.description,'') as description, case when regexp_matches(n.table_name,'^(LocalDateTable_|DateTableTemplate_)') then 'auto-date' else 'user' end as origin
   , n.table_name in (select group_name from x_calc_items) as is_calc_group
   , coalesce(p.calculated,false) and n.table_name not in (select group_name from x_calc_items) as is_calculated
   , case when coalesce(c.param,false) then 'field' when coalesce(p.remote,false) and c.n=1 and c.self=1 then 'compositeModelProxy' end as parameter_kind
   , coalesce(c.n,0) as column_count, coalesce(m.n,0) as measure_count, coalesce(c.keys,0) as key_count, coalesce(c.fks,0) as fk_count, coalesce(c.hid,0) as hidden_count
   , coalesce(p.n,0) as partition_count, coalesce(p.dq,false) as has_direct_query, p.expr as remote_expression
   , (select count(*) from x_rels r where r.from_table=n.table_name) as outgoing, (select count(*) from x_rels r where r.to_table=n.table_name) as incoming
   from o_names n left join (select table_name, max(description) as description from x_tables group by table_name) d on d.table_name=n.table_name
   left join (select table_name, count(*) as n, count(*) filter (is_key or is_inferred_pk) as keys, count(*) filter (is_fk) as fks, count(*) filter (is_hidden) as hid
     , count(*) filter (name=table_name) as self, bool_or(has_param_metadata) as param from o_ckeys group by table_name) c on c.table_name=n.table_name
   left join (select table_name, count(*) as n from e_measures group by table_name) m on m.table_name=n.table_name
   left join (select table_name, count(*) as n, bool_or(kind='calculated') as calculated, bool_or(mode='directQuery') as dq
     , bool_or(mode='directQuery' and expression_source<>'') as remote, min(case when lower(mode)='directquery' and expression_source<>'' then expression_source end) as expr
     from x_partitions group by table_name) p on p.table_name=n.table_name) s"""
V["o_resolved"] = """select p.table_name, p.part_no, p.name, p.mode, p.kind, p.expression_source, case when coalesce(e.value,'')<>'' then e.value else p.m_body end as m_body
 from x_partitions p left join x_expressions e on e.name=p.expression_source"""
V["o_typed"] = """select *, case when contains(m_body,'Table.FromRows(') then 'Inline data' when contains(lower(m_body),'sql.database(') then 'SQL Server'
   when contains(lower(m_body),'csv.document(') then 'CSV' when contains(lower(m_body),'json.document(') then 'JSON' when contains(lower(m_body),'sharepoint.files(') then 'SharePoint Files'
   when contains(lower(m_body),'analysisservices.database(') then 'Analysis Services' when contains(lower(m_body),'googlebigquery.') then 'BigQuery' else 'Unknown / M' end as source_type
 , regexp_extract(m_body,'"([^"]+)"',1) as source_location
 , replace(regexp_extract(m_body,'Value\\.NativeQuery\\([^,"]*,\\s*"((?:[^"]|"")*)"',1),'""','"') as native_query from o_resolved"""
V["o_sqlsrc"] = f"""select table_name, part_no, regexp_extract(m_body,'{CONNECTOR}',1) as kind, regexp_extract(m_body,'{CONNECTOR}',2) as server, regexp_extract(m_body,'{CONNECTOR}',3) as database
 , regexp_extract(m_body,'\\[Schema="([^"]+)",Item=',1) as schema, regexp_extract(m_body,'\\[Schema="[^"]+",Item="([^"]+)"',1) as name from o_resolved where regexp_matches(m_body,'{CONNECTOR}')"""
V["o_bqsrc"] = """select table_name, part_no, 'BigQuery' as kind, 'GoogleBigQuery' as server, regexp_extract(m_body,'\\[Name="([^"]+)"\\]',1) as database
 , regexp_extract(m_body,'Name="([^"]+)",Kind="Schema"',1) as schema, regexp_extract(m_body,'Name="([^"]+)",Kind="Table"',1) as name from o_resolved where contains(m_body,'GoogleBigQuery.Database')"""
V["o_filesrc"] = """select table_name, part_no, 'CSV' as kind, '' as server, '' as database, regexp_extract(p,'^(.*)/[^/]*$',1) as schema, regexp_extract(p,'([^/]*)$',1) as name
 from (select *, replace(regexp_extract(m_body,'File\\.Contents\\("([^"]+)"',1),chr(92),'/') as p from o_resolved) f where p<>''"""
_HOST, _PATH = f"lower(regexp_extract(u,'{URL}',1))", f"regexp_extract(u,'{URL}',2)"
_OK = f"regexp_matches(u,'{URL}')"
V["o_websrc"] = f"""select table_name, part_no, case when w then 'Web' else 'SharePoint' end as kind, case when {_OK} then {_HOST} else '' end as server, '' as database
 , case when {_OK} and not w then case when {_PATH}='' then '/' else {_PATH} end else '' end as schema
 , case when not {_OK} then u when w then case when {_PATH}='' then '/' else {_PATH} end else '' end as name
 from (select *, contains(m_body,'Web.Contents(') as w, regexp_extract(m_body,'(?:Web\\.Contents|SharePoint\\.Files)\\("([^"]+)"',1) as u from o_resolved) x where u<>''"""
V["o_src"] = "select * from o_sqlsrc union all select * from o_bqsrc union all select * from o_filesrc union all select * from o_websrc"
V["o_srckeys"] = "select distinct concat_ws('|',kind,server,database,schema,name) as source_key, kind, server, database, schema, name, table_name from o_src"
V["o_lines"] = """select table_name, part_no, unnest(range(1,len(l)+1)) as step_no, unnest(l) as line
 from (select table_name, part_no, regexp_extract_all(m_body, '(?m)^    (?:#"[^"]+"|\\w+) = .*$') as l from o_resolved where starts_with(m_body,'let')) s"""
V["o_stext"] = """select table_name, part_no, step_no, regexp_extract(line,'^    (?:#")?([^"=]+?)"? = ',1) as name, regexp_replace(regexp_extract(line,' = (.*)$',1),',$','') as t from o_lines"""
V["o_steps"] = f"""select *, case when nav then 'navigation' when fn='Table.FromRows' or fn in ('Sql.Database','Json.Document','Csv.Document','GoogleBigQuery.Database','SharePoint.Files','Value.NativeQuery','AnalysisServices.Database') then 'source'
   when fn in ('Table.SelectRows','Table.Distinct') then 'filter' when fn='Table.NestedJoin' then 'join' when fn='Table.RenameColumns' then 'rename' when fn='Table.SelectColumns' then 'projection'
   when fn='Table.TransformColumnTypes' then 'typeChange' when fn='Table.AddColumn' then 'addColumn' when fn='Table.ExpandTableColumn' then 'expand' when fn='Table.Combine' then 'union' else 'custom' end as kind
 , case when nav then '' else fn end as primary_fn
 from (select *, regexp_matches(t,'\\{{\\[(Schema|Name)=.*\\}}\\[Data\\]') as nav, regexp_extract(t,'{FIRST_CALL}',1) as fn from o_stext) s"""
V["o_bucketed"] = f"""select s.table_name, s.column_count, s.measure_count, f.mode, f.kind, f.expression_source, f.source_type, f.source_location
 , case when f.source_type is null then '__nosrc__' when source_type='Analysis Services' then 'AS:'||source_location
   when source_type in ('Parquet','Excel','CSV','JSON','XML','Access','Inline (encoded)','Inline data')
     then case when regexp_extract(source_location,'^(.*)[/\\\\][^/\\\\]*$',1)<>'' then source_type||'|'||regexp_extract(source_location,'^(.*)[/\\\\][^/\\\\]*$',1) else source_type||'|__all__' end
   else source_type||'|'||source_location end as bucket
 from o_summary s left join o_first f on f.table_name=s.table_name where s.origin='user' and s.parameter_kind is null and not s.is_calc_group"""
V["o_first"] = "select * from (select *, row_number() over (partition by table_name order by part_no) as rn from o_typed) p where rn=1"
V["o_srcmap"] = """select c.name as "column", c.table_name, c.data_type, case when f.source_type is not null then f.mode when s.is_calculated then 'calculated' else '—' end as mode
 , case when f.source_type is not null then f.source_type when s.is_calculated then 'Calculated (DAX)' else '—' end as source_type, coalesce(f.source_location,'') as source_location, c.is_hidden, c.is_calculated
 from o_cols c join o_summary s on s.table_name=c.table_name left join o_first f on f.table_name=c.table_name where s.origin='user'"""
V["o_pages"] = """select p.page_id, p.name, p.hidden, p.width, p.height, coalesce(v.n,0) as visual_count, coalesce(b.m,0) as measure_count, coalesce(b.c,0) as column_count, coalesce(b.s,0) as slicer_count
 , cast(floor(coalesce(b.m,0)*100.0/(select count(*) from e_measures)+0.5) as bigint) as coverage
 from x_pages p left join (select page_id, count(*) as n from x_visuals group by page_id) v on v.page_id=p.page_id
 left join (select k.page_id, count(distinct k.field_name) filter (k.kind='measure') as m, count(distinct k.field_name) filter (k.kind='column') as c, any_value(s.s) as s
   from o_known k left join (select page_id, count(*) filter (visual_type='slicer') as s from o_vis group by page_id) s on s.page_id=k.page_id group by k.page_id) b on b.page_id=p.page_id"""
V["o_vis"] = "select page_id, visual_id, arg_min(visual_type,seq) as visual_type from o_known group by page_id, visual_id"
V["o_index"] = """select k.source_key, k.kind, k.server, k.database, k.schema, k.name, count(*) as table_count, coalesce(any_value(u.v),0) as visual_count, coalesce(any_value(u.p),0) as page_count
 , case when count(*)<=3 then string_agg(k.table_name,', ' order by k.table_name) else array_to_string(list_sort(list(k.table_name))[1:2],', ')||' (+'||(count(*)-2)||' more)' end as table_list
 from o_srckeys k left join (select s.source_key, count(distinct (b.page_id,b.visual_id)) as v, count(distinct b.page_id) as p
   from o_srckeys s join o_known b on b.table_name=s.table_name group by s.source_key) u on u.source_key=k.source_key
 group by k.source_key, k.kind, k.server, k.database, k.schema, k.name"""
V["o_checked"] = f"""select table_name||'['||name||']' as label, clean from o_clean where not regexp_matches(body,'{EXTERNAL}')
 union all select group_name||' · '||name, regexp_replace(body, '{STRIP}', '', 'g') from x_calc_items
 union all select 'Function '||name, regexp_replace(body, '{STRIP}', '', 'g') from x_functions"""
V["o_cqual"] = qualified("o_checked")
V["o_cbare"] = bare("o_checked")
V["o_broken"] = """select label as "where", ref_table||'['||ref_column||']' as broken, case when not known then 'table not in model' else 'column not on table' end as reason
 from (select *, exists (select 1 from o_names n where lower(n.table_name)=lower(q.ref_table)) as known from o_cqual q) q
 where not (known and (exists (select 1 from x_columns c where lower(c.table_name)=lower(q.ref_table) and lower(c.name)=lower(q.ref_column))
   or exists (select 1 from e_measures m where lower(m.name)=lower(q.ref_column))))
 union all select label, '['||ref_name||']', 'measure/column not found' from o_cbare b
 where lower(ref_name) not in (select lower(name) from e_measures union select lower(name) from x_columns)"""
V["o_calls"] = """select m.name, regexp_extract_all(a,'\\[([^\\]]+)\\]',1) as c, regexp_extract_all(a,'(\\w+)\\[',1) as t
 from (select name, unnest(regexp_extract_all(body,'(?i)USERELATIONSHIP\\s*\\(([^)]*)',1)) as a from e_measures) m"""
V["o_inactive"] = """select from_table, from_column, to_table, to_column from x_rels r where not is_active and not exists (select 1 from o_calls c
 where (lower(c.c[1])=lower(r.from_column) and lower(c.c[2])=lower(r.to_column)) or (lower(c.c[2])=lower(r.from_column) and lower(c.c[1])=lower(r.to_column)))"""
V["o_fnuse"] = """select distinct f.name as "function", m.table_name, m.name as measure from x_functions f join e_measures m
 on contains(m.body, ''''||f.name||'''') or regexp_matches(m.body, '(?:^|[^\\w.])'||replace(f.name,'.','\\.')||'\\(')"""
V["o_mfn"] = "select * from o_fnuse where not \"function\" like '%.About'"
V["o_norm"] = "select table_name, name, sha256(trim(regexp_replace(body,'\\s+',' ','g'))) as body_hash from e_measures where length(trim(regexp_replace(body,'\\s+',' ','g')))>=10"
V["o_dups"] = "select * from (select *, count(*) over (partition by body_hash) as copies from o_norm) d where copies>1"
V["o_closure"] = "select src, dst from o_edges union select c.src, e.dst from o_closure c join o_edges e on e.src=c.dst"
V["o_cycles"] = """select (select min(b.dst) from o_closure b join o_closure r on r.src=b.dst and r.dst=b.src where b.src=a.src) as component, a.src as node from o_closure a where a.src=a.dst"""
V["o_inside"] = "select a.component, e.src, e.dst from o_edges e join o_cycles a on a.node=e.src join o_cycles b on b.node=e.dst and b.component=a.component"
V["o_walk"] = """select component, component as node, 0 as depth from o_cycles where component=node
 union select w.component, i.dst, w.depth+1 from o_walk w join o_inside i on i.component=w.component and i.src=w.node
 where w.depth<(select count(*) from o_cycles c where c.component=w.component) and (w.depth=0 or w.node<>w.component)"""
V["o_depth"] = "select component, node, min(depth) as depth from o_walk group by component, node"
V["o_ring"] = "select component, min(depth) as ring_length from o_walk where node=component and depth>0 group by component"
V["o_parent"] = """select d.component, d.node, d.depth, min(i.src) as parent from o_depth d join o_inside i on i.component=d.component and i.dst=d.node
 join o_depth u on u.component=d.component and u.node=i.src and u.depth=d.depth-1 group by d.component, d.node, d.depth"""
V["o_back"] = """select l.component, l.ring_length-1 as depth, min(i.src) as node from o_ring l join o_inside i on i.component=l.component and i.dst=l.component
 join o_depth u on u.component=i.component and u.node=i.src and u.depth=l.ring_length-1 group by l.component, l.ring_length
 union select b.component, p.depth-1, p.parent from o_back b join o_parent p on p.component=b.component and p.node=b.node"""
V["o_hit0"] = """select k.source_key, m.name from o_srckeys k join e_measures m on m.table_name=k.table_name
 union select k.source_key, q.label from o_srckeys k join o_qual q on q.ref_table=k.table_name"""
V["o_hit"] = "select source_key, name from o_hit0 union select h.source_key, e.src from o_hit h join o_edges e on e.dst=h.name"
V["o_hitvis"] = """select h.source_key, b.page_id, b.visual_id from o_hit h join o_known b on b.kind='measure' and b.field_name=h.name
 union select k.source_key, b.page_id, b.visual_id from o_srckeys k join o_known b on b.kind='column' and b.table_name=k.table_name"""
V["o_glossary"] = f"""select name, kind, parent, note, {cut('d', 110, 110)} as description, {letter('name')} as letter from (
 select table_name as name, case when is_calc_group then 'Calc group' else 'Table' end as kind, '' as parent, concat_ws(', ', case when is_calc_group then 'calc group' end
   , case when parameter_kind='field' then 'field parameter' end, case when parameter_kind='compositeModelProxy' then 'composite proxy' end, case when is_calculated then 'calculated table' end) as note, description as d
   from o_summary where origin='user'
 union all select name, 'Column', table_name, concat_ws(', ', case when is_key then 'key' end, case when is_calculated then 'calculated' end, case when is_hidden then 'hidden' end), description
   from o_cols where not regexp_matches(table_name,'^(LocalDateTable_|DateTableTemplate_)')
 union all select m.name, 'Measure', m.table_name, concat_ws(', ', 'external proxy → '||x.external_model||'['||x.remote_name||']', case when s.status<>'direct' then s.status end), m.description
   from e_measures m join o_mstatus s on s.name=m.name left join o_ext x on x.name=m.name
 union all select name, 'UDF', '', parameters, description from x_functions where not name like '%.About'
 union all select name, 'Calc item', group_name, '', description from x_calc_items) g"""
V["o_totals"] = """select (select count(*) from e_measures) as measures
 , (select count(*) from o_mstatus where status='direct') as measures_direct, (select count(*) from o_mstatus where status='indirect') as measures_indirect, (select count(*) from o_mstatus where status='unused') as measures_unused
 , (select count(*) from x_columns) as columns
 , (select count(*) from o_cstatus where status='direct') as columns_direct, (select count(*) from o_cstatus where status='indirect') as columns_indirect, (select count(*) from o_cstatus where status='unused') as columns_unused
 , (select count(*) from x_rels) as relationships, (select count(*) from x_functions) as functions, (select count(distinct group_name) from x_calc_items) as calc_groups
 , (select count(*) from o_names) as tables, (select count(*) from x_pages) as pages, (select count(*) from x_visuals) as visuals"""
_USER = "not regexp_matches(table_name,'^(LocalDateTable_|DateTableTemplate_)')"
_CAT = """case when lower(visual_type) in ('tableex','pivottable') then 'table' when lower(visual_type) in ('card','cardvisual','cardnew','multirowcard','kpi','gauge') then 'card'
 when lower(visual_type) like '%slicer%' then 'slicer' when lower(visual_type) like '%chart%' then 'chart' end"""
V["o_er"] = "select table_name from o_summary where origin='user' and not is_calc_group order by table_name limit 30"
V["o_lite"] = f"""select m.name, m.table_name, s.status, {dash('m.format_string')} as format, {dash(cut("regexp_replace(m.description,'\\s+',' ','g')", 100, 100))} as description
 , regexp_matches(m.body,'{EXTERNAL}') as is_proxy from e_measures m join o_mstatus s on s.name=m.name"""
V["o_searched"] = """select *, case when lower(name)='m1' then 0 when lower(name) like 'm1%' then 1 else 2 end as match from (
 select 'measure' as kind, table_name, name, status from o_mstatus union all select 'column', table_name, name, status from o_cstatus) f where contains(lower(name),'m1')"""
V["o_headings"] = f"""select 'Measures' as doc, 'measures' as slug, 0 as n union all select 'DataDictionary', 'columns', 0 union all select 'Pages', 'pages', 0 union all select 'Index', 'glossary', 0
 union all select 'DataDictionary', {wiki('table_name')}, 1 from o_summary where origin='user' union all select 'Pages', {wiki('name')}, row_no from o_pageorder"""
V["o_targets"] = f"""select doc, slug||case when r=1 then '' else '-'||(r-1) end as fragment, 'heading' as kind from (select *, row_number() over (partition by doc, slug order by n) as r from o_headings) h
 union all select 'Measures', {wiki('name')}, 'anchor' from e_measures"""
V["o_doclinks"] = f"""select 'Measures' as doc, 'DataDictionary' as target, {wiki('table_name')} as fragment from e_measures
 union all select 'Index', case kind when 'Measure' then 'Measures' else 'DataDictionary' end, case kind when 'Column' then {wiki('parent')} else {wiki('name')} end
   from o_glossary where kind in ('Table','Calc group','Measure','Column')
 union all select 'Pages', case kind when 'measure' then 'Measures' else 'DataDictionary' end, case kind when 'measure' then {wiki('field_name')} else {wiki('table_name')} end
   from o_bound where page_id in (select page_id from x_pages) and (kind='measure' or not regexp_matches(table_name,'^(LocalDateTable_|DateTableTemplate_)'))"""

# ---- oracles ----------------------------------------------------------------------------------------------------

O: dict[str, str] = {}
V["o_best"] = """select r.workspace, r.folder||'/'||r.stem||'.Report' as report, r.k, r.folder, r.stem, case when r.k%6=1 then '' else regexp_extract(r.pointer,'([^/]*)$',1) end as pointer, p.model as pointed, n.model as named
 from y_reports r left join y_models p on p.workspace=r.workspace and lower(p.stem)||'.semanticmodel'=lower(regexp_extract(r.pointer,'([^/]*)$',1))
 left join y_models n on n.workspace=r.workspace and lower(n.stem)=lower(r.stem)"""
V["o_disk"] = """select workspace, report, coalesce(pointed, exact, starts, firstm) as model, case when pointed is not null then 'pbir' when exact is not null then 'exact' when starts is not null then 'prefix' when firstm is not null then 'first' else 'none' end as reason
 from (select b.workspace, b.report, case when b.k%6=0 then b.pointed end as pointed
   , (select m.model from y_models m where m.workspace=b.workspace and b.folder='/'||b.workspace and m.stem=b.stem) as exact
   , (select arg_min(m.model, length(m.stem)||'/'||m.stem) from y_models m where m.workspace=b.workspace and b.folder='/'||b.workspace and starts_with(m.stem, b.stem)) as starts
   , (select min(m.model) from y_models m where m.workspace=b.workspace and b.folder='/'||b.workspace) as firstm from o_best b) d"""
O["s02_roots"] = "select workspace, 'report' as kind, report as root from o_best union all select workspace, 'model', model from y_models"
O["s02_shallowest_reports"] = "select workspace, arg_min(report, lpad(cast(length(report) as varchar),9,'0')||report) as root from o_best group by workspace"
O["s03_pairs_by_name"] = """select workspace, report, coalesce(pointed, named) as model, case when pointed is not null then 'pbir' when named is not null then 'prefix' else 'mismatch' end as reason
 , case when pointer<>'' then pointer else stem||'.SemanticModel' end as expected from o_best"""
O["s03_reports_for_models"] = """select m.workspace, m.model, coalesce(p.report, n.report) as report from y_models m
 left join (select pointed, arg_min(report, (lower(stem)<>lower(regexp_extract(pointed,'/([^/]*)\\.SemanticModel$',1)))::int||report) as report from o_best where pointed is not null group by pointed) p on p.pointed=m.model
 left join (select named, min(report) as report from o_best where named is not null group by named) n on n.named=m.model"""
O["s03_default_pairs"] = """select w.workspace, b.report, coalesce(b.pointed, b.named, w.model) as model from (select workspace, min(model) as model from y_models group by workspace) w
 left join (select *, row_number() over (partition by workspace order by stem||'.Report', report) as rn from o_best) b on b.workspace=w.workspace and b.rn=1"""
O["s04_pairs_on_disk"] = "select * from o_disk"
O["s05_load_modes"] = """select workspace, report, model, case when model is null then 'report-only' else 'full' end as mode from o_disk
 union all select workspace, null, model, 'model-only' from y_models where model not in (select model from o_disk where model is not null)"""
V["o_listed"] = "select * from x_bindings where page_id in (select page_id from x_pages)"
_BOUND = "page_id, cast(seq as varchar) as visual_id, visual_type, visual_type as title, role, field_type, table_name, field_name"
O["s06_pages"] = "select p.page_id, p.name, p.hidden, p.width, p.height, coalesce(v.n,0) as visual_count from x_pages p left join (select page_id, count(*) as n from x_visuals group by page_id) v on v.page_id=p.page_id"
O["s06_visuals"] = "select page_id, visual_id, visual_type, title, x, y, z, width, height from x_visuals where page_id in (select page_id from x_pages)"
O["s07_well_bindings"] = f"select {_BOUND} from o_listed where role<>'Filter'"
O["s08_filter_bindings"] = f"select {_BOUND} from o_listed where role='Filter'"
O["s09_formatting_bindings"] = f"select {_BOUND} from o_listed"
O["s10_field_references"] = "select field_type, table_name, field_name, count(*) as bindings from o_listed group by field_type, table_name, field_name"
O["s11_json_columns"] = "select * from x_columns"
O["s11_json_measures"] = "select table_name, name, body, format_string, description, display_folder from e_measures"
O["s11_json_partitions"] = "select table_name, name, mode, kind, case when kind='entity' and expression_source='' then m_body else expression_source end as expression_source, m_body from x_partitions"
O["s11_json_relationships"] = "select from_table, from_column, to_table, to_column, is_active, from_card, to_card, cross_filter from x_rels"
O["s12_text_relationships"] = "select row_number() over (partition by from_table, to_table order by rel_no)-1 as rel_no, from_table, from_column, to_table, to_column, is_active, from_card, to_card, cross_filter from x_rels"
O["s13_text_tables"] = "select table_name, description from x_tables where table_name in (select table_name from x_columns union select table_name from e_measures)"
O["s13_text_columns"] = "select * from x_columns"
O["s13_text_measures"] = "select table_name, name, body, format_string, description, display_folder from e_measures"
O["s13_text_calc_items"] = "select group_name, precedence, name, replace(body,chr(9),'') as body, format_expr, description from x_calc_items"
O["s14_text_partitions"] = "select table_name, name, mode, kind, expression_source, replace(m_body,chr(10),chr(10)||chr(9)||chr(9)||chr(9)) as m_body from x_partitions"
O["s15_text_hierarchies"] = "select * from x_hierarchies"
O["s16_text_expressions"] = "select name, kind, replace(value,chr(10),chr(10)||chr(9)||chr(9)) as value, metadata, description from x_expressions"
O["s17_text_functions"] = "select name, array_to_string([trim(x) for x in string_split(parameters,chr(10))],' ') as parameters, body, description from x_functions"
O["s18_model_properties"] = "select name, description, culture, culture as cultures, compatibility_level, discourage_implicit, value_filter from x_models"
O["s19_formats"] = "select model, format from y_models"
O["x01_strip_comments"] = "select name, clean from o_clean"
O["x02_qualified_refs"] = "select label as name, ref_table, ref_column from o_qual"
O["x03_bare_refs"] = "select label as name, ref_name from o_bare"
O["x04_compat_dependencies"] = "select * from o_cedges"
O["x05_external_proxies"] = "select * from o_remote"
O["x06_source_type"] = "select table_name, part_no, source_type, source_location from o_typed"
O["x07_native_query"] = "select table_name, part_no, native_query from o_typed where native_query<>''"
O["x08_sql_source"] = "select * from o_sqlsrc"
O["x09_bigquery_source"] = "select * from o_bqsrc"
O["x10_file_source"] = "select * from o_filesrc"
O["x11_web_source"] = "select * from o_websrc"
O["x11_url_parts"] = f"select page_id, {_HOST} as host, case when {_PATH}='' then '/' else {_PATH} end as path from (select page_id, url as u from pages) p"
O["x12_physical_source"] = "select * from o_src"
O["x13_steps"] = "select table_name, part_no, cast(step_no as int) as step_no, name from o_steps"
O["x14_step_kinds"] = "select table_name, part_no, cast(step_no as int) as step_no, kind, primary_fn from o_steps"
O["x15_step_summaries"] = """select table_name, part_no, cast(step_no as int) as step_no, case kind when 'source' then regexp_extract(t,'"([^"]+)"',1)
 when 'navigation' then regexp_extract(t,'(?:Schema|Item|Name)="([^"]+)"',1)
 when 'filter' then case when contains(t,'each [') then 'where ['||regexp_extract(t,'each \\[([^\\]]+)\\]',1)||'] …' else '' end
 when 'projection' then array_to_string(regexp_extract_all(t,'"([^"]*)"',1)[1:4],', ')||' (+2 more)'
 when 'rename' then '1 column' when 'typeChange' then '2 columns' when 'addColumn' then '+['||regexp_extract(t,'\\([^,]+,\\s*"([^"]+)"',1)||']'
 when 'join' then 'Table ⋈ NestedJoin' when 'union' then 'Combine + Source + 3 more' when 'expand' then 'expand ['||regexp_extract(t,',\\s*"([^"]+)"\\s*,\\s*\\{',1)||']' else '' end as summary from o_steps"""
O["x16_capped_bodies"] = f"""select doc_id, case when length(t)<=10000 then t else left(t,10000)||chr(10)||chr(10)||'… (truncated — '||(length(t)-10000)||' more chars)' end as body from (
 select doc_id, trim(array_to_string([case when margin>0 and length(x)>=margin and trim(left(x,margin),{SPACES})='' then substring(x,margin+1) else x end for x in l],chr(10)),{SPACES}) as t from (
 select doc_id, l, coalesce(list_min([length(x)-length(ltrim(x,' '||chr(9))) for x in l if trim(x,{SPACES})<>'']),0) as margin from (
 select doc_id, string_split(chr(9)||chr(9)||replace(text,chr(10),chr(10)||chr(9)||chr(9))||chr(10),chr(10)) as l from documents) a) b) c"""
O["x17_non_blank_lines"] = f"select doc_id, cast(len([x for x in string_split(text,chr(10)) if trim(x,{SPACES})<>'']) as int) as lines from documents"
O["x18_normalized_bodies"] = "select doc_id, trim(regexp_replace(text,'\\s+',' ','g')) as body from documents"
O["x19_parameters"] = """select name, cast(len(l) as int) as parameter_count, cast(unnest(range(1,len(l)+1)) as int) as param_no, trim(split_part(unnest(l),':',1)) as param_name, trim(split_part(unnest(l),':',2)) as param_type
 from (select name, [x for x in string_split(parameters,',') if trim(x)<>''] as l from x_functions) f"""
O["x20_slugs"] = f"select doc_id, {github('text')} as github, {wiki('text')} as wiki from documents"
O["x21_letter_buckets"] = f"select doc_id, {letter(f'ltrim(text,{SPACES})')} as trimmed, {letter('text')} as untrimmed from documents"
O["x22_truncated"] = f"select doc_id, {cut('text', 77, 80)} as cut80, {cut('text', 97, 100)} as cut100, {cut('text', 110, 110)} as cut110 from documents"
_QUOTE = "case when contains({0},'\"') or contains({0},',') or contains({0},chr(10)) then '\"'||replace({0},'\"','\"\"')||'\"' else {0} end"
O["x23_csv_fields"] = f"select name, {_QUOTE.format('body')} as body, {_QUOTE.format('description')} as description from e_measures"
V["o_shown"] = "select page_id, trim(regexp_replace(name,'\\s+',' ','g')) as display_name from x_pages"
O["x24_page_names"] = "select *, count(*) over (partition by display_name)>1 as is_duplicate from o_shown"

O["p01_origin"] = "select table_name, case when table_name like 'LocalDateTable\\_%' escape '\\' or table_name like 'DateTableTemplate\\_%' escape '\\' then 'auto-date' else 'user' end as origin from o_names"
O["p02_calculated_tables"] = "select table_name from o_summary where is_calculated"
O["p03_composite_proxies"] = "select table_name, remote_expression from o_summary where parameter_kind='compositeModelProxy'"
O["p04_parameter_kind"] = "select table_name, coalesce(parameter_kind,'') as parameter_kind from o_summary"
O["p05_visual_category"] = f"select seq, visual_type, {_CAT} as category from x_bindings where {_CAT} is not null"
O["p06_table_groups"] = "select table_name, table_group from o_summary"
O["p07_column_keys"] = """select table_name, name, is_key, is_inferred_pk, is_fk, is_hidden, is_calculated, case when t='' then '—' else t end as constraints from (select *, concat_ws(' ', case when is_key then 'PK' when is_inferred_pk then 'PK*' end
 , case when is_fk then 'FK → '||fk_table||'['||fk_column||']' end, case when incoming_refs>0 then 'Ref ← '||incoming_refs end, case when is_calculated then 'CALC' end, case when is_hidden then 'HIDDEN' end) as t from o_keys) k"""
O["p08_slicer_fields"] = "select table_name, name, is_slicer_field from o_cstatus"
O["p09_search_filter"] = "select name, table_name from e_measures where contains(lower(name),'red') or contains(lower(table_name),'red') or contains(lower(body),'red') or contains(lower(description),'red')"
O["p10_status_filters"] = "select name, 'list' as filter from o_mstatus where status<>'direct' union all select name, 'export' from o_mstatus where status='unused'"
O["p11_hidden_names"] = "select 'function' as kind, '' as table_name, name from x_functions where not name like '%.About' union all select 'column', table_name, name from o_cols"
O["p12_long_enough_bodies"] = "select doc_id from documents where length(trim(regexp_replace(text,'\\s+',' ','g')))>=10"

O["j01_measure_bindings"] = "select b.seq, b.table_name, b.field_name, b.page_id, b.visual_id, b.role, b.field_type from x_bindings b join e_measures m on m.table_name=b.table_name and m.name=b.field_name where b.field_type='measure'"
O["j02_column_bindings"] = "select b.seq, b.table_name, b.field_name, b.page_id, b.visual_id, b.role, b.field_type from x_bindings b join x_columns c on c.table_name=b.table_name and c.name=b.field_name where b.field_type in ('column','aggregation')"
O["j03_dependencies"] = "select * from o_edges"
O["j04_reverse_dependencies"] = "select dst as name, count(*) as depended_on_by from o_edges group by dst"
O["j05_columns_in_used_measures"] = "select *, 'compat' as mode from o_livecols union all select *, 'strict' from o_livecols_strict"
O["j06_relationship_columns"] = "select * from o_relcols"
O["j07_key_targets"] = "select table_name, name, fk_table, fk_column, incoming_refs, inactive_refs from o_keys"
O["j07_incoming_refs"] = "select c.table_name, c.name, r.from_table, r.from_column, r.is_active from x_columns c join x_rels r on r.to_table=c.table_name and r.to_column=c.name"
O["j08_resolved_partitions"] = "select table_name, part_no, m_body from o_resolved"
O["j09_broken_references"] = "select * from o_broken"
O["j10_inactive_without_caller"] = "select * from o_inactive"
O["j10_inactive_strict"] = """select from_table, from_column, to_table, to_column from x_rels r where not is_active and not exists (select 1 from o_calls c where
 (lower(c.t[1]||'|'||c.c[1])=lower(from_table||'|'||from_column) and lower(c.t[2]||'|'||c.c[2])=lower(to_table||'|'||to_column))
 or (lower(c.t[2]||'|'||c.c[2])=lower(from_table||'|'||from_column) and lower(c.t[1]||'|'||c.c[1])=lower(to_table||'|'||to_column)))"""
O["j11_function_uses"] = "select * from o_fnuse"
O["j12_column_lineage"] = 'select c.table_name, c.name as "column", count(*) as measures from o_token t join x_columns c on c.name=t.ref_name group by c.table_name, c.name'
O["j12_column_lineage_strict"] = 'select c.table_name, c.name as "column", m.table_name as measure_table, m.name as measure from o_qual q join x_columns c on c.table_name=q.ref_table and c.name=q.ref_column join e_measures m on m.name=q.label'
O["j13_source_map"] = "select * from o_srcmap"
O["j14_visible_edges"] = "select from_table, from_column, to_table, to_column from x_rels where from_table in (select table_name from o_summary where origin='user' and role<>'Bridge') and to_table in (select table_name from o_summary where origin='user' and role<>'Bridge')"
O["j15_field_wells"] = f"""select v.page_id, v.visual_id, v.category, b.role, b.table_name, b.field_name from (select page_id, visual_id, {_CAT} as category from x_visuals) v
 left join (select * from x_bindings where role<>'Filter') b on b.page_id=v.page_id and b.visual_id=v.visual_id where v.category is not null"""

O["g01_usage_counts"] = "select * from o_usage"
O["g01_usage_counts_by_page_name"] = """select kind, table_name, field_name, count(*) as usage_count, count(distinct coalesce(p.name,b.page_id)) as page_count
 from o_bound b left join x_pages p on p.page_id=b.page_id group by kind, table_name, field_name"""
O["g02_totals"] = "select * from o_totals"
O["g03_table_counts"] = "select table_name, column_count, measure_count, key_count, fk_count, hidden_count, partition_count from o_summary"
O["g04_page_summary"] = "select page_id, visual_count, measure_count, column_count, slicer_count, coverage from o_pages"
O["g04_type_counts"] = "select page_id, visual_type, count(*) as visuals from o_vis group by page_id, visual_type"
O["g04_type_counts_by_title"] = "select page_id, visual_type, count(*) as visuals from (select page_id, title, arg_min(visual_type,seq) as visual_type from o_known group by page_id, title) t group by page_id, visual_type"
O["g05_source_index"] = "select * from o_index"
O["g06_status_by_table"] = "select table_name, count(*) as total, count(*) filter (status='direct') as direct, count(*) filter (status='indirect') as indirect, count(*) filter (status='unused') as unused from o_mstatus group by table_name"
O["g07_role_counts"] = "select role, count(*) as tables from o_summary group by role"
O["g07_star_schema"] = "select *, bridge=0 and disconnected=0 and fact>0 as is_star from (select count(*) filter (role='Fact') as fact, count(*) filter (role='Dimension') as dimension, count(*) filter (role='Bridge') as bridge, count(*) filter (role='Disconnected') as disconnected from o_summary where origin='user') s"
O["g08_mode_counts"] = "select lower(mode) as mode, count(*) as partitions, 'model' as report from x_partitions group by lower(mode) union all select mode, count(*), 'sources' from x_partitions where table_name in (select table_name from o_summary where origin='user') group by mode"
O["g09_relationship_counts"] = "select count(*) filter (is_active) as active, count(*) filter (not is_active) as inactive from x_rels"
O["g10_duplicate_bodies"] = "select * from o_dups"
O["g10_duplicate_documents"] = """select name, body_hash, count(*) over (partition by body_hash) as copies from (select cast(doc_id as varchar) as name, sha256(trim(regexp_replace(text,'\\s+',' ','g'))) as body_hash
 from documents where length(trim(regexp_replace(text,'\\s+',' ','g')))>=10) d qualify count(*) over (partition by body_hash)>1"""
O["g11_source_buckets"] = "select bucket, count(*) as tables from o_bucketed group by bucket"
O["g12_step_cohorts"] = "select signature, count(*) as members from (select table_name, part_no, string_agg(kind||':'||primary_fn,'|' order by step_no) as signature from o_steps group by table_name, part_no) s group by signature having count(*)>=3"
O["g13_source_type_counts"] = "select source_type, count(*) as columns from o_srcmap group by source_type"
O["g14_glossary_counts"] = "select case when grouping(letter)=1 then 'all' else letter end as letter, case when grouping(kind)=1 then 'all' else kind end as kind, count(*) as entries from o_glossary group by rollup(letter, kind)"
O["g15_coverage_ratios"] = f"""select 'tables without description' as what, round(avg(case when trim(description)='' then 1.0 else 0.0 end),6) as share from o_summary where origin='user'
 union all select 'measures without description', round(avg(case when trim(description)='' then 1.0 else 0.0 end),6) from e_measures
 union all select 'columns without description', round(avg(case when trim(description)='' then 1.0 else 0.0 end),6) from x_columns where {_USER}
 union all select 'measures direct', round(avg(case when status='direct' then 1.0 else 0.0 end),6) from o_mstatus
 union all select 'columns direct', round(avg(case when status='direct' then 1.0 else 0.0 end),6) from o_cstatus where {_USER}"""
O["g16_fk_columns_per_dimension"] = "select from_table, to_table, from_column, count(*) over (partition by from_table, to_table) as fk_columns from (select distinct from_table, to_table, from_column from x_rels) e"
O["g17_broken_by_expression"] = """select "where", count(*) as broken_refs, count(*) filter (reason='table not in model') as missing_tables, count(*) filter (reason='column not on table') as missing_columns
 , count(*) filter (reason='measure/column not found') as missing_names, string_agg(broken||' ('||reason||')', ', ' order by broken||' ('||reason||')') as refs from o_broken group by "where" """
O["g18_proxy_groups"] = "select external_model as remote_model, count(*) as n, 'measures' as what from o_ext group by external_model union all select replace(remote_expression,'DirectQuery to AS - ',''), count(*), 'tables' from o_summary where parameter_kind='compositeModelProxy' group by remote_expression"
O["g19_group_rollup"] = "select case when grouping(table_group)=1 then 'all' else table_group end as table_group, count(*) as tables, cast(sum(column_count) as bigint) as columns, cast(sum(measure_count) as bigint) as measures from o_summary where origin='user' group by rollup(table_group)"
O["g20_page_totals"] = "select count(*) as pages, count(*) filter (not hidden) as visible, count(*) filter (hidden) as hidden_pages, cast(sum(visual_count) as bigint) as visuals from o_pages"

O["w01_deduped_bindings"] = "select kind, table_name, field_name, page_id, visual_id, seq, role, field_type, visual_type, title from o_bound"
O["w02_first_partition"] = "select table_name, part_no, mode, kind from (select *, row_number() over (partition by table_name order by part_no) as rn from x_partitions) p where rn=1"
O["w03_column_order"] = "select table_name, row_number() over (partition by table_name order by not (is_key or is_inferred_pk), not is_fk, name) as column_no, name from o_keys"
O["w04_numbered_measures"] = "select name, table_name, row_number() over (order by name) as row_no from e_measures"
O["w05_capped_lists"] = "select remote_model, name, cast(item_no as int) as item_no, greatest(n-5,0) as more from (select external_model as remote_model, name, row_number() over (partition by external_model order by name) as item_no, count(*) over (partition by external_model) as n from o_ext) x where item_no<=5"
O["w06_visual_z_order"] = f"select page_id, visual_id, row_number() over (partition by page_id order by z, visual_id) as z_no from x_visuals where {_CAT} is not null"

O["l01_sorted_measures"] = "select row_number() over (order by usage_count desc, name) as row_no, name, usage_count from o_mstatus"
O["l02_source_index_order"] = "select row_number() over (order by visual_count desc, table_count desc, source_key) as row_no, source_key from o_index"
O["l03_biggest_tables"] = "select cast(row_number() over (order by column_count desc, table_name) as int) as row_no, table_name, role, column_count, measure_count from o_summary where origin='user' order by column_count desc, table_name limit 10"
O["l04_search"] = "select kind, table_name, name, status, match from o_searched order by match, kind<>'measure', name, table_name limit 12"
O["l04_search_overflow"] = "select count(*) as hits, greatest(count(*)-12,0) as more from o_searched"
V["o_pageorder"] = """select *, row_number() over (order by hidden, case when hidden then 0 else -(measure_count+column_count) end, case when hidden then 0 else -visual_count end, name, page_id) as row_no from o_pages"""
O["l05_page_order"] = "select row_no, page_id from o_pageorder"
O["l06_er_columns"] = """select table_name, cast(item_no as int) as item_no, name, data_type, badge, greatest(n-10,0) as more from (select *, row_number() over (partition by table_name order by not (is_key or is_inferred_pk), not is_fk, name) as item_no
 , count(*) over (partition by table_name) as n, case when is_key or is_inferred_pk then 'PK' when is_fk then 'FK' else '' end as badge from o_keys where table_name in (select table_name from o_er)) k where item_no<=10"""
O["l07_role_order"] = "select table_name, role, case role when 'Fact' then 1 when 'Bridge' then 2 when 'Dimension' then 3 when 'Disconnected' then 4 else 5 end as role_order from o_summary where origin='user'"

O["u01_glossary"] = "select * from o_glossary"
O["u02_table_names"] = "select * from o_names"
O["u03_all_pages"] = "select page_id, name, hidden, width, height, measure_count, column_count from o_pages"
O["u04_user_tables"] = f"select table_name from o_names where {_USER}"
O["u05_table_usage"] = "select table_name, count(distinct (page_id, visual_id)) as visuals, count(distinct page_id) as pages from o_known group by table_name"
O["u06_table_relationships"] = """select case i when 1 then from_table else to_table end as table_name, case i when 1 then 'outgoing' else 'incoming' end as direction, case i when 1 then from_column else to_column end as own_column
 , case i when 1 then to_table else from_table end as other_table, case i when 1 then to_column else from_column end as other_column
 , case from_card when 'many' then '*' else '1' end||':'||case to_card when 'many' then '*' else '1' end as cardinality, cross_filter='bothDirections' as both_directions, is_active from x_rels, (values (1),(2)) d(i)"""

O["r01_measure_status"] = "select * from o_mstatus"
O["r01_measure_status_compat"] = "select * from o_cmstatus"
O["r02_column_status"] = "select * from o_cstatus"
O["r02_column_status_strict"] = "select table_name, name, status from o_cstatus_strict"
O["r03_dead_chains"] = "select name from o_mstatus where status<>'unused' and name not in (select name from o_reach)"
O["r03_dead_chains_given_status"] = "select name from o_mstatus where name not in (select name from o_reach)"
O["r04_orphans"] = "select table_name, name, case when name in (select dst from o_edges) then 'chain' else 'pure' end as orphan from o_mstatus where status='unused'"
O["r05_cycle_members"] = "select * from o_cycles"
O["r05_cycle_paths"] = """select t.component, t.depth as step_no, t.node, l.ring_length from o_back t join o_ring l on l.component=t.component"""
O["r06_lineage"] = """select 'measure' as entity_kind, table_name||'['||measure||']' as entity, 'upstream' as direction, 'function' as related_kind, "function" as related from o_mfn
 union all select 'measure', table_name||'['||name||']', 'upstream', 'remote model', external_model from o_ext
 union all select 'measure', table_name||'['||name||']', 'upstream', 'table', table_name from e_measures
 union all select 'measure', a.table_name||'['||a.name||']', 'upstream', 'measure', b.table_name||'['||b.name||']' from o_edges e join e_measures a on a.name=e.src join e_measures b on b.name=e.dst
 union all select 'measure', b.table_name||'['||b.name||']', 'feeds', 'measure', a.table_name||'['||a.name||']' from o_edges e join e_measures a on a.name=e.src join e_measures b on b.name=e.dst
 union all select 'column', table_name||'['||name||']', 'upstream', 'table', table_name from x_columns
 union all select 'column', c.table_name||'['||c.name||']', 'feeds', 'measure', m.table_name||'['||m.name||']' from o_qual q join x_columns c on c.table_name=q.ref_table and c.name=q.ref_column join e_measures m on m.name=q.label
 union all select kind, table_name||'['||field_name||']', 'downstream', 'visual', page_id||'/'||visual_id from o_known"""
O["r07_table_roles"] = "select table_name, role, outgoing, incoming from o_summary"
O["r08_transitive_impact"] = """select source_key, count(*) as tables
 , (select count(distinct name) from o_hit0 h where h.source_key=k.source_key) as direct_measures, (select count(*) from o_hit h where h.source_key=k.source_key) as measures
 , (select count(*) from o_hitvis v where v.source_key=k.source_key) as visuals, (select count(distinct page_id) from o_hitvis v where v.source_key=k.source_key) as pages
 from o_srckeys k group by source_key"""
O["r08_source_impact"] = """select k.source_key, k.table_name, (select count(*) from e_measures m where m.table_name=k.table_name) as measures, (select count(*) from x_columns c where c.table_name=k.table_name) as columns
 , coalesce(b.v,0) as visuals, coalesce(b.p,0) as pages from o_srckeys k left join (select table_name, count(distinct (page_id,visual_id)) as v, count(distinct page_id) as p from o_known group by table_name) b on b.table_name=k.table_name"""


def finding(number: int, severity: str, entity: str, detail: str, source: str) -> str:
    return f"select '{severity}' as severity, 'A{number}' as check_id, {entity} as entity, coalesce({detail},'') as detail from {source}"


_LABEL = "table_name||'['||name||']'"


def undescribed(source: str, where: str, share: float) -> str:
    return f"(select * from (select *, trim(description)='' as miss, avg(case when trim(description)='' then 1.0 else 0.0 end) over () as sh from {source} where {where}) q where miss and sh>={share}) q"


FINDINGS = {
    "a01_auto_date": finding(1, "high", "table_name", "''", "o_summary where origin='auto-date'"),
    "a02_cycles": finding(2, "high", "node", "component", "o_cycles"),
    "a03_broken": finding(3, "high", '"where"', "broken||' ('||reason||')'", "o_broken"),
    "a04_calculated_direct_query": finding(4, "high", "table_name", "''", "o_summary where origin='user' and is_calculated and has_direct_query"),
    "a05_unused_measures": finding(5, "medium", _LABEL, "''", f"o_mstatus where status='unused' and {_USER}"),
    "a06_dead_chain": finding(6, "medium", "name", "''", "o_mstatus where status<>'unused' and name not in (select name from o_reach)"),
    "a07_unused_columns": finding(7, "medium", "s.table_name||'['||s.name||']'", "''", "o_cstatus s join x_columns c on c.table_name=s.table_name and c.name=s.name where s.status='unused' and not c.is_key and not regexp_matches(s.table_name,'^(LocalDateTable_|DateTableTemplate_)')"),
    "a08_dead_relationships": finding(8, "medium", "from_table||'['||from_column||'] → '||to_table||'['||to_column||']'", "''", "o_inactive"),
    "a09_tables_undescribed": finding(9, "medium", "table_name", "''", undescribed("o_summary", "origin='user'", 0.3)),
    "a10_measures_undescribed": finding(10, "medium", _LABEL, "''", undescribed("e_measures", _USER, 0.3)),
    "a11_long_bodies": finding(11, "medium", _LABEL, "cast(n as varchar)", "(select *, len([x for x in string_split(body,chr(10)) if trim(x)<>'']) as n from e_measures) m where n>=30"),
    "a12_duplicates": finding(12, "medium", _LABEL, "body_hash", "o_dups"),
    "a13_empty_pages": finding(13, "medium", "name", "''", "o_pages where measure_count=0 and column_count=0 and not hidden"),
    "a14_url_categories": finding(14, "medium", _LABEL, "'category='||data_category||', type='||data_type", f"x_columns where lower(data_category) in ('weburl','imageurl') and lower(data_type)<>'string' and {_USER}"),
    "a15_columns_undescribed": finding(15, "low", _LABEL, "''", undescribed("x_columns", _USER, 0.5)),
    "a16_model_undescribed": finding(16, "low", "'m0'", "''", "x_models where description=''"),
    "a17_numeric_unformatted": finding(17, "low", _LABEL, "data_type", f"x_columns where data_type in ('int64','decimal','double','currency') and format_string='' and not is_key and {_USER}"),
    "a18_external_proxies": finding(18, "info", _LABEL, "external_model||'['||remote_name||']'", f"o_ext where {_USER}"),
    "a19_field_parameters": finding(19, "info", "table_name", "''", "o_summary where origin='user' and parameter_kind='field'"),
    "a20_composite_proxies": finding(20, "info", "table_name", "remote_expression", "o_summary where origin='user' and parameter_kind='compositeModelProxy'"),
    "a21_measure_utilisation": finding(21, "good", "'m0'", "cast(cast(floor(100.0*d/n+0.5) as int) as varchar)", "(select count(*) filter (status='direct') as d, count(*) as n from o_mstatus) s where d>=0.85*n"),
    "a22_column_utilisation": finding(22, "good", "'m0'", "cast(cast(floor(100.0*d/n+0.5) as int) as varchar)", f"(select count(*) filter (status='direct') as d, count(*) as n from o_cstatus where {_USER}) s where d>=0.75*n"),
    "a23_no_cycles": finding(23, "good", "'m0'", "''", "(select count(*) as n from e_measures) s where n>5 and not exists (select 1 from o_cycles)"),
    "a24_calc_groups": finding(24, "good", "group_name", "''", "(select distinct group_name from x_calc_items) g"),
}
O.update(FINDINGS)
V["o_findings"] = "\n union all ".join(f"({text})" for text in FINDINGS.values())
def said(template: str) -> str:
    """A message's template as SQL over the columns n and e."""
    words = re.sub(r"\{([ne])\|([^|}]*)\|([^}]*)\}", r"'||case when \1=1 then '\2' else '\3' end||'", template.replace("'", "''"))
    return "'" + re.sub(r"\{([ne])\}", r"'||\1||'", words) + "'"


def texts(field: str) -> str:
    return "case check_id " + " ".join(f"when '{c}' then {said(getattr(m, field))}" for c, m in MESSAGES.items()) + f" end as {field}"


O["a25_finding_texts"] = f"""select severity, check_id, n as "rows", e as entities, {', '.join(texts(f) for f in ('title', 'summary', 'rationale', 'see'))}
 from (select severity, check_id, count(*) as n, count(distinct entity) as e from ({' union all '.join(FINDINGS.values())}) f group by severity, check_id) g"""
O["a25_severity_summary"] = """select severity, count(distinct check_id) as checks, count(*) as rows
 , not exists (select 1 from o_findings f where f.severity in ('high','medium','low')) as is_clean
 , case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 when 'info' then 3 else 4 end as severity_order from o_findings group by severity"""

O["d01_model_properties"] = "select name, cast(compatibility_level as varchar) as compatibility_level, culture as culture_list, case when discourage_implicit then 'Discouraged' else 'Allowed' end as implicit_measures, case when value_filter='' then 'Automatic (default)' else value_filter end as value_filter, t.* from x_models, o_totals t"
O["d01_relationship_inventory"] = """select row_number() over (order by rel_no) as row_no, from_table||'['||from_column||']' as from_end, to_table||'['||to_column||']' as to_end, from_card||' → '||to_card as cardinality
 , case cross_filter when 'bothDirections' then 'both ↔' else 'single →' end as filter, case when is_active then '✓' else '—' end as active from x_rels"""
O["d01_expression_inventory"] = f"""select name, case kind when 'parameter' then 'Parameter' else 'M expression' end as kind
 , case when contains(value,'AnalysisServices') then 'cluster '||regexp_extract(value,'\\("([^"]+)"',1)||' · database '||regexp_extract(value,',\\s*"([^"]+)"\\)',1) else {cut('value', 77, 80)} end as value, {dash('description')} as description from x_expressions"""
O["d01_function_summary"] = f"select name, case when parameters='' then 0 else len(string_split(parameters,',')) end as parameters, {dash(cut('description', 97, 100))} as description from x_functions where not name like '%.About'"
O["d01_calc_group_summary"] = "select group_name, count(*) as items, min(precedence) as precedence from x_calc_items group by group_name"
O["d01_page_table"] = """select row_number() over (order by p.name, p.page_id) as row_no, p.page_id, s.display_name, count(*) over (partition by s.display_name)>1 as is_duplicate, case when p.hidden then 'Hidden' else 'Visible' end as visibility
 , visual_count, measure_count, column_count, slicer_count from o_pages p join o_shown s on s.page_id=p.page_id"""
O["d02_measures_lite"] = "select * from o_lite"
O["d02_measures_detailed"] = f"""select s.name, 'status' as fact, case when x.name is not null then 'external proxy' else s.status end as value from o_mstatus s left join o_ext x on x.name=s.name
 union all select name, 'visuals', cast(usage_count as varchar) from o_mstatus union all select name, 'pages', cast(page_count as varchar) from o_mstatus
 union all select name, 'letter', {letter('trim(name)')} from e_measures union all select name, 'remote model', external_model from o_remote union all select name, 'remote measure', remote_name from o_remote
 union all select name, 'remote type', remote_type from o_remote union all select name, 'cluster', cluster from o_remote where cluster is not null
 union all select src, 'depends on', dst from o_edges union all select dst, 'used by', src from o_edges"""
O["d03_functions"] = """select f.name, f.name||'('||coalesce((select string_agg(case when contains(p,':') then trim(split_part(p,':',1))||' : '||trim(split_part(p,':',2)) else trim(p) end, ', ') from (select unnest(string_split(f.parameters,',')) as p) q),'')||')' as signature
 , case when parameters='' then 0 else len(string_split(parameters,',')) end as parameters, coalesce(u.n,0) as used_by
 from x_functions f left join (select "function", count(*) as n from o_fnuse group by "function") u on u."function"=f.name where not f.name like '%.About'"""
O["d04_calc_groups"] = "select group_name, precedence, row_number() over (partition by group_name order by ordinal, name) as item_no, ordinal, name, body, format_expr, description from x_calc_items"
V["o_dictionary"] = f"""select case s.role when 'Fact' then 1 when 'Bridge' then 2 when 'Dimension' then 3 when 'Disconnected' then 4 else 5 end as role_order, s.role, c.table_name
 , row_number() over (partition by c.table_name order by not (is_key or is_inferred_pk), not is_fk, c.name) as column_no, c.name, c.data_type, c.constraints, {dash("nullif(c.summarize_by,'none')")} as summarize_by
 , {dash('c.sort_by_column')} as sort_by, {dash("nullif(c.data_category,'Uncategorized')")} as category, {dash('c.format_string')} as format, {dash('c.description')} as description from o_constraints c join o_summary s on s.table_name=c.table_name where s.origin='user'"""
O["d05_data_dictionary"] = "select * from o_dictionary"
O["d05_hierarchies"] = f"select table_name, hierarchy, row_number() over (partition by table_name, hierarchy order by level_no, level) as order_no, level, column_name, {dash('description')} as description from x_hierarchies"
O["d06_source_report"] = f"""select bucket, table_name, {dash('mode')} as mode, {dash('kind')} as kind, column_count, measure_count
 , {dash("case when source_type in ('CSV','JSON','Inline data') and regexp_extract(source_location,'([^/'||chr(92)||chr(92)||']*)$',1)<>'' then regexp_extract(source_location,'([^/'||chr(92)||chr(92)||']*)$',1) when coalesce(expression_source,'')<>'' then 'expr: '||expression_source else '' end")} as detail from o_bucketed"""
O["d06_raw_bodies"] = "select table_name, part_no, trim(m_body) as body from o_resolved where m_body<>''"
O["d07_visual_bindings"] = "select page_id, visual_id, visual_type, title, kind, table_name, field_name from o_known"
O["d09_shown_findings"] = """select severity, check_id, entity, detail, cast(item_no as int) as item_no, greatest(n-cap,0) as more from (select *, row_number() over (partition by check_id order by entity, detail) as item_no, count(*) over (partition by check_id) as n
 , case when check_id='A2' then 5 when check_id in ('A3','A6','A15','A18') then 20 when check_id in ('A5','A7','A9','A10','A17') then 15 else 10 end as cap from o_findings) f where item_no<=cap"""
O["d10_documents_per_mode"] = """select doc, mode from (values ('Model',true),('DataDictionary',false),('Sources',true),('Measures',true),('Functions',true),('CalcGroups',true),('Pages',true),('Improvements',true),('Index',false)) d(doc,lite), (values ('lite'),('detailed')) m(mode)
 where (lite or mode='detailed') and (doc<>'Functions' or exists (select 1 from x_functions)) and (doc<>'CalcGroups' or exists (select 1 from x_calc_items))"""
O["d11_usage_tiles"] = """select measures_direct+columns_direct as direct, measures_indirect+columns_indirect as indirect, measures_unused+columns_unused as unused, pages, (select count(*) from x_pages where not hidden) as visible, (select count(*) from x_pages where hidden) as hidden_pages, visuals from o_totals"""
O["d13_er_edges"] = """select from_table, case from_card||to_card when 'oneone' then '||--||' when 'manyone' then '}o--||' when 'onemany' then '||--o{' else '}o--o{' end as glyph, to_table
 , from_column||case when cross_filter='bothDirections' then '_bidi' when not is_active then '_inactive' else '' end as label from x_rels where from_table in (select table_name from o_er) and to_table in (select table_name from o_er)"""
O["d14_link_targets"] = "select * from o_targets"
O["d14_links"] = "select doc, target, fragment, count(*) as links from o_doclinks group by all"
O["d14_broken_links"] = """select doc, target, fragment, 'no such anchor' as reason, count(*) as links from o_doclinks l
 where not exists (select 1 from o_targets t where t.doc=l.target and t.fragment=l.fragment) group by all"""

O["k01_csv_measures"] = """select m.name as "Measure", m.table_name as "Table", s.status as "Status", s.usage_count as "Usage Count", s.page_count as "Page Count", m.display_folder as "Display Folder", m.format_string as "Format String", m.description as "Description", m.body as "DAX"
 from e_measures m join o_mstatus s on s.name=m.name where s.status='unused' and (contains(lower(m.name),'re') or contains(lower(m.table_name),'re') or contains(lower(m.body),'re') or contains(lower(m.description),'re'))"""


def yn(flag: str) -> str:
    return f"case when {flag} then 'yes' else 'no' end"


O["k01_csv_columns"] = f"""select c.name as "Column", c.table_name as "Table", c.data_type as "Data Type", s.status as "Status", s.usage_count as "Usage Count", s.page_count as "Page Count", {yn('c.is_key')} as "Is Key", {yn('c.is_hidden')} as "Is Hidden", {yn('c.is_calculated')} as "Is Calculated"
 , c.format_string as "Format String", c.display_folder as "Display Folder", c.sort_by_column as "Sort By Column", c.description as "Description" from x_columns c join o_cstatus s on s.table_name=c.table_name and s.name=c.name"""
O["k01_csv_relationships"] = f"""select from_table as "From Table", from_column as "From Column", to_table as "To Table", to_column as "To Column", from_card as "From Cardinality", to_card as "To Cardinality", cross_filter as "Cross Filter", {yn('is_active')} as "Active" from x_rels"""
O["k01_csv_source_map"] = f"""select "column" as "Column", table_name as "Table", data_type as "Data Type", mode as "Mode", source_type as "Source Type", source_location as "Source Location", {yn('is_hidden')} as "Hidden", {yn('is_calculated')} as "Calculated" from o_srcmap"""
O["k02_read_back"] = "select table_name, name, body, description from e_measures"
O["k03_markdown_measures"] = f"select name, '| '||{cell('name')}||' | '||{cell('table_name')}||' | '||{cell('status')}||' | '||{cell('format')}||' | '||{cell('description')}||' |' as line from o_lite"
O["k03_document_files"] = f"""select doc, line, count(*) as times, cast(1 as bigint) as files from (
 select 'Measures' as doc, unnest(['## Measures', '', '| Name | Table | Status | Format | Description |', '|---|---|---|---|---|']) as line
 union all select 'Measures', '| <a id="'||{wiki('name')}||'"></a>'||{cell('name')}||' | ['||{cell('table_name')}||'](DataDictionary.md#'||{wiki('table_name')}||') | '||{cell('status')}||' | '||{cell('format')}||' | '||{cell('description')}||' |' from o_lite
 union all select 'Functions', unnest(['## Functions', '', '| Function | Signature | Parameters | Used by |', '|---|---|---|---|'])
 union all select 'Functions', '| '||{cell('name')}||' | '||{cell('signature')}||' | '||parameters||' | '||used_by||' |' from ({O["d03_functions"]}) f) d group by doc, line"""


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_sql(text, V) for name, text in O.items()}
