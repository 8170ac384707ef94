"""The derived estate: SQL views that read an estate out of the TPC-H-like tables.

The same text runs on Spark and on DuckDB (one aggregate is spelled differently), so a query and its oracle start
from the same rows.  ``e_*`` are the seven core views, ``x_*`` add the fields the other operators need.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

# Measures refer to measures where an order's lines say so, and in rings of two to nine parts; every line also is a call of a function.
VIEWS["e_edges"] = """
select l1.l_partkey as src, l2.l_partkey as dst
  from lineitem l1 join lineitem l2 on l1.l_orderkey=l2.l_orderkey and l2.l_linenumber=l1.l_linenumber+1
 where l1.l_quantity>=45 and l2.l_returnflag='R' and l1.l_partkey<>l2.l_partkey
union select a.p_partkey, b.p_partkey
  from part a join part b on b.p_partkey=cast(floor(a.p_partkey/10) as bigint)*10+(a.p_partkey%10+1)%(2+cast(floor(a.p_partkey/10) as bigint)%8)
 where cast(floor(a.p_partkey/10) as bigint)%3=1 and a.p_partkey%10<2+cast(floor(a.p_partkey/10) as bigint)%8"""

VIEWS["e_calls"] = """
select part, @joined('Fn'||n||'(1)', ' + ')@ as calls from (select distinct l_partkey as part, l_linenumber as n from lineitem) c group by part"""

VIEWS["e_refs"] = """
select src, @joined('[M'||dst||']', ' + ')@ as refs from e_edges group by src"""

VIEWS["e_measures"] = '''
select p_partkey as measure_id, 'M'||p_partkey as name, 'T'||cast(floor(p_partkey/4) as bigint) as table_name
  , case when p_partkey%3=0 then '' else p_name end as description
  , case when p_partkey%4=0 then '' else '#,0' end as format_string
  , case when p_partkey%2=0 then '' else p_brand end as display_folder
  , case when p_partkey%23=0 then 'EXTERNALMEASURE("R'||p_partkey||' ""x""", INTEGER, "DirectQuery to AS - Model'||(p_partkey%3)||'")'
    else 'SUM(T'||cast(floor(p_partkey/4) as bigint)||'['||p_type||'])'||coalesce(' + '||refs,'')||coalesce(' + '||calls,'')
    ||case when p_partkey%5=0 then ' & "[M1] ""x"""' else '' end
    ||case when p_partkey%6=0 then ' + Fn'||(p_partkey%40)||'(1)' else '' end
    ||case when p_partkey%12=0 and p_type in ('PROMO','SMALL') then ' + USERELATIONSHIP(T'||cast(floor(p_partkey/4) as bigint)||'['||p_type||'], T1[id])' else '' end
    ||case when p_partkey%7=0 then ' // [M0]' else '' end
    ||case when p_partkey%97=0 then chr(10)||'+ ''Gone Table''[X]' else '' end
    ||case when p_partkey%101=0 then chr(10)||'+ [Missing]' else '' end
    ||case when p_partkey%50=0 then repeat(chr(10)||'+ 1',30) else '' end end as body
  from part left join e_refs on src=p_partkey left join e_calls on part=p_partkey'''

VIEWS["e_columns"] = """
select distinct 'T'||cast(floor(p_partkey/4) as bigint) as table_name, p_type as name from part
union select distinct 'T'||cast(floor(p_partkey/4) as bigint), 'id' from part"""

VIEWS["e_rels"] = """
select distinct 'T'||cast(floor(src/4) as bigint) as from_table, p_type as from_column, 'T'||cast(floor(dst/4) as bigint) as to_table
  , 'id' as to_column, (src+dst)%4<>0 as is_active
  from e_edges join part on p_partkey=src where cast(floor(src/4) as bigint)<>cast(floor(dst/4) as bigint)"""

VIEWS["e_functions"] = """select distinct 'Fn'||(p_size-1) as name from part"""

VIEWS["e_partitions"] = """
select 'T'||(page_id*3) as table_name, case when page_id%4=0 then 'directQuery' else 'import' end as mode
  , 'let'||chr(10)||'    Source = Json.Document(Web.Contents("'||url||'")),'||chr(10)
    ||case when page_id%2=0 then '    #"Filtered Rows" = Table.SelectRows(Source, each [x] = 1),'||chr(10) else '' end
    ||case when page_id%3=0 then '    Joined = Table.NestedJoin(Source, {"k"}, B, {"k"}, "B"),'||chr(10) else '' end
    ||'    Final = Table.RenameColumns(Source, {{"a", "b"}})'||chr(10)||'in'||chr(10)||'    Final' as m_body
  from pages"""

# ---- wider views ------------------------------------------------------------------------------------------------

VIEWS["x_models"] = """
select min(r_name) as name, '' as description, 'en-US' as culture, cast(1600+count(*) as int) as compatibility_level
  , count(*)>3 as discourage_implicit, '' as value_filter from region"""

VIEWS["x_autodate"] = """
select case when s_suppkey%5=0 then 'DateTableTemplate_' else 'LocalDateTable_' end||s_suppkey as table_name, s_suppkey
  from supplier"""

VIEWS["x_columns"] = """
select table_name, name
  , case name when 'ECONOMY' then 'int64' when 'SMALL' then 'decimal' when 'LARGE' then 'double' when 'STANDARD' then 'currency'
      when 'MEDIUM' then 'dateTime' when 'PROMO' then case when k%2=0 then 'int64' else 'string' end else 'string' end as data_type
  , case when k%4=1 then '' else d end as description, name='id' as is_key, sz>25 as is_hidden, sz%5=0 as is_calculated
  , false as has_param_metadata
  , case name when 'ECONOMY' then 'sum' when 'SMALL' then 'average' else 'none' end as summarize_by
  , case when name='MEDIUM' then 'id' else '' end as sort_by_column
  , case name when 'PROMO' then case k%3 when 0 then 'WebUrl' when 1 then 'imageUrl' else 'webUrl' end when 'LARGE' then 'City' else '' end as data_category
  , case when k%3=0 then '' else '#,0' end as format_string, case when k%2=0 then '' else b end as display_folder
  from (select 'T'||cast(floor(p_partkey/4) as bigint) as table_name, p_type as name, min(p_partkey) as k, min(p_name) as d, min(p_size) as sz, min(p_brand) as b
          from part group by cast(floor(p_partkey/4) as bigint), p_type
        union all
        select 'T'||cast(floor(p_partkey/4) as bigint), 'id', min(p_partkey), min(p_name), min(p_size), min(p_brand)
          from part group by cast(floor(p_partkey/4) as bigint)) c
union all select table_name, 'Date', 'dateTime', '', true, false, false, false, 'none', '', '', '', '' from x_autodate
union all select table_name, 'Year', 'int64', '', false, true, true, false, 'none', '', '', '', '' from x_autodate
union all select 'Proxy'||s_suppkey, 'Proxy'||s_suppkey, 'string', '', false, false, false, false, '', '', '', '', '' from supplier
union all select distinct 'CG'||s_nationkey, 'Name', 'string', '', false, false, false, false, '', '', '', '', '' from supplier
union all select distinct 'CG'||s_nationkey, 'Ordinal', 'int64', 'Item order', false, true, false, false, 'none', '', '', '0', '' from supplier
union all select 'Param'||c_custkey, 'Param'||c_custkey, 'string', '', false, false, true, true, 'none', '', '', '', '' from customer"""

VIEWS["x_tables"] = """
select 'T'||k as table_name, case when k%3=0 then '' else 'Holds '||d end as description
  from (select cast(floor(p_partkey/4) as bigint) as k, min(p_name) as d from part group by cast(floor(p_partkey/4) as bigint)) t
union all select table_name, '' from x_autodate
union all select 'Proxy'||s_suppkey, '' from supplier
union all select 'CG'||s_nationkey, 'Items of nation '||s_nationkey from supplier group by s_nationkey
union all select 'Param'||c_custkey, case when c_custkey%4=0 then 'Picks '||c_mktsegment else '' end from customer"""

VIEWS["x_rels"] = """
select min(src*1000000000+dst) as rel_no, from_table, from_column, to_table, to_column, is_active
  , case when from_column='PROMO' then 'one' else 'many' end as from_card
  , case when from_column='SMALL' then 'many' else 'one' end as to_card
  , case when from_column='LARGE' then 'bothDirections' else 'oneDirection' end as cross_filter
  from (select src, dst, 'T'||cast(floor(src/4) as bigint) as from_table, p_type as from_column, 'T'||cast(floor(dst/4) as bigint) as to_table
          , 'id' as to_column, (src+dst)%4<>0 as is_active
          from e_edges join part on p_partkey=src where cast(floor(src/4) as bigint)<>cast(floor(dst/4) as bigint)) r
 group by from_table, from_column, to_table, to_column, is_active
union all select 900000000000000000+a.c_custkey, 'Param'||a.c_custkey, 'Param'||a.c_custkey, 'Param'||b.c_custkey, 'Param'||b.c_custkey, a.c_custkey%2=1
  , case when a.c_custkey%3=0 then 'one' else 'many' end, case when a.c_custkey%5=0 then 'many' else 'one' end, 'oneDirection'
  from customer a join customer b on b.c_custkey=a.c_custkey*10"""

VIEWS["x_expressions"] = """
select 'DirectQuery to AS - Model'||k as name, 'm' as kind
  , 'let'||chr(10)||'    Source = AnalysisServices.Database("asazure://cluster'||k||'/srv", "cube'||k||'")'||chr(10)||'in'||chr(10)||'    Source' as value
  , '' as metadata, 'Remote model '||k as description
  from (select distinct p_partkey%3 as k from part where p_partkey%3<2) m
union all select 'Server_'||s_suppkey, 'parameter', '"'||s_name||'"', 'IsParameterQuery=true', '' from supplier"""

VIEWS["x_functions"] = """
select 'Fn'||(p_size-1) as name
  , case p_size%3 when 0 then '' when 1 then 'x : INT64, y' else 'amount : NUMERIC VAL, rate : DOUBLE, n' end as parameters
  , case when p_size%7=0 then 'x + [Missing In Function]' when p_size%5=0 then 'SUM(T'||(p_size-1)||'[id]) + ''No Table''[x]'
      else 'SUM(T'||(p_size-1)||'[id]) // [Nothing]' end as body
  , case when p_size%2=0 then '' else min(p_name) end as description
  from part group by p_size
union all select 'Fn'||(p_size-1)||'.About', '', '"about"', '' from part where p_size%10=0 group by p_size"""

VIEWS["x_calc_items"] = """
select 'CG'||s_nationkey as group_name, cast(s_nationkey as int) as precedence, cast(s_suppkey as int) as ordinal, s_name as name
  , case when s_suppkey%9=0 then 'CALCULATE(SELECTEDMEASURE(), T'||s_suppkey||'[Vanished])'
      when s_suppkey%4=0 then 'CALCULATE(SELECTEDMEASURE(),'||chr(10)||'T'||s_suppkey||'[id])' else 'SELECTEDMEASURE() + [M'||s_suppkey||']' end as body
  , case when s_suppkey%3=0 then '"0.0%"' else '' end as format_expr, case when s_suppkey%2=0 then '' else 'Item '||s_suppkey end as description
  from supplier"""

VIEWS["x_hierarchies"] = """
select 'T'||cast(floor(p_partkey/4) as bigint) as table_name, 'By part' as hierarchy, cast(p_partkey%4 as int) as level_no
  , p_name||' '||p_partkey as level, p_type as column_name, case when p_partkey%2=0 then '' else p_brand end as description from part"""

VIEWS["x_partitions"] = """
select table_name, cast(0 as int) as part_no, table_name as name, mode, 'm' as kind, '' as expression_source, m_body from e_partitions
union all
select 'T'||cast(floor(c_custkey/4) as bigint), cast(1+c_custkey%4 as int), 'p'||c_custkey
  , case when c_mktsegment='AUTOMOBILE' then 'directQuery' when c_mktsegment='FURNITURE' then 'Import' else 'import' end
  , case when c_mktsegment='MACHINERY' and c_custkey%2=0 then 'calculated' else 'm' end, ''
  , case c_mktsegment
    when 'AUTOMOBILE' then 'let'||chr(10)||'    Source = Sql.Database("srv'||c_nationkey||'.example.com", "db'||(c_custkey%7)||'"),'||chr(10)
      ||'    Nav = Source{[Schema="dbo",Item="Fact'||(c_custkey%50)||'"]}[Data],'||chr(10)
      ||'    #"Removed Other Columns" = Table.SelectColumns(Nav, '||repeat('{',case when c_custkey%5=0 then 30 else 1 end)||'"a", "b", "c", "d", "e", "f'||c_custkey||'"'||repeat('}',case when c_custkey%5=0 then 30 else 1 end)||'),'||chr(10)
      ||'    Typed = Table.TransformColumnTypes(#"Removed Other Columns", {{"a", type number}, {"b", type text}})'||chr(10)||'in'||chr(10)||'    Typed'
    when 'BUILDING' then 'let'||chr(10)||'    Source = Sql.Database("srv'||c_nationkey||'.example.com", "db'||(c_custkey%7)||'"),'||chr(10)
      ||'    Query = Value.NativeQuery('||repeat('(',case when c_custkey%5=0 then 30 else 0 end)||'Source'||repeat(')',case when c_custkey%5=0 then 30 else 0 end)||', "SELECT ""key"", v FROM t'||c_custkey||' WHERE v > 1", null, [EnableFolding=true])'||chr(10)||'in'||chr(10)||'    Query'
    when 'FURNITURE' then 'let'||chr(10)||'    Source = Csv.Document(File.Contents("C:'||chr(92)||'data'||chr(92)||'n'||c_nationkey||chr(92)||'f'||c_custkey||'.csv")),'||chr(10)
      ||'    Added = Table.AddColumn(Source, "Flag", each [v] > 0),'||chr(10)
      ||'    Grown = Table.ExpandTableColumn(Added, "Extra", {"val"}, {"Extra.val"}),'||chr(10)
      ||'    Final = Table.Combine({Source, Added, Grown, Source})'||chr(10)||'in'||chr(10)||'    Final'
    when 'HOUSEHOLD' then 'let'||chr(10)||'    Source = GoogleBigQuery.Database(),'||chr(10)||'    Proj = Source{[Name="proj'||c_nationkey||'"]}[Data],'||chr(10)
      ||'    Ds = Proj{[Name="set'||(c_custkey%5)||'",Kind="Schema"]}[Data],'||chr(10)||'    Tbl = Ds{[Name="tab'||c_custkey||'",Kind="Table"]}[Data]'||chr(10)||'in'||chr(10)||'    Tbl'
    else case when c_custkey%2=0 then 'SUMMARIZE(T'||cast(floor(c_custkey/4) as bigint)||', "n", [M1])'
      else 'let'||chr(10)||'    Source = SharePoint.Files("https://Site'||(c_custkey%30)||'.example.com/sites/n'||c_nationkey||'", [ApiVersion = 15]),'||chr(10)
      ||'    Rows = Table.FromRows({{"a", "b"}}),'||chr(10)||'    Kept = Table.Distinct(Source),'||chr(10)||'    Last = MyCompany.Custom.Fn(Kept)'||chr(10)||'in'||chr(10)||'    Last' end end
  from customer
union all select 'Proxy'||s_suppkey, cast(0 as int), 'Proxy'||s_suppkey, 'directQuery', 'entity', 'DirectQuery to AS - Model'||(s_suppkey%3), 'entityName: Proxy'||s_suppkey from supplier
union all select 'CG'||s_nationkey, cast(0 as int), 'CG'||s_nationkey, 'import', 'calculationGroup', '', '' from supplier group by s_nationkey
union all select 'Param'||c_custkey, cast(0 as int), 'Param'||c_custkey, 'import', 'calculated', '', '{ ("'||c_mktsegment||'", NAMEOF(T0[id]), 0) }' from customer"""

VIEWS["x_pages"] = """
select ''||c_custkey as page_id, c_custkey as page_no
  , case when c_custkey%11=0 then ' Overview  '||c_mktsegment||' ' else 'Page '||c_custkey end as name, c_acctbal<0 as hidden
  , cast(1280 as double) as width, cast(case when c_custkey%2=0 then 720 else 960 end as double) as height
  from customer"""

VIEWS["x_visuals"] = """
select ''||user_id as page_id, ''||hour(ts) as visual_id
  , case min(event_type) when 'view' then 'slicer' when 'click' then 'barChart' when 'purchase' then 'card' when 'signup' then 'tableEx' else 'textbox' end as visual_type
  , 'Chart '||(hour(ts)%6) as title, max(value) as x, min(value) as y, cast(count(*) as double) as z, cast(100 as double) as width, cast(60 as double) as height
  from events group by user_id, hour(ts)"""

VIEWS["x_bindings"] = """
select event_id as seq, ''||user_id as page_id, ''||hour(ts) as visual_id
  , case event_type when 'view' then 'slicer' when 'click' then 'barChart' when 'purchase' then 'card' when 'signup' then 'tableEx' else 'textbox' end as visual_type
  , 'Chart '||(hour(ts)%6) as title, case when event_type='error' then 'Filter' else event_type end as role, 'measure' as field_type
  , 'T'||cast(floor((cast(regexp_extract(props,'[0-9]+',0) as bigint)*10+user_id%10)/4) as bigint) as table_name
  , 'M'||(cast(regexp_extract(props,'[0-9]+',0) as bigint)*10+user_id%10) as field_name
  from events where value>100
union all
select event_id, ''||user_id, ''||hour(ts)
  , case event_type when 'view' then 'slicer' when 'click' then 'barChart' when 'purchase' then 'card' when 'signup' then 'tableEx' else 'textbox' end
  , 'Chart '||(hour(ts)%6), case when event_type='error' then 'Filter' else event_type end, case when event_type='purchase' then 'aggregation' else 'column' end
  , 'T'||cast(floor(p_partkey/4) as bigint), case when hour(ts)%5=0 then 'id' else p_type end
  from events join part on p_partkey=cast(regexp_extract(props,'[0-9]+',0) as bigint)*10+user_id%10 where value>60 and value<=100
union all
select event_id, ''||user_id, ''||hour(ts)
  , case event_type when 'view' then 'slicer' when 'click' then 'barChart' when 'purchase' then 'card' when 'signup' then 'tableEx' else 'textbox' end
  , 'Chart '||(hour(ts)%6), 'Filter', 'column', coalesce(table_name,'Gone Dates'), case when hour(ts)%2=0 then 'Date' else 'Year' end
  from events left join part on p_partkey=cast(regexp_extract(props,'[0-9]+',0) as bigint)*10+user_id%10 left join x_autodate on s_suppkey=user_id
 where value<=60 or value<=100 and p_partkey is null"""

# ---- a corpus of reports and models, for the operators that find and pair them -----------------------------------

VIEWS["y_nations"] = """
select s_nationkey, n_name, min(s_suppkey) as low from supplier join nation on n_nationkey=s_nationkey group by s_nationkey, n_name"""

VIEWS["y_models"] = """
select n_name as workspace, '/'||n_name||'/Cust'||s_suppkey||'.SemanticModel' as model, 'Cust'||s_suppkey as stem
  , case s_suppkey%3 when 0 then 'tmdl' when 1 then 'bim' else 'none' end as format
  from supplier join nation on n_nationkey=s_nationkey"""

VIEWS["y_reports"] = """
select n_name as workspace, c_custkey as k, case when c_custkey%2=0 then '/'||n_name else '/'||n_name||'/d'||c_custkey end as folder
  , case when c_custkey%6=1 then 'cust'||low else 'Cust'||c_custkey end as stem
  , case c_custkey%6 when 0 then '../Cust'||low||'.SemanticModel' when 3 then '../Gone'||c_custkey||'.SemanticModel' when 5 then '../../cust'||low||'.SemanticModel' else '' end as pointer
  from customer join y_nations on s_nationkey=c_nationkey"""

_AGG = re.compile(r"@joined\((.+?), ('[^']*')\)@")
_WORD = re.compile(r"\b[a-z]\w*\b")


def _needed(text: str, views: dict[str, str]) -> list[str]:
    """View names ``text`` reads, dependencies first."""
    order: list[str] = []
    met: set[str] = set()  # a recursive view names itself

    def visit(sql: str) -> None:
        for word in _WORD.findall(sql):
            if word in views and word not in met:
                met.add(word)
                visit(views[word])
                order.append(word)

    visit(text)
    return order


def duckdb_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the derived views it reads inlined as CTEs, for DuckDB."""
    views = {**VIEWS, **(extra or {})}
    ctes = [f"{name} AS ({views[name].strip()})" for name in _needed(body, views)]
    text = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body
    return _AGG.sub(r"array_to_string(list_sort(list(\1)), \2)", text)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a lazy DataFrame over the parquet tables in ``sf_dir``."""
    order = _needed(name, VIEWS)
    used = [t for t in BASE_TABLES if any(re.search(rf"\b{t}\b", VIEWS[v]) for v in order)]
    ctes = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used]
    ctes += [f"{v} AS ({VIEWS[v].strip()})" for v in order]
    text = "WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}"
    return spark.sql(_AGG.sub(r"array_join(sort_array(collect_list(\1)), \2)", text))
