"""Input tables of the queries, derived from the given tables by SQL that Spark and DuckDB both run.

The extractors that deliver these tables (readers of drawings, review answers, rasters) are outside
the engine; each statement stands for one of their outputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: Parts of the customers for each core.
DEALT = 4

SQL = {
    "parts": """
select cast(ord as bigint) as ord, p_name as part,
  concat('tss-', lpad(cast(length(p_name)*7 % 40 as string),6,'0'), '; TSS', lpad(cast(length(p_name)*11 % 40 as string),6,'0'),
         ';ISO ', cast(1000+length(p_name) as string)) as mandatory
from (select p_name, min(p_partkey) as ord from part group by p_name) d""",
    "notes": """
select p_partkey as ord,
  concat(case p_partkey%3 when 0 then 'TSS' when 1 then 'tss-' else 'NTB_' end, lpad(cast(p_partkey%400 as string),6,'0')) as standard,
  concat(p_name,' ',lower(p_type)) as content, case when p_size%5=0 then 'Material' else 'Process' end as category,
  case when p_size%4=0 then 'All' else concat(p_brand,', Brand#',cast(p_size%25 as string)) end as compressor_series,
  case when p_partkey<10 then 'all' else concat(p_name,'; ',p_type,' ',p_name) end as applicability
from part""",
    "drawings": """
select o_orderkey as drawing_id,
  case o_orderkey%4 when 0 then p_name when 1 then upper(p_name) when 2 then concat(p_name,' raw') else 'unknown thing' end as component,
  case when o_orderkey%3=0 then null else p_brand end as compressor_series,
  case o_orderkey%5 when 0 then p_name when 1 then 'steel_sheet' else null end as material_family
from (select o_orderkey, o_orderkey % n as k from orders, (select count(*) as n from part) c) o join part on p_partkey = k""",
    "cited": """
select l_orderkey as drawing_id, cast(l_linenumber as int) as ord,
  concat(case l_partkey%4 when 0 then 'TSS' when 1 then 'tss-' when 2 then 'TSS_' else 'ISO ' end, lpad(cast(l_partkey%40 as string),6,'0')) as standard,
  case l_suppkey%3 when 0 then concat('NOTE ',cast(l_linenumber as string),': ACCORDING TO SPEC')
    when 1 then concat(cast(l_linenumber as string),'. GEOMETRIC REQUIREMENTS') else 'ACCORDING TO SPEC' end as evidence
from lineitem""",
    "cost_log": """
select event_id as call_id, concat('2026-07-', lpad(cast(1+event_id%28 as string),2,'0'), 'T10:00:00') as timestamp, event_type as modelo,
  case when event_id%97=0 then 'n/a' else cast(2000+event_id%5000 as string) end as total_tokens,
  cast(1500+event_id%1000 as string) as prompt_tokens, cast(300+event_id%700 as string) as completion_tokens,
  case when event_id%83=0 then '' else cast(8000+event_id%9000 as string) end as latencia_ms,
  case when event_id%89=0 then 'x' else cast(event_id%7 as string) end as custo_usd
from events""",
    "files": """
select o_custkey as folder, concat(cast(o_orderkey as string), case o_orderkey%3 when 0 then '_REV_1_draw_1.pdf' when 1 then '_REV_2_Draw_2.pdf' else '.pdf' end) as name
from orders""",
    "battery": """
select concat('CAD', cast(o_custkey as string), case o_orderkey%6 when 0 then '_original.pdf' when 1 then '_review.pdf' when 2 then '_draw_1.pdf' when 3 then '_draw_2.pdf' when 4 then '_vs.pdf' else '_notes.txt' end) as name
from orders""",
    "reports": """
select o_custkey as pair_id, o_orderkey as doc_id, concat('Resumo', chr(10), chr(10),
 '| Item | Diferença Encontrada | Localização (Quadrante) | Status IA | Ação Recomendada |', chr(10), '|------|---|:---:|---|---|', chr(10),
 '| 1 | Cota ', cast(o_custkey as string), '; REV.: 3 | Central (D', cast(1+o_orderkey%8 as string), ' a E7) | Aprovado | Nenhuma |', chr(10),
 '| 2 | Nota | ', case when o_orderkey%2=0 then 'Vários (F4-F7, C9-E9) A1, 2B' else 'Vistas de Detalhe' end, ' | Aprovado com Observação | Verificar |', chr(10),
 case when o_orderkey%3=0 then concat('| 3 | Tabela | A1 | ', case when o_orderkey%2=0 then 'Fixing needed' else 'Requer Correção' end, ' |') else '' end, chr(10), 'Fim') as report
from orders""",
    "strokes": """
select c_custkey as page_id, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x1 as double) as x1, cast(y1 as double) as y1,
  cast(1200 as double) as page_w, cast(800 as double) as page_h from (
 select c_custkey, 50+10*(c_custkey%7) as x0, 60+60*r_regionkey as y0, 60+10*(c_custkey%7) as x1, 60+60*r_regionkey as y1 from customer, region
 union all select c_custkey, 61.5+10*(c_custkey%7), 60+60*r_regionkey, 50+10*(c_custkey%7)+20*(2+c_custkey%4), 60+60*r_regionkey+0.5 from customer, region
 union all select c_custkey, 50+10*(c_custkey%7)+20*(2+c_custkey%4), 80+60*r_regionkey, 50+10*(c_custkey%7), 80+60*r_regionkey from customer, region
 union all select c_custkey, 50+10*(c_custkey%7)+20*n_nationkey, 62+60*r_regionkey, 50+10*(c_custkey%7)+20*n_nationkey, 79+60*r_regionkey
   from customer, region, nation where n_nationkey <= 2+c_custkey%4
 union all select c_custkey, 50+10*(c_custkey%7), 70+60*r_regionkey, 50+10*(c_custkey%7)+20*(2+c_custkey%4), 70+60*r_regionkey from customer, region where c_custkey%3=0
 union all select c_custkey, 10, 5, 1100, 5 from customer union all select c_custkey, 400, 100, 480, 190 from customer) s""",
    "words": """
select c_custkey as page_id, cast(r_regionkey*100+n_nationkey as bigint) as ord, cast(52+10*(c_custkey%7)+20*n_nationkey as double) as x0, cast(64+60*r_regionkey as double) as y0,
  cast(66+10*(c_custkey%7)+20*n_nationkey as double) as x1, cast(74+60*r_regionkey as double) as y1,
  case n_nationkey%4 when 0 then '' when 1 then concat('0,0',cast(c_custkey%9 as string)) when 2 then 'A' else '5' end as text
from customer, region, nation where n_nationkey <= 3+c_custkey%4""",
    "spans": """
select c_custkey as page_id, text, cast(cx-4 as double) as x0, cast(cy-4 as double) as y0, cast(cx+4 as double) as x1, cast(cy+4 as double) as y1,
  cast(1200 as double) as page_w, cast(800 as double) as page_h from (
 select c_custkey, cast(1+n_nationkey as string) as text, 100+140*n_nationkey+(c_custkey+n_nationkey)%3 as cx, 12 as cy from customer, nation where n_nationkey<8
 union all select c_custkey, cast(1+n_nationkey as string), 100+140*n_nationkey, 788 from customer, nation where n_nationkey<8 and c_custkey%2=0
 union all select c_custkey, chr(cast(65+n_nationkey as int)), 14, 90+120*n_nationkey+(c_custkey+n_nationkey)%2 from customer, nation where n_nationkey<6
 union all select c_custkey, concat(cast(n_nationkey as string),',',cast(c_custkey%90 as string)), 120+40*n_nationkey, 150+(c_custkey*n_nationkey)%500 from customer, nation
 union all select c_custkey, 'NOTES', 600, 12 from customer) s""",
    "tiles": """
select c_custkey as pair_id, 1 as page, rev, cast(n_nationkey as int) as tx, cast(r_regionkey as int) as ty,
  cast(100+(n_nationkey*3+r_regionkey*5)%50 + case when rev=2 and (c_custkey+n_nationkey*r_regionkey)%11=0 then 16 when rev=2 and n_nationkey%5=0 then 15 else 0 end as int) as gray
from customer, nation, region, (select 1 as rev union all select 2 as rev) v""",
    "responses": """
select o_orderkey as doc_id, case when o_orderkey%50=0 then '{"component": ' else concat('{"document_type":{"value":"product_drawing","evidence":', case when o_orderkey%31=0 then concat('"', repeat('x', 160), '"') else '"DRAWING"' end, ',"confidence":0.95},',
 case when o_orderkey%37=0 then '' else concat('"component":{"value":"part ', cast(o_custkey%64 as string),'","evidence":"PART NAME","confidence":', case when o_orderkey%17=0 then '1.5' when o_orderkey%19=0 then 'null' else '0.5' end, '},') end,
 '"material_family":{"value":null,"evidence":null,"confidence":', case when o_orderkey%23=0 then '-0.1' else '0.0' end, '},"compressor_series":{"value":null,"evidence":null', case when o_orderkey%29=0 then '' else ',"confidence":0.0' end, '}',
 case when o_orderkey%41=0 then '' else concat(',"cited_standards":[{"standard":"TSS-', lpad(cast(o_custkey%40 as string),6,'0'),'","evidence":"NOTE 7: X"}',
  case when o_orderkey%43=0 then concat(',{"standard":"TSS-', lpad(cast(o_custkey%40 as string),6,'0'),'","evidence":"again"}') when o_orderkey%47=0 then concat(',{"standard":"ISO 1","evidence":"', repeat('y', 151), '"}') else '' end, ']') end, '}') end as response from orders""",
    "answers": """
select o_orderkey as doc_id, case o_orderkey%5 when 0 then 'classification' when 1 then 'standards' when 2 then 'classification_and_standards' when 3 then 'missing_standards' else 'difference' end as kind,
 case when o_orderkey%43=0 then '{"x' else case o_orderkey%5
  when 0 then concat('{"classificacao":"part ',cast(o_custkey as string),'"', case when o_orderkey%7=0 then '' else ',"justificativa":"title"' end, '}')
  when 1 then concat('{"lista_normas":["TSS 000001","', case when o_orderkey%7=0 then 'TSS 000001' else 'ISO 2' end, '"],"justificativas":["a"', case when o_orderkey%3=0 then '' else ',"b"' end, ']}')
  when 2 then concat('{"classificacao":"part","justificativa_classificacao":null,"lista_normas":["ISO 1"],"justificativas_normas":["a"', case when o_orderkey%3=0 then ',"b"' else '' end, ']}')
  when 3 then concat('{"normas_sugeridas":["ISO 1"],"reasoning":"r","confianca":', case when o_orderkey%7=0 then '1.5' when o_orderkey%3=0 then 'null' else '0.4' end, '}')
  else concat('{"parecer_geral":"ok","analise_faltantes":[{"norma":"ISO 1"', case when o_orderkey%7=0 then '' else ',"impacto":"low"' end, '}],"analise_extras":[],"conformidade_percentual":80.0}') end end as response
from orders""",
    "vectors": """
select vec_id as cell_id, rep as representation, embedding as vec from embeddings, (select 'gray' as rep union all select 'binary' as rep union all select 'edges' as rep) v""",
    "boxes": """
select page_id, ord, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x0+w as double) as x1, cast(y0+h as double) as y1, n_cells from (
 select c_custkey as page_id, n_nationkey as ord, 50+(c_custkey*7+n_nationkey*13)%90 as x0, 60+(c_custkey*3+n_nationkey*17)%60 as y0,
  20+(n_nationkey*c_custkey)%50 as w, 8+(n_nationkey*3+c_custkey)%20 as h, cast(2+(c_custkey+n_nationkey)%5 as int) as n_cells from customer, nation) b""",
    "scores": """
select cast(l_orderkey*8+l_linenumber as bigint) as cell_id, rep as representation, concat('tpl', cast(k as string)) as template,
  cast(((l_partkey*7 + l_suppkey*3 + k*31 + length(rep)*k*11) % 100) / 100.0 as double) as score
from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by l_orderkey, l_linenumber) l,
 (select 'gray' as rep union all select 'binary' as rep union all select 'edges' as rep) v, (select 0 as k union all select 1 as k union all select 2 as k) t""",
    "texts": """
select l_orderkey as drawing_id, cast(l_linenumber as int) as page, concat('TITLE', chr(10), 'NOTE ', cast(l_linenumber as string), ': SEE TSS-', lpad(cast(l_partkey%40 as string),6,'0'),
 ' AND ISO ', cast(1000+l_suppkey%20 as string), chr(10), 'FINISH PER DIN', cast(l_partkey%9 as string), ' OR TSS-', lpad(cast(l_partkey%40 as string),6,'0'), chr(10), 'NOT A CODE 12') as text from lineitem""",
    "expected": """
select o_orderkey as drawing_id, concat('tss-', lpad(cast((o_custkey+i)%40 as string),6,'0')) as standard, i as ord
from orders, (select 0 as i union all select 1 as i union all select 2 as i union all select 3 as i) k""",
    "matches": """
select c_custkey as page_id, cast(n_nationkey as bigint) as ord, concat('sym', cast(n_nationkey%3 as string)) as symbol, cast((n_nationkey*37+c_custkey)%1000/1000.0 as double) as score, cast(1 as double) as scale,
 cast(50+(c_custkey*11+n_nationkey*29)%200 as double) as x0, cast(60+(c_custkey*5+n_nationkey*23)%120 as double) as y0,
 cast(58+(c_custkey*11+n_nationkey*29)%200 as double) as x1, cast(68+(c_custkey*5+n_nationkey*23)%120 as double) as y1 from customer, nation""",
    "calls": """
select l_orderkey as drawing_id, cast(l_linenumber as int) as call_no, cast(1000+l_partkey%3000 as bigint) as prompt_tokens, cast(200+l_suppkey%500 as bigint) as completion_tokens,
 cast(5000+(l_partkey*13)%20000 as double) as latency_ms, case when l_orderkey%29=0 then 'timeout' end as error from lineitem""",
    "sheet": """
select o_orderkey as row_no, concat('D', cast(o_custkey as string)) as cad, 'old' as classification, cast(null as string) as standards, cast(null as string) as erro from orders""",
    "results": """
select concat('D', cast(c_custkey as string)) as cad, case when c_custkey%13=0 then null else concat('class ', cast(c_nationkey as string)) end as classification,
 case when c_custkey%13=0 then null else 'TSS 000001; ISO 9001' end as standards, case when c_custkey%13=0 then 'call failed' end as erro from customer where c_custkey%2=0""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` over the tables of ``sf_dir``.

    The statements make many rows of each customer, a page. Customers are dealt over tasks by their key first, since one task would
    read them all from their small file and make, sort and gather all rows of all pages; a page's rows stay together.
    """
    used = [t for t in GIVEN if re.search(rf"\b{t}\b", SQL[name])]
    dealt = f"/*+ repartition({DEALT * spark.sparkContext.defaultParallelism}, c_custkey) */ "
    tables = ", ".join(f"{t} as (select {dealt if t == 'customer' else ''}* from parquet.`{sf_dir}/{t}.parquet`)" for t in used)
    return spark.sql(f"with {tables} {SQL[name]}")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*names: str, recursive: bool = False) -> str:
    """WITH clause of the derived tables, for the SQL that a query is held against."""
    return "with " + "recursive " * recursive + ", ".join(f"fx_{n} as ({SQL[n]})" for n in names)
