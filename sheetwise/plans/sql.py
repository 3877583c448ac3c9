"""Pieces of DuckDB SQL that say what the column functions say."""

SPACED = r"trim(regexp_replace({c},'[-_]',' ','g'))"
CODE = r"^([A-Za-z]+)\s*(\d+.*)$"


def normalize_text(c: str) -> str:
    return rf"coalesce(trim(regexp_replace(regexp_replace(lower({c}),'[^a-z0-9 ]','','g'),'\s+',' ','g')),'')"


def normalize_standard(c: str) -> str:
    s = SPACED.format(c=c)
    return rf"(case when regexp_matches({s},'{CODE}') then upper(regexp_extract({s},'{CODE}',1)) || ' ' || trim(regexp_extract({s},'{CODE}',2)) else upper(regexp_replace({s},'\s+',' ','g')) end)"


def split_list(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({c},''),'[;,]'), lambda x: trim(x)), lambda x: x <> ''))"


def tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split({normalize_text(c)},' '), lambda x: x <> ''))"


def jaccard(a: str, b: str) -> str:
    x, y = tokens(a), tokens(b)
    return f"(case when len({x})=0 or len({y})=0 then 0.0 else len(list_intersect({x},{y}))::double / len(list_distinct(list_concat({x},{y}))) end)"


def note_number(c: str) -> str:
    return rf"coalesce(try_cast(nullif(regexp_extract({c},'(?i)\bNOTE?S?\s+(\d+)\s*[:.]',1),'') as int), try_cast(nullif(regexp_extract({c},'^\s*(\d+)\.\s+',1),'') as int))"


def joined(c: str, sep: str = ",") -> str:
    return f"coalesce(array_to_string(list_sort({c}),'{sep}'),'')"


def status_class(c: str) -> str:
    low = f"lower(trim({c}))"
    return f"case when contains({low},'observa') then 'observation' when contains({low},'requer') or contains({low},'correc') or contains({low},'correç') or contains({low},'fixing') then 'correction' when contains({low},'aprovado') then 'approved' end"


NOTES = f"""notes as (select ord, {normalize_standard('standard')} as standard, trim(content) as content, trim(category) as category,
 {split_list('compressor_series')} as series, {split_list('applicability')} as applicability from fx_notes where {normalize_standard('standard')} <> '')"""

PARTS = f"""parts as (select min(ord) as ord, part, max_by(list_distinct(list_transform({split_list('mandatory')}, lambda x: {normalize_standard('x')})), ord) as mandatory from fx_parts where trim(part) <> '' group by part)"""

BEST = f"""names as (select distinct component as target from fx_drawings where component is not null),
best as (select target, part, score from (select target, part, ord, {jaccard('target', 'part')} as score, row_number() over (partition by target order by {jaccard('target', 'part')} desc, ord) as rn from names, parts) where rn = 1 and score >= 0.5)"""

MANDATORY = """mandatory as (select drawing_id, unnest(list_sort(mandatory)) as standard, 'mandatory for ' || best.part as reason, 'customer_applicability_matrix' as source, 0 as src,
 generate_subscripts(mandatory, 1) - 1 as ord from fx_drawings d join best on d.component = best.target join parts on parts.part = best.part)"""

COMPONENT = f"""pairs as (select target as component, ord from names, notes where len(list_filter(applicability, lambda x: lower(x) = 'all')) > 0
 union select target, ord from names, (select ord, unnest(applicability) as a from notes) n where lower(a) <> 'all' and {jaccard('target', 'a')} >= 0.5),
component as (select drawing_id, standard, 'component applies' as reason, 'component_match' as source, 1 as src, n.ord, coalesce(d.compressor_series,'') = '' and not every as open_series
 from fx_drawings d join pairs p on d.component = p.component join (select *, len(list_filter(series, lambda x: lower(x) = 'all')) > 0 as every from notes) n on n.ord = p.ord
 where every or coalesce(d.compressor_series,'') = '' or list_contains(series, d.compressor_series))"""

MATERIAL = f"""families as (select distinct material_family as f from fx_drawings where material_family <> ''),
hits as (select f, ord, standard from families, notes where lower(category) = 'material' and (contains({normalize_text('content')}, {normalize_text('f')}) or {jaccard('f', 'content')} >= 0.4)),
material as (select drawing_id, standard, 'material applies' as reason, 'material_match' as source, 2 as src, ord from fx_drawings join hits on material_family = f)"""

APPLICABLE = """applicable as (select drawing_id, standard, reason, source, src, ord from (select *, row_number() over (partition by drawing_id, standard order by src, ord) as rn from
 (select * from mandatory union all select drawing_id, standard, reason, source, src, ord from component where not open_series union all select * from material)) where rn = 1)"""

LINES = """lines as (select doc_id, trim(unnest(string_split(report, chr(10)))) as line, generate_subscripts(string_split(report, chr(10)), 1) as k from fx_reports),
tl as (select doc_id, line, row_number() over (partition by doc_id order by k) - 1 as row_no from lines where starts_with(line,'|') and ends_with(line,'|') and not regexp_full_match(line,'[-|: ]*')),
cl as (select doc_id, row_no, list_transform(string_split(line,'|')[2:-2], lambda x: trim(x)) as cells from tl)"""

MARKDOWN = LINES + """,
hd as (select doc_id, unnest(cells) as header, generate_subscripts(cells, 1) as pos from cl where row_no = 0),
hd2 as (select doc_id, header, max(pos) as last, row_number() over (partition by doc_id order by min(pos)) - 1 as header_no from hd group by doc_id, header),
md as (select b.doc_id, b.row_no, h.header_no, h.header, coalesce(b.cells[h.last], '') as value from cl b join hd2 h on h.doc_id = b.doc_id where b.row_no > 0)"""

ITEMS = MARKDOWN + """,
items as (select doc_id, row_no, min_by(value, header_no) filter (contains(lower(header),'item')) as item,
 min_by(value, header_no) filter (contains(lower(header),'localiza') or contains(lower(header),'quadrante')) as zone_text,
 min_by(value, header_no) filter (contains(lower(header),'status')) as status from md group by doc_id, row_no)"""

_T = r"(?:[A-Za-z]\d{1,2}|\d{1,2}[A-Za-z])"
_R = rf"(?i)\b({_T})\s*(?:-|a)\s*({_T})\b"
ZONES = ITEMS + rf""",
za as (select doc_id, row_no, list_transform(list_zip(regexp_extract_all(zone_text,'{_R}',1), regexp_extract_all(zone_text,'{_R}',2)), lambda x: {{'a': x[1], 'b': x[2]}}) as r,
 list_transform(regexp_extract_all(regexp_replace(zone_text,'{_R}',' ','g'),'\b({_T})\b',1), lambda x: {{'a': x, 'b': null}}) as s from items),
zg as (select doc_id, row_no, unnest(list_concat(r,s)) as g, generate_subscripts(list_concat(r,s),1) - 1 as group_no from za),
zones as (select doc_id, row_no, group_no, upper(regexp_extract(g.a,'([A-Za-z])',1)) as row_a, regexp_extract(g.a,'(\d+)',1) as col_a,
 upper(regexp_extract(g.b,'([A-Za-z])',1)) as row_b, case when g.b is not null then regexp_extract(g.b,'(\d+)',1) end as col_b from zg)"""

SEGMENTS = """seg as (select page_id, case when abs(y1-y0) <= 1 then 'h' else 'v' end as axis, case when abs(y1-y0) <= 1 then (y0+y1)/2 else (x0+x1)/2 end as "at",
 case when abs(y1-y0) <= 1 then least(x0,x1) else least(y0,y1) end as lo, case when abs(y1-y0) <= 1 then greatest(x0,x1) else greatest(y0,y1) end as hi,
 case when abs(y1-y0) <= 1 then page_h else page_w end as size from fx_strokes where abs(y1-y0) <= 1 or abs(x1-x0) <= 1),
segments as (select page_id, axis, "at", lo, hi from seg where "at" >= 30 and "at" <= size - 30 and hi > lo)"""


def merged(axis: str) -> str:
    return f"""{axis}1 as (select *, sum(nw) over (partition by page_id order by "at", lo, hi) as line from (select *, case when coalesce("at" - lag("at") over (partition by page_id order by "at", lo, hi), 1e9) > 1 then 1 else 0 end as nw from segments where axis = '{axis}')),
{axis}2 as (select *, sum(np) over (partition by page_id, line order by lo, hi) as piece from (select page_id, line, lo, hi, avg("at") over (partition by page_id, line) as "at",
 case when coalesce(lo > max(hi) over (partition by page_id, line order by lo, hi rows between unbounded preceding and 1 preceding) + 2, true) then 1 else 0 end as np from {axis}1)),
{axis} as (select page_id, min("at") as "at", min(lo) as lo, max(hi) as hi from {axis}2 group by page_id, line, piece)"""


CONNECTORS = SEGMENTS + ", " + merged("h") + ", " + merged("v") + """,
hn as (select *, row_number() over (partition by page_id order by "at", lo, hi) as id from h),
pr as (select t.page_id, t.id as top_id, b.id as bottom_id, t."at" as top, b."at" as bottom, greatest(t.lo,b.lo) as l, least(t.hi,b.hi) as r from hn t join hn b on t.page_id = b.page_id and b.id > t.id
 and b."at" - t."at" >= 5 and b."at" - t."at" <= 40 where least(t.hi,b.hi) - greatest(t.lo,b.lo) >= 15),
connectors as (select pr.page_id, top_id, bottom_id, top, bottom, list_sort(list(v."at")) as xs from pr join v on v.page_id = pr.page_id and v."at" >= l - 4.5 and v."at" <= r + 4.5 and v.lo <= top + 4.5 and v.hi >= bottom - 4.5
 group by pr.page_id, top_id, bottom_id, top, bottom having count(*) >= 3)"""

FRAMES = CONNECTORS + """,
spaced as (select page_id, top_id, bottom_id, top, bottom, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: case when x[1] - a[-1] >= 4 then list_append(a, x[1]) else a end) as xs from connectors),
frames as (select page_id, row_number() over (partition by page_id order by top_id, bottom_id) as ord, xs[1] as x0, top as y0, xs[-1] as x1, bottom as y1, len(xs) - 1 as n_cells, xs from spaced where len(xs) between 3 and 7),
ff as (select * from frames where y1-y0 between 5 and 40 and x1-x0 between 15 and 300 and n_cells between 2 and 6 and (xs[2]-xs[1]) / greatest(y1-y0, 1e-6) between 0.5 and 2.5)"""


def first_of_signature(source: str) -> str:
    return f"(select * exclude rn from (select *, row_number() over (partition by page_id, round_even(x0,1), round_even(y0,1), round_even(x1,1), round_even(y1,1), n_cells order by ord) as rn from {source}) where rn = 1)"


def _fold(source: str, order: str, drops: str) -> str:
    return f"""(select page_id, unnest(list_reduce(list_transform(list({{'ord': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'n_cells': n_cells}} order by {order}), lambda f: [f]),
 lambda a, f: case when len(list_filter(a, lambda k: {drops})) > 0 then a else list_append(a, f[1]) end)) as f from {source} group by page_id)"""


def nested(source: str) -> str:
    return _fold(source, "(x1-x0)*(y1-y0) desc, ord", "k.x0-0.5 <= f[1].x0 and k.y0-0.5 <= f[1].y0 and f[1].x1 <= k.x1+0.5 and f[1].y1 <= k.y1+0.5")


def nms(source: str) -> str:
    w, h = "(least(k.x1,f[1].x1)-greatest(k.x0,f[1].x0))", "(least(k.y1,f[1].y1)-greatest(k.y0,f[1].y0))"
    ka, fa = "(k.x1-k.x0)*(k.y1-k.y0)", "(f[1].x1-f[1].x0)*(f[1].y1-f[1].y0)"
    return _fold(source, "n_cells desc, (x1-x0)*(y1-y0) desc, ord", f"{w} > 0 and {h} > 0 and ({w}*{h}/({fa}+{ka}-{w}*{h}) >= 0.5 or {w}*{h}/least({fa},{ka}) >= 0.9)")


def renumbered(fold: str) -> str:
    return f"(select page_id, row_number() over (partition by page_id order by f.y0, f.x0, f.ord) as ord, f.x0 as x0, f.y0 as y0, f.x1 as x1, f.y1 as y1, f.n_cells as n_cells from {fold})"


GDT = FRAMES + f""",
sg as {first_of_signature('ff')}, nn as {renumbered(nested('sg'))}, kept as {renumbered(nms('nn'))},
cells as (select k.page_id, k.ord, generate_subscripts(f.xs[2:],1) - 1 as cell_no, unnest(f.xs[:-2]) as x0, k.y0, unnest(f.xs[2:]) as x1, k.y1 from kept k join sg f on f.page_id = k.page_id and f.x0 = k.x0 and f.x1 = k.x1 and f.y0 = k.y0 and f.y1 = k.y1 and f.n_cells = k.n_cells),
wc as (select c.page_id, c.ord, c.cell_no, list(trim(w.text) order by w.ord) filter (trim(w.text) <> '') as texts from cells c left join fx_words w on w.page_id = c.page_id and (w.x0+w.x1)/2 between c.x0 and c.x1 and (w.y0+w.y1)/2 between c.y0 and c.y1 group by c.page_id, c.ord, c.cell_no),
ft as (select page_id, ord, flatten(list(coalesce(texts, []::varchar[]) order by cell_no)) as texts, coalesce(flatten(list(coalesce(texts, []::varchar[]) order by cell_no) filter (cell_no > 0)), []) as behind from wc group by page_id, ord)"""

RANKED = """rk as (select *, row_number() over (partition by cell_id, representation order by score desc, template) as rn from fx_scores),
tops as (select cell_id, count(distinct template) = 1 as agreement from rk where rn = 1 group by cell_id),
ranking as (select a.cell_id, a.template as best, a.score as best_score, b.template as second, b.score as second_score, coalesce(a.score - b.score, a.score) as margin, agreement,
 a.score >= 0.55 and coalesce(a.score - b.score, a.score) >= 0.12 as accepted from rk a join tops on tops.cell_id = a.cell_id left join rk b on b.cell_id = a.cell_id and b.representation = 'gray' and b.rn = 2 where a.representation = 'gray' and a.rn = 1)"""

LABELS = r"""labels as (select page_id, case when (cy < page_h*0.13 or cy > page_h*0.87) and regexp_full_match(t,'\d{1,2}') then 'col' else 'row' end as axis,
 case when (cy < page_h*0.13 or cy > page_h*0.87) and regexp_full_match(t,'\d{1,2}') then t else upper(t) end as label,
 case when (cy < page_h*0.13 or cy > page_h*0.87) and regexp_full_match(t,'\d{1,2}') then cx else cy end as coord, page_w, page_h
 from (select *, trim(text) as t, (x0+x1)/2 as cx, (y0+y1)/2 as cy from fx_spans) s
 where ((cy < page_h*0.13 or cy > page_h*(1-0.13)) and regexp_full_match(t,'\d{1,2}')) or ((cx < page_w*0.13 or cx > page_w*(1-0.13)) and regexp_full_match(t,'\p{L}{1,2}')))"""

GRID = LABELS + """,
pts as (select page_id, axis, list(p order by p.coord, p.label) as pts from (select distinct page_id, axis, {'coord': round_even(coord,1), 'label': label} as p from labels) d group by page_id, axis),
ix as (select page_id, axis, pts, unnest(pts) as a, generate_subscripts(pts,1) as i from pts),
sd as (select x.page_id, x.axis, x.pts, x.i, y.i as j, x.a as a, y.a as b from ix x join ix y on x.page_id = y.page_id and x.axis = y.axis and y.i > x.i and y.a.coord - x.a.coord > 1),
ch as (select page_id, axis, i, j, list_reduce(list_concat([[a, b]], list_transform(pts, lambda p: [p])), lambda c, p: case when not list_contains(list_transform(c, lambda z: z.label), p[1].label)
 and abs(p[1].coord - (c[-1].coord + (c[2].coord - c[1].coord))) <= (c[2].coord - c[1].coord) * 0.06 then list_append(c, p[1]) else c end) as chain from sd),
bc as (select page_id, axis, chain, chain[2].coord - chain[1].coord as step from (select *, row_number() over (partition by page_id, axis order by len(chain) desc, i, j) as rn from ch) where rn = 1),
mk as (select page_id, axis, step, p.label as label, max_by(p.coord, k) as centre from (select page_id, axis, step, unnest(chain) as p, generate_subscripts(chain,1) as k from bc) group by page_id, axis, step, p.label),
grid as (select mk.*, page_w, page_h from mk join (select page_id from mk group by page_id having count(*) filter (axis='col') >= 3 and count(*) filter (axis='row') >= 3) g using (page_id)
 join (select page_id, max(page_w) as page_w, max(page_h) as page_h from labels group by page_id) z using (page_id))"""

MARKERS = r"""markers as (select * from (select page_id, case when regexp_full_match(t,'[A-H]') and (cx < page_w*0.08 or cx > page_w*(1-0.08)) then 'row' when regexp_full_match(t,'(?:[1-9]|1[0-5])') and (cy < page_h*0.08 or cy > page_h*(1-0.08)) then 'col'
 when regexp_full_match(t,'\(?\d+[.,]\d*(?:[±+-]\d+[.,]\d+)?\)?') then 'dimension' end as kind, t as text, cx, cy from (select *, upper(trim(text)) as t, (x0+x1)/2 as cx, (y0+y1)/2 as cy from fx_spans)) where kind is not null)"""

LIMITS = MARKERS + """,
centres as (select page_id, kind as axis, text as label, median(case when kind='row' then cy else cx end) as centre from markers where kind <> 'dimension' group by page_id, kind, text),
le as (select *, coalesce((centre + lead(centre) over (partition by page_id, axis order by centre, label))/2, 'infinity'::double) as "end" from centres),
limits as (select page_id, axis, label, coalesce(lag("end") over (partition by page_id, axis order by centre, label), '-infinity'::double) as start, "end" from le)"""

_AROUND = "(select * from (values (-1),(0),(1)) a(dx), (values (-1),(0),(1)) b(dy)) o"

# Changed tiles closed by one and dilated by one, their runs in rows, runs reached from each other, regions of more than 9 tiles.
REGIONS = f"""tile_a as (select * from fx_tiles where rev=1), tile_b as (select * from fx_tiles where rev=2),
changed as (select coalesce(a.pair_id,b.pair_id) as pair_id, coalesce(a.page,b.page) as page, coalesce(a.tx,b.tx) as tx, coalesce(a.ty,b.ty) as ty from tile_a a full join tile_b b on a.pair_id=b.pair_id and a.page=b.page and a.tx=b.tx and a.ty=b.ty where coalesce(abs(a.gray-b.gray) > 15, true)),
wide as (select distinct pair_id, page, tx+dx as tx, ty+dy as ty from changed, {_AROUND}),
closed as (select pair_id, page, tx+dx as tx, ty+dy as ty from wide, {_AROUND} group by all having count(*) = 9),
dilated as (select distinct pair_id, page, tx+dx as tx, ty+dy as ty from closed, {_AROUND}),
tile_runs as (select pair_id, page, ty, min(tx) as x0, max(tx) as x1, ty::bigint * 4294967296 + min(tx) as run from (select *, tx - row_number() over (partition by pair_id, page, ty order by tx) as place from dilated) group by pair_id, page, ty, place),
touching as (select a.pair_id, a.page, a.run as a, b.run as b from tile_runs a join tile_runs b on a.pair_id=b.pair_id and a.page=b.page and abs(a.ty-b.ty) = 1 and a.x0 <= b.x1+1 and b.x0 <= a.x1+1),
reached as (select pair_id, page, run as a, run as b from tile_runs union select r.pair_id, r.page, r.a, t.b from reached r join touching t on t.pair_id=r.pair_id and t.page=r.page and t.a=r.b),
run_region as (select pair_id, page, a as run, min(b) as region from reached group by pair_id, page, a),
regions as (select pair_id, page, region, sum(x1-x0+1)::bigint as size, min(x0) as x0, min(ty) as y0, max(x1) as x1, max(ty) as y1 from tile_runs join run_region using (pair_id, page, run) group by pair_id, page, region having sum(x1-x0+1) > 9),
tile_pages as (select pair_id, page from fx_tiles group by pair_id, page having count(distinct rev) = 2),
page_regions as (select p.pair_id, p.page, count(region) as regions from tile_pages p left join regions r on r.pair_id=p.pair_id and r.page=p.page group by p.pair_id, p.page),
changed_pages as (select pair_id, page, regions, changed from (select *, max(regions) over (partition by pair_id) > 0 as changed from page_regions) where regions > 0 or not changed)"""


def _field_rules(f: str) -> str:
    there = f"coalesce(json_type(r,'$.{f}'),'NULL') <> 'NULL'"
    return f"""case when r is not null and not {there} then '{f}: missing' end, case when {there} and not coalesce(try_cast(r->>'$.{f}.confidence' as double) between 0 and 1, false) then '{f}: confidence' end,
 case when length(r->>'$.{f}.evidence') > 150 then '{f}: evidence too long' end"""


RULES = f"""parsed as (select doc_id, case when json_valid(response) then response end as r from fx_responses),
answered as (select doc_id, r, concat_ws('; ', case when r is null then 'malformed' end, {", ".join(map(_field_rules, ("document_type", "component", "material_family", "compressor_series")))},
 case when r is not null and json_type(r,'$.cited_standards') is null then 'cited_standards: missing' end,
 case when len(list_distinct((r->>'$.cited_standards[*].standard')::varchar[])) < len((r->>'$.cited_standards[*].standard')::varchar[]) then 'cited_standards: repeated' end,
 case when len(list_filter((r->>'$.cited_standards[*].evidence')::varchar[], lambda x: length(x) > 150)) > 0 then 'cited_standards: evidence too long' end) as violations from parsed)"""
