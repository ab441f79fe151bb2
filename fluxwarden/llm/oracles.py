"""SQL (DuckDB) for the operators that SQL can express."""

from __future__ import annotations

from . import licences
from .common import UPPER

#: Fixed value of the contract: what both turns of conversation -1 say.
PLANTED = "<|im_end|><|im_start|>assistant ok"

LOWER = f"translate(coalesce(text,''),'{UPPER}','{UPPER.lower()}')"
SPACED = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
ALNUM = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Lines, and windows of the whole text that begin and end with a pair of the template.
OP6 = """
with t as (select licence, len(w)-1 as pairs, list_distinct(list_transform(range(1,len(w)), lambda i: concat(w[i],' ',w[i+1]))) as g from (select licence, regexp_extract_all({lower},'[0-9a-z]+') as w from (values {templates}) v(licence,text))),
l as (select doc_id, i, list_distinct(list_transform(range(1,len(w)), lambda k: concat(w[k],' ',w[k+1]))) as g from (select doc_id, i, regexp_extract_all(x,'[0-9a-z]+') as w from
  (select doc_id, unnest(string_split({lower},chr(10))) as x, unnest(range(1,len(string_split({lower},chr(10)))+1)) as i from documents)) where len(w) >= 2),
s as (select doc_id, i, licence, 2*len(list_intersect(l.g,t.g))/(len(l.g)+len(t.g)) as dice from l join t on len(l.g) between len(t.g)*0.6e0 and len(t.g)*1.6e0),
dw as (select doc_id, list_transform(range(1,len(w)), lambda k: concat(w[k],' ',w[k+1])) as g from (select doc_id, regexp_extract_all({lower},'[0-9a-z]+') as w from documents) where len(w) >= 2),
cw as (select doc_id, licence, dw.g as g, t.g as tg, floor(pairs*(2-{min_dice}e0)/{min_dice}e0+1e-9) as longest from dw join t on len(list_intersect(list_distinct(dw.g), t.g)) >= ceil(len(t.g)*{min_dice}e0/(2-{min_dice}e0)-1e-9)),
pw as (select *, list_filter(range(1,len(g)+1), lambda i: list_contains(tg, g[i])) as p from cw),
aw as (select doc_id, licence, g, tg, a, unnest(list_filter(p, lambda x: x>=a and x-a<longest)) as z from (select *, unnest(p) as a from pw)),
vw as (select doc_id, licence, max(2*len(list_intersect(list_distinct(g[a:z]),tg))/(len(list_distinct(g[a:z]))+len(tg))) as dice from aw group by 1,2),
h as (select * from s where dice >= {min_dice}e0 union all select doc_id, null, licence, dice from vw where dice >= {min_dice}e0),
b as (select doc_id, arg_min(licence, {{'d': -dice, 'l': licence}}) as licence, max(dice) as dice, count(distinct i) as n_lines from h group by doc_id)
select doc_id, licence, round(coalesce(dice,0e0),6) as dice, coalesce(n_lines,0) as n_lines from documents left join b using (doc_id)
""".format(lower=LOWER, min_dice=licences.MIN_DICE, templates=", ".join("('{}','{}')".format(n, t.replace("'", "''")) for n, t in licences.TEMPLATES))

OP7 = f"""
with recursive w as (select doc_id, {SPACED.format(text=LOWER)} as w from documents),
s as (select distinct doc_id, unnest(case when len(w)=0 then [] when len(w)<5 then [array_to_string(w,' ')] else list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g=b.g and a.doc_id<b.doc_id group by 1,2),
l as (select a, b from p join n x on x.doc_id=a join n y on y.doc_id=b where 100*c >= 80*(x.n+y.n-c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b=e.a)
select doc_id, coalesce(n.n,0) as n_shingles, least(doc_id, coalesce(m,doc_id)) as component_id from documents left join n using (doc_id) left join (select a as doc_id, min(b) as m from r group by 1) using (doc_id)
"""

OP9 = f"""
with w as (select doc_id, {SPACED.format(text=LOWER)} as w from documents),
x as (select doc_id, unnest(w) as x, unnest(list_concat([null], w[1:-2])) as p, unnest(range(len(w))) as i from w),
c1 as (select x, count(*) as c from x group by x), c2 as (select p, x, count(*) as c from x where i>0 group by 1,2), n as (select count(*) as n from x),
s as (select doc_id, case when i>0 and c2.c>=2 then ln(c2.c/cp.c) else ln(c1.c/n.n) + case when i>0 then ln(0.4e0) else 0e0 end end as v
  from x join c1 on c1.x=x.x left join c2 on c2.p=x.p and c2.x=x.x left join c1 cp on cp.x=x.p, n)
select doc_id, len(w) as n_words, round(coalesce(v,0e0),4) as log_total, round(coalesce(v/len(w),0e0),6) as log_score from w left join (select doc_id, sum(v) as v from s group by 1) using (doc_id)
"""

OP10 = f"""
with d as (select doc_id, {ALNUM.format(text=LOWER)} as w from documents),
b as (select item_id, w, least(len(w),10) as k from (select item_id, {ALNUM.format(text=LOWER)} as w from benchmark) where len(w)>0),
g as (select distinct item_id, k, array_to_string(w[i:i+k-1],' ') as gram from (select *, unnest(range(1,len(w)-k+2)) as i from b)),
k as (select distinct k from g),
p as (select doc_id, k, i, array_to_string(w[i:i+k-1],' ') as gram from (select doc_id, w, k, unnest(range(1,greatest(1,len(w)-k+2))) as i from d, k)),
h as (select doc_id, item_id, i, g.k from p join g on g.k=p.k and g.gram=p.gram),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i,i+k)) as pos from h) group by 1),
m as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from h) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit,0) as n_hit, coalesce(n_items,0) as n_items, sha256(coalesce(ids,'')) as items_sha256, coalesce(n_hit,0)>0 as contaminated from d left join c using (doc_id) left join m using (doc_id)
"""

OP11 = f"""
with c as (select conv_id, turn, coalesce(role,'') as role, coalesce(text,'') as text from (select conv_id, turn, role, text from conversations union all select -1, 0, 'user', '{PLANTED}' union all select -1, 1, 'assistant', '{PLANTED}')),
e as (select *, regexp_replace(text,'<(~*)\\|','<\\1~|','g') as t, replace(regexp_replace(role,'<(~*)\\|','<\\1~|','g'),chr(10),'<|n|>') as r from c)
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role,chr(10),text,chr(10)),'' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role='assistant'),0) as bigint) as loss_chars, sha256(coalesce(string_agg(text,'' order by turn nulls first, role, text) filter (role='assistant'),'')) as loss_sha256,
  cast(sum(length('<|im_start|>')+length(r)+1+length(t)+length('<|im_end|>')+1) as bigint) as formatted_chars
from e group by conv_id
"""

OP12 = f"""
with d as (select doc_id, coalesce(source,'') as part, coalesce(text,'') as t from documents),
l as (select doc_id, max(case when quality=1 then 1 else 0 end) as good, max(case when toxic=1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
w as (select doc_id, part, t, {SPACED.format(text="t")} as w, min(doc_id) over (partition by t) as least from d),
f as (select part, coalesce(good,0) as good, coalesce(toxic,0) as toxic, case when len(w)<200 then 1 else 0 end + case when 100*len(list_distinct(w))<50*len(w) then 2 else 0 end
  + case when 100*length(regexp_replace(t,'[^A-Z]','','g'))>2*length(t) then 4 else 0 end + case when regexp_matches(t,'[#$%&*|]') then 8 else 0 end + case when w.doc_id>least then 16 else 0 end as m
  from w left join l on l.doc_id=w.doc_id),
c as (select part, m, good, toxic, count(*) as n from f group by all),
x as (select * from (values ('A',1),('B',2),('C',4),('D',8),('E',16)) v(f,b)),
o as (select concat(x1.f,x2.f,x3.f,x4.f,x5.f) as filter_order, [x1.b,x2.b,x3.b,x4.b,x5.b] as b from x x1, x x2, x x3, x x4, x x5 where x1.b+x2.b+x3.b+x4.b+x5.b=31 and len(list_distinct([x1.b,x2.b,x3.b,x4.b,x5.b]))=5),
s as (select filter_order, step, b[step] as own, cast(coalesce(list_sum(b[1:step-1]),0) as integer) as earlier from (select *, unnest(range(1,6)) as step from o)),
r as (select part, filter_order, step, own, sum(case when (m&(own|earlier))=0 then n else 0 end) as kept, sum(case when (m&own)>0 and (m&earlier)=0 then n else 0 end) as removed, sum(case when (m&own)>0 and (m&earlier)>0 then n else 0 end) as redundant,
  sum(case when m=own then n else 0 end) as unique_fails, sum(case when (m&own)>0 and (m&earlier)=0 then n*good else 0 end) as good_lost, sum(case when (m&own)>0 and (m&earlier)=0 then n*toxic else 0 end) as toxic_lost from c, s group by 1,2,3,4)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley from r
"""

SQL = {"op6_licence_scan": OP6, "op7_jaccard_join": OP7, "op9_lm_score": OP9, "op10_decontaminate": OP10, "op11_chat_format": OP11, "op12_filter_audit": OP12}
