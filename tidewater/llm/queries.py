"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import chat, decontaminate, hard_negatives, line_dedup, lm, merkle, mixing, near_dup, quality, simhash, topk, toxicity, url_filter
from tidewater.llm.common import table

#: The rules of op3 as (host, path prefix, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Fixed value: what both turns of conversation -7 say.
CONTROL_TURN = "</s>[INST] ok [/INST]"


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page, by its own rule, else by the component of its redirects and canonical links."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
with recursive p as (select row_number() over () as r, page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
rules(h, pre, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
bare as (select url as src, regexp_replace(html, '(?s)<!--.*?(-->|$)', '', 'g') as h from pages where url is not null and regexp_matches(html, '(?i)canonical|http-equiv')),
tag as (select src, unnest(regexp_extract_all(h, '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) as t from bare),
attr as (select src, lower(t[2:5]) as kind, lower(regexp_extract(t, '(?is)[\s"''](?:rel|http-equiv)\s*=\s*["'']?([^"''>]*)', 1)) as role, coalesce(nullif(regexp_extract(t, '(?is)[\s"''](?:href|content)\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(t, '(?is)[\s"''](?:href|content)\s*=\s*''([^'']*)''', 1), ''), regexp_extract(t, '(?is)[\s"''](?:href|content)\s*=\s*([^\s"''>]+)', 1)) as value from tag),
found as (select src, replace(value, '&amp;', '&') as href from attr where kind = 'link' and list_contains(regexp_split_to_array(role, '\s+'), 'canonical')
  union all select src, trim(regexp_replace(replace(value, '&amp;', '&'), '(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*', ''), ' "''') from attr where kind = 'meta' and trim(role) = 'refresh' and regexp_matches(value, '(?is)^\s*(0*[01])?(\.\d*)?\s*[;,\s]\s*url\s*=')),
parts as (select src, regexp_extract(src, '^([^:/?#]*)://', 1) as scheme, regexp_extract(src, '^[^:/?#]*://([^/?#]*)', 1) as site, regexp_extract(src, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) as folder, regexp_replace(trim(href), '(?s)#.*$', '') as href from found),
whole as (select src, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then case when regexp_matches(href, '(?i)^https?://.') then href end when starts_with(href, '//') then scheme || ':' || href when starts_with(href, '/') then scheme || '://' || site || href
  when starts_with(href, '?') then scheme || '://' || site || folder || href when href <> '' then scheme || '://' || site || case when folder = '' then '/' else regexp_replace(folder, '[^/]*$', '') end || href end as dst from parts),
walk as (select src, regexp_extract(dst, '://([^/?#]*)', 1) as site, regexp_extract(dst, '://[^/?#]*(\?[^#]*)?$', 1) as q0, regexp_extract(dst, '(\?[^#]*)$', 1) as q, string_split(regexp_replace(regexp_extract(dst, '://[^/?#]*([^?#]*)', 1), '^/', ''), '/') as steps from whole where dst is not null),
done as (select src, site, q, list_reduce(steps, lambda a, x: case when x = '..' then regexp_replace(a, '(^|/)[^/]*$', '') when x = '.' then a else a || '/' || x end, '') || case when steps[-1] in ('.', '..') then '/' else '' end as way from walk),
edge as (select distinct translate(regexp_extract(src, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as uh, regexp_extract(src, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as up, regexp_extract(src, '(\?[^#]*)', 1) as uq, translate(site, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as vh, way as vp, q as vq from done where contains(src, '://')),
ends as (select uh as host, up as path, uh || case when up = '' then '/' else up end || uq as node from edge union select vh, vp, vh || case when vp = '' then '/' else vp end || vq from edge),
arc as (select uh || case when up = '' then '/' else up end || uq as a, vh || case when vp = '' then '/' else vp end || vq as b from edge),
both_ways as (select a, b from arc union select b, a from arc),
reach(a, b) as (select node, node from ends union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
ruled as (select node, max_by(action, length(h || pre)) as action from ends join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by node, host, path),
own as (select reach.a as node, case when bool_or(action = 'allow') then 'allow' when bool_or(action = 'block') then 'block' end as action from reach join ruled on reach.b = ruled.node group by 1),
fit as (select r, max_by(h || pre, length(h || pre)) as rule, max_by(action, length(h || pre)) as action from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by r)
select page_id, host, path, rule, coalesce(fit.action, own.action, 'allow') as verdict from p left join fit on p.r = fit.r
  left join own on contains(url, '://') and own.node = host || case when path = '' then '/' else path end || regexp_extract(url, '(\?[^#]*)', 1)
"""


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by 3-word shingles at 0.85."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as g from w),
n as (select w.doc_id, count(g) as n_shingles from w left join s on w.doc_id = s.doc_id group by w.doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from n union select r.a, e.b from r join e on r.b = e.a)
select n.doc_id, n_shingles, min(b) as component_id, n.doc_id = min(b) as kept from n join r on n.doc_id = r.a group by n.doc_id, n_shingles
"""


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth one."""
    e = table(spark, sf_dir, "embeddings")
    return topk.top_k(e, e.where("vec_id % 50 = 0"), k=5)


OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 5
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and conversation -7, read back from their formatted texts."""
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TURN), (-7, 1, "assistant", CONTROL_TURN)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(rows))


OP7_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + length(text) + 9 + case when conv_id = -7 then 3 else 0 end)::bigint as formatted_chars
from c group by conv_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of all documents without the boilerplate lines of their source."""
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("source").alias("host"), F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), "text")


OP2_SQL = """
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, source, text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
p as (select host, count(*) as pages from d group by host),
u as (select distinct r, host, trim(l, ' ') as l from (select r, host, unnest(ls) as l from d) where trim(l, ' ') <> ''),
b as (select host, list(l) as bad from (select u.host, u.l from u join p on u.host = p.host group by u.host, u.l, pages having count(*) >= 2 and count(*) > pages * 0.2) group by host),
x as (select d.*, list_filter(ls, lambda l: trim(l, ' ') = '' or not list_contains(coalesce(bad, []), trim(l, ' '))) as kept from d left join b on d.host = b.host)
select doc_id, source as host, len(ls)::bigint as n_lines, (len(ls) - len(kept))::bigint as n_dropped, case when text is not null and len(kept) < len(ls) then array_to_string(kept, chr(10)) else text end as text from x
"""


def op2_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_line_dedup, by the ratio that falls with a line's length (the rule of the pipeline)."""
    out = line_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("source").alias("host"), F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), "text")


OP2_REPEATS_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, source, text, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as ls from documents),
p as (select host, count(distinct t) as pages from d group by host),
u as (select distinct host, t, trim(l, ' ') as l from (select host, t, unnest(ls) as l from d) where trim(l, ' ') <> ''),
n as (select host, l, count(*) as n, len(regexp_split_to_array(l, '[ \t\r\f]+')) as w, arg_min(t, substr(md5(t), 1, 15)) as keep from u group by host, l),
b as (select n.*, n >= 3 and n > pages * 0.2 as everywhere from n join p on n.host = p.host where n >= 2 and (n > pages * 0.2 or (n >= 3 and (n * w > pages * 0.2 or w >= 50)))),
g as (select u.host, u.t, list(u.l) as bad from u join b on u.host = b.host and u.l = b.l where everywhere or keep <> u.t group by u.host, u.t),
x as (select d.*, list_filter(ls, lambda l: trim(l, ' ') = '' or not list_contains(coalesce(bad, []), trim(l, ' '))) as kept from d left join g on d.host = g.host and d.t = g.t)
select doc_id, source as host, len(ls)::bigint as n_lines, (len(ls) - len(kept))::bigint as n_dropped, case when text is not null and len(kept) < len(ls) then array_to_string(kept, chr(10)) else text end as text from x
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked benchmark items of every document that leaks any."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_decontaminate_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each leaked item's windows that stands in a document, by the rule of the pipeline's stage."""
    return op5_decontaminate(spark, sf_dir).select("doc_id", "item_id", (F.col("n_found") / F.col("n_windows")).alias("share"))


OP5_SQL = r"""
with raw as (select row_number() over () as r, * from (select 'i' as side, item_id as id, text from benchmark where item_id is not null union all select 'd', doc_id, text from documents where doc_id is not null)),
c1 as (select r, side, id, regexp_replace(coalesce(text, ''), '[\x02-\x05]', ' ', 'g') as s from raw),
c2 as (select r, side, id, regexp_replace(regexp_replace(s, '([0-9\p{Nd}])[,.]([0-9\p{Nd}])', '\1' || chr(5) || '\2', 'g'), '([0-9\p{Nd}])[,.]([0-9\p{Nd}])', '\1' || chr(5) || '\2', 'g') as s from c1),
c3 as (select r, side, id, regexp_replace(regexp_replace(s, '(?:\$|€|£)[\t\n\r ]*(\p{Nd}(?:\p{Nd}|\x05)*)', '\1 ' || chr(4) || 'sign ', 'g'), '(\p{Nd})[\t\n\r ]*(?:%|\$|€|£)', '\1 ' || chr(4) || 'sign ', 'g') as s from c2),
c4 as (select r, side, id, regexp_replace(s, '((?:\p{Ll}|\p{Nd}|[,;:])[\t\n\r ])(?:\p{Lu}(?:\p{L}|\p{M}|[''’-])*[\t\n\r ]+)*(\p{Lu})', '\1' || chr(2) || '\2', 'g') as s from c3),
c5 as (select r, side, id, regexp_replace(s, '(\p{Nd})[\t\n\r ]?(\p{L})', '\1 ' || chr(4) || '\2', 'g') as s from c4),
spelled as (select ['two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety','hundred','thousand','million','zwei','drei','vier','fünf','sechs','sieben','acht','neun','zehn','elf','zwölf','dreizehn','vierzehn','fünfzehn','sechzehn','siebzehn','achtzehn','neunzehn','zwanzig','dreißig','vierzig','fünfzig','sechzig','siebzig','achtzig','neunzig','hundert','tausend','millionen','deux','trois','quatre','cinq','huit','neuf','dix','onze','douze','treize','quatorze','quinze','seize','vingt','trente','quarante','cinquante','soixante','mille','dos','tres','cuatro','cinco','seis','siete','ocho','nueve','diez','doce','trece','catorce','quince','dieciséis','diecisiete','dieciocho','diecinueve','veinte','treinta','cuarenta','cincuenta','sesenta','setenta','ochenta','noventa','cien','ciento','mil'] as ws),
tn as (select c1.side, c1.id, list_filter(regexp_split_to_array(lower(regexp_replace(c5.s, '(\p{Nd}(?:\p{Nd}|\x05)*)', chr(3) || '\1', 'g')), '[^\p{L}\p{M}\p{Nd}\x02\x03\x04\x05]+'), lambda t: t <> '') as toks, list_filter(regexp_split_to_array(lower(c1.s), '[^\p{L}\p{M}\p{Nd}]+'), lambda t: t <> '') as words from c1 join c5 on c1.r = c5.r),
tk as (select side, id, list_transform(toks, lambda t, i: case when i > 1 and t > chr(5) and not list_contains(ws, t) and list_contains(ws, toks[i - 1]) then chr(4) || t else t end) as toks, words from tn, spelled),
src as (select side, id, false as exact, toks as a, len(words) as n from tk union all select side, id, true, words, len(words) from tk),
it as (select distinct id, exact, a, least(len(a), 8) as k from src where side = 'i' and n >= 3 and len(a) > 0),
iw as (select distinct id, exact, pos, k, len(a) as t, a[pos:pos + k - 1] as w from (select *, unnest(range(1, len(a) - k + 2)) as pos from it)),
dw as (select distinct id, exact, pos, k, a[pos:pos + k - 1] as w from (select src.id, src.exact, a, ks.k, unnest(range(1, len(a) - ks.k + 2)) as pos from src join (select distinct k, exact from it) ks on src.exact = ks.exact where side = 'd')),
ww as (select * from (select *, case when exact then w else list_transform(w, lambda x: case when x < chr(5) then x[1] when list_contains(ws, x) then chr(3) else x end) end as tpl, exact or (2 * len(list_filter(w, lambda x: x < chr(5) or list_contains(ws, x))) <= k and t >= 5) as few from iw, spelled) where few),
dd as (select *, case when exact then w else list_transform(w, lambda x: case when x < chr(5) then x[1] when list_contains(ws, x) then chr(3) else x end) end as tpl from dw, spelled),
j as (select dd.id as doc_id, ww.id as item_id, ww.exact, ww.pos, dd.pos - ww.pos as shift, ww.w as want, dd.w as got from dd join ww on dd.k = ww.k and dd.exact = ww.exact and dd.tpl = ww.tpl),
z as (select doc_id, item_id, shift, unnest(list_zip(want, got)) as z from j where not exact),
s as (select doc_id, item_id, shift, z[1] as v, count(distinct z[2]) as n from z, spelled where z[1] < chr(5) or list_contains(ws, z[1]) group by 1, 2, 3, 4),
per as (select doc_id, item_id, shift, max(n) as worst, count(*) as n_slots from s group by 1, 2, 3),
total as (select id as item_id, exact, count(distinct pos) as n_windows from ww group by 1, 2),
f as (select j.doc_id, j.item_id, j.exact, count(distinct j.pos) as n_found, max(coalesce(n_slots, 0)) as n_slots from j left join per on not j.exact and j.doc_id = per.doc_id and j.item_id = per.item_id and j.shift = per.shift where coalesce(worst, 1) = 1 group by 1, 2, 3),
o as (select doc_id, f.item_id, n_windows, n_found, n_slots from f join total on f.item_id = total.item_id and f.exact = total.exact where n_found >= n_windows * 0.5 qualify row_number() over (partition by doc_id, f.item_id order by n_found / n_windows desc, f.exact) = 1)
"""
OP5_SHARE_SQL = OP5_SQL + "select doc_id, item_id, n_found / n_windows as share from o"
OP5_SQL += "select doc_id, item_id, n_windows, n_found, n_slots from o"


def _reparameterised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, items) out of the benchmark: every sixth word a number with a unit, in documents other ones.

    Items of even id have another number each time, and so have their documents: one value of the item is one value of
    the document. In items of odd id that 5 divides one number comes all the time, but not in the documents.
    """
    b = table(spark, sf_dir, "benchmark").where("item_id is not null")
    ws, other = F.split("text", " "), (F.col("item_id") % 2 == 1) & (F.col("item_id") % 5 == 0)
    said = lambda n, unit: F.array_join(F.transform(ws, lambda w, i: F.when(i % 6 == 3, F.concat(n(i).cast("string"), F.lit(unit))).otherwise(w)), " ")
    items = b.select("item_id", said(lambda i: F.when(other, 4).otherwise(100 + i), " km").alias("text"))
    return b.select((F.col("item_id") * 10).alias("doc_id"), said(lambda i: 5000 + 7 * i + F.col("item_id"), " Kilometer").alias("text")), items


def op5_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with numbers and units, found in documents that have other ones: slots decide here."""
    return decontaminate.leaks(*_reparameterised(spark, sf_dir))


OP5_SLOTS_SQL = r"""
with ws as (select item_id, string_split(text, ' ') as w from benchmark where item_id is not null),
new_items as (select item_id, array_to_string(list_transform(w, lambda x, i: case when (i - 1) % 6 = 3 then case when item_id % 2 = 1 and item_id % 5 = 0 then '4' else (99 + i)::varchar end || ' km' else x end), ' ') as text from ws),
new_docs as (select item_id * 10 as doc_id, array_to_string(list_transform(w, lambda x, i: case when (i - 1) % 6 = 3 then (5000 + 7 * (i - 1) + item_id)::varchar || ' Kilometer' else x end), ' ') as text from ws),
""" + OP5_SQL.strip().removeprefix("with ").replace("from benchmark where item_id", "from new_items where item_id").replace("from documents where doc_id", "from new_docs where doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of every document: a budget of all tokens, no source more than twice."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), repeats=2.0)
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_order").alias("position"), F.col("_alpha").alias("alpha"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its site is the source, its path within the site the language."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and spans of every document, learnt from the rows that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learnt from the rows that are not held out."""
    return lm.lm_scores(table(spark, sf_dir, "documents"), part=1)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth vector, with a seventh of the labels moved."""
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(e, e.where("vec_id % 50 = 0"))


OP11_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select anchor_id, vec_id as positive_id, score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score qualify rank <= 3
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and tamper check of every document in the manifest by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.manifest(docs, "doc_id", "source", docs.columns, *merkle.lower_case_tampered(docs))


OP12_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, source, lang, n_chars, text, case when c % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other from (select *,
  xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) as c from documents)),
part as (select r, source, doc_id, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head, text, other from d),
leaf as (select r, source, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as h, sha256(head || coalesce(strlen(other) || ':' || other, '-')) as o from part),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as pos from leaf),
tree(source, lvl, pos, h) as (select source, 0, pos, h from placed
  union all select source, lvl + 1, pos // 16, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by source) as n from tree) where n > 1 group by source, lvl, pos // 16),
sub as (select *, row_number() over (order by source nulls first) - 1 as pos from (select source, h as subroot from tree qualify row_number() over (partition by source order by lvl desc) = 1)),
crown(lvl, pos, h) as (select 0, pos, subroot from sub
  union all select lvl + 1, pos // 16, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () as n from crown) where n > 1 group by lvl, pos // 16),
runs as (select source, lvl, pos // 16 as run, list(h order by pos) as hs, count(*) as k from tree group by all),
top_runs as (select lvl, pos // 16 as run, list(h order by pos) as hs from crown group by all),
height as (select source, max(lvl) as top from tree group by source),
crown_height as (select max(lvl) as top from crown),
step(r, source, lvl, pos, proof, folded) as (select r, source, 0, pos, '', o from placed
  union all select s.r, s.source, s.lvl + 1, s.pos // 16, s.proof || array_to_string(hs[:s.pos % 16], '') || array_to_string(hs[s.pos % 16 + 2:], ''), sha256(array_to_string(hs[:s.pos % 16], '') || s.folded || array_to_string(hs[s.pos % 16 + 2:], ''))
  from step s join height g on s.source is not distinct from g.source and s.lvl < g.top join runs x on x.source is not distinct from s.source and x.lvl = s.lvl and x.run = s.pos // 16),
way(r, lvl, pos, proof, folded) as (select s.r, 0, sub.pos, s.proof, s.folded from step s join height g on s.source is not distinct from g.source and s.lvl = g.top join sub on sub.source is not distinct from s.source
  union all select w.r, w.lvl + 1, w.pos // 16, w.proof || array_to_string(hs[:w.pos % 16], '') || array_to_string(hs[w.pos % 16 + 2:], ''), sha256(array_to_string(hs[:w.pos % 16], '') || w.folded || array_to_string(hs[w.pos % 16 + 2:], ''))
  from way w join crown_height on w.lvl < top join top_runs x on x.lvl = w.lvl and x.run = w.pos // 16)
select p.doc_id, p.h as leaf, sub.subroot, c.h as root, sha256(w.proof) as proof_sha256, w.folded as folded_root, w.folded = c.h as verified
from placed p join sub on sub.source is not distinct from p.source join way w on w.r = p.r join crown_height on w.lvl = top join crown c on c.lvl = top
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document by 3-word shingles at 3 bits."""
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_line_dedup, op2_repeated_lines, op3_url_filter, op4_near_dup, op5_decontaminate, op5_decontaminate_any_case, op5_reparameterised, op6_topk, op7_chat, op8_mixing, op9_toxicity, op10_lm, op11_hard_negatives, op12_merkle, op13_simhash)}
ORACLE: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op2_repeated_lines": OP2_REPEATS_SQL, "op3_url_filter": OP3_SQL, "op4_near_dup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op5_decontaminate_any_case": OP5_SHARE_SQL, "op5_reparameterised": OP5_SLOTS_SQL, "op6_topk": OP6_SQL, "op7_chat": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle": OP12_SQL}
