"""Queries of tins' weights over parts and listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import measures, tins
from shelfwise.operators import tins as rows_of_tins
from shelfwise.plans.catalog import LISTINGS, listings, table
from shelfwise.plans.queries import query

_SPELLED = [  # how a part's two weights stand in its name: Spark format, and the parts of the same in SQL
    ("Pêssego %s %d (%d)g", "'Pêssego ' || p_name || ' ' || w || ' (' || d || ')g'"),
    ("%s (%3$d)%2$dG", "p_name || ' (' || d || ')' || w || 'G'"),
    ("%s %dg (%dg)", "p_name || ' ' || w || 'g (' || d || 'g)'"),
    ("Molho %s %d (%d)g", "'Molho ' || p_name || ' ' || w || ' (' || d || ')g'"),
    ("%s 3x%d(%d)Gr", "p_name || ' 3x' || w || '(' || d || ')Gr'"),
    ("%s 4X %3$dg (%2$dg)", "p_name || ' 4X ' || d || 'g (' || w || 'g)'"),
]


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with a full weight w and a drained one d in grams, told by their names and by labels of three stores."""
    key, w = F.col("p_partkey"), F.col("w")
    made = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", (F.col("p_size") * 10 + 90).cast("int").alias("w"), F.when(key % 11 == 0, F.col("p_size") * 10 + 90).otherwise(F.col("p_size") * 7 + 60).cast("int").alias("d"))
    name = F.lit(None).cast("string")
    for i, (spelled, _) in enumerate(_SPELLED):
        name = F.when(key % len(_SPELLED) == i, F.format_string(spelled, "p_name", w, F.col("d"))).otherwise(name)
    label = F.when(key % 5 == 0, F.format_string("emb. %d gr", w)).when(key % 5 == 1, F.format_string("emb. 3 x %d gr (peso escorrido 3 x %d gr)", w, F.col("d"))).when(key % 5 == 2, F.format_string("emb. 2 x %d g peso escorrigo: %d g", w, F.col("d"))).otherwise(F.format_string("Emb. %d gr (Peso Escorrido %d gr)", w, F.col("d")))
    line = F.when(key % 4 == 0, F.format_string("%d g", w)).when(key % 4 == 1, F.format_string("4 x%d g", w)).when(key % 4 == 2, F.format_string("%d g", F.col("d") + 2))
    block = F.when(key % 7 == 0, "").when(key % 7 == 1, "4 g").when(key % 7 == 2, F.format_string("%d.0 Grama", F.col("d"))).when(key % 7 == 3, F.col("d").cast("string")).when(key % 7 == 4, F.format_string("0.%d Quilograma", F.col("d"))).otherwise(F.format_string(" %d g", F.col("d")))
    return made.select("p_partkey", "p_brand", name.alias("name"), label.alias("label"), line.alias("line"), block.alias("block"), F.format_string("Lata %s %d g", "p_name", w).alias("plain_name"))


_N, _A, _K = "(?:([0-9]+)\\s*[x×]\\s*)?", "([0-9]+(?:[.,][0-9]+)?)", "(kg|gr?s?|g)"
_PARTS = f"""w as (select p_partkey, p_name, p_brand, p_size * 10 + 90 as w, case when p_partkey % 11 = 0 then p_size * 10 + 90 else p_size * 7 + 60 end as d from part),
parts as (select p_partkey, p_brand, case p_partkey % {len(_SPELLED)} {" ".join(f"when {i} then {sql}" for i, (_, sql) in enumerate(_SPELLED))} end as name,
  case p_partkey % 5 when 0 then 'emb. ' || w || ' gr' when 1 then 'emb. 3 x ' || w || ' gr (peso escorrido 3 x ' || d || ' gr)' when 2 then 'emb. 2 x ' || w || ' g peso escorrigo: ' || d || ' g' else 'Emb. ' || w || ' gr (Peso Escorrido ' || d || ' gr)' end as label,
  case p_partkey % 4 when 0 then w || ' g' when 1 then '4 x' || w || ' g' when 2 then (d + 2) || ' g' end as line,
  case p_partkey % 7 when 0 then '' when 1 then '4 g' when 2 then d || '.0 Grama' when 3 then d::varchar when 4 then '0.' || d || ' Quilograma' else ' ' || d || ' g' end as block, w from w),
x as (select *, lower(strip_accents(name)) as f, lower(label) as l, lower(trim(coalesce(line, ''))) as s, lower(trim(block)) as b from parts),
y as (select *, regexp_extract(f, '{_N}{_A}\\s*\\(\\s*{_A}\\s*(?:kg|gr?s?|g)?\\s*\\)\\s*{_K}\\b', ['n', 'a', 'b', 'u']) as r1, regexp_extract(f, '\\(\\s*([0-9]{{2,}}(?:[.,][0-9]+)?)\\s*(?:kg|gr?s?|g)?\\s*\\)\\s*{_A}\\s*{_K}\\b', ['a', 'b', 'u']) as r2,
    regexp_extract(f, '{_A}\\s*(kg|grs?|gr|g)\\s*\\(\\s*{_A}\\s*(kg|grs?|gr|g)\\s*\\)', ['a', 'u', 'b', 'v']) as r3,
    regexp_extract(l, 'emb\\.\\s*{_N}([0-9,]+)\\s*(kg|gr|g)\\b', ['n', 'a', 'u']) as lp, regexp_extract(l, 'peso escorri[dg]o\\s*:?\\s*{_N}([0-9,]+)\\s*(kg|gr|g)\\b', ['n', 'a', 'u']) as ln,
    regexp_extract(s, '^{_N}([0-9.,]+)\\s*(kg|g|gr)\\b', ['n', 'a', 'u']) as sp, regexp_extract(b, '^([0-9.,]+)\\s*(kg|quilogramas?|gramas?|gr|g)?\\b', ['a', 'u']) as bp from x),
num as (select *, case when regexp_matches(f, '^\\s*(tomate frito|molho|polpa|passata|ketchup)\\b') then null when r1.a <> '' then row(coalesce(try_cast(r1.n as double), 1), try_cast(r1.a as double), try_cast(r1.b as double)) when r2.a <> '' then row(1.0::double, try_cast(r2.a as double), try_cast(r2.b as double)) when r3.a <> '' and try_cast(r3.b as double) < try_cast(r3.a as double) then row(1.0::double, try_cast(r3.a as double), try_cast(r3.b as double)) end as nm,
    coalesce(try_cast(lp.n as double), 1) as lc, try_cast(lp.a as double) / 1000 as la, try_cast(ln.a as double) / 1000 as lb, try_cast(ln.n as double) as lm, coalesce(try_cast(sp.n as double), 1) as sc, try_cast(sp.a as double) / 1000 as sa, case when bp.u like 'quilo%' then try_cast(bp.a as double) else try_cast(bp.a as double) / 1000 end as be from y),
z as (select *, nm[1] * (greatest(nm[2], nm[3]) / 1000) as nf, nm[1] * (least(nm[2], nm[3]) / 1000) as nd, lc * la as lf, coalesce(lm, lc) * lb as ld, case when be >= 0.005 then be end as e, sc * sa as st from num),
q as (select *, case when sc > 1 and coalesce(e * sc <= st * 1.03, false) then e * sc else e end as bd from z),
told as (select p_partkey, p_brand, w / 1000 as size, case when nd > 0 and nd < nf then round(nf, 4) end as name_full, case when nd > 0 and nd < nf then round(nd, 4) end as name_drained,
    case when lf > 0 and ld > 0 and ld <= lf * 1.001 then round(lf, 4) end as label_full, case when lf > 0 and ld > 0 and ld <= lf * 1.001 then round(ld, 4) end as label_drained,
    case when st >= bd * 1.03 then round(st, 4) end as block_full, round(bd, 4) as block_drained, case when w / 1000 >= e * 1.03 then round(w / 1000, 4) end as listed_full, round(e, 4) as listed_drained from q)"""


@query(f"with {_PARTS} select * exclude (p_brand, size) from told")
def tin_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Both weights of tins from names (six spellings) and from the labels of three stores."""
    # a table of parts is a few files' splits; patterns cost far more than reading, so rows are dealt to all tasks
    dealt = _parts(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism)
    read = dealt.select("p_partkey", tins.name_weights(F.col("name")).alias("a"), tins.label_weights(F.col("label")).alias("b"), tins.block_weights(F.col("line"), F.col("block")).alias("c"), tins.listed_weights(measures.parse_size(F.col("plain_name")), F.col("block")).alias("d"))
    pairs = [F.col(f"{s}.{w}").alias(f"{how}_{w}") for s, how in zip("abcd", ("name", "label", "block", "listed"), strict=True) for w in ("full", "drained")]
    return read.select("p_partkey", *pairs)


#: Listings as tins: a third of a product's stores label both weights, a third one or the other, the rest neither.
_TINS = f"""{LISTINGS}, t as (select *, (product_id * 7 + length(store) * 5) % 6 as m, (product_id % 40) * 0.01 + 0.1 as wf, case when product_id % 13 = 0 then (product_id % 40) * 0.01 + 0.1 else (product_id % 40) * 0.007 + 0.06 end as wd from listings),
tins as (select store || '/' || product_id as id, store, kind, case when unit = 'un' then 'un' else 'kg' end as unit, case when m in (0, 1, 2) then round(wf, 4) end::double as "full", case when m in (0, 1, 3) then round(wd, 4) end::double as drained, case when product_id % 3 = 0 then round(wf + 0.001, 4) else round(wd, 4) end::double as size,
    case when product_id % 2 = 0 then product_id // 4 end as code, product_id % 40 || '/' || sub_kind as same from t)"""


def _tins(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("product_id")
    m = (p * 7 + F.length("store") * 5) % 6
    full = F.round((p % 40) * 0.01 + 0.1, 4)
    drained = F.when(p % 13 == 0, full).otherwise(F.round((p % 40) * 0.007 + 0.06, 4))
    size = F.when(p % 3 == 0, F.round((p % 40) * 0.01 + 0.1 + 0.001, 4)).otherwise(drained)
    unit = F.when(F.col("unit") == "un", "un").otherwise("kg")
    return listings(spark, sf).select(F.concat_ws("/", "store", p.cast("string")).alias("id"), "store", "kind", unit.alias("unit"), F.when(m.isin(0, 1, 2), full).alias("full"), F.when(m.isin(0, 1, 3), drained).alias("drained"), size.alias("size"), F.when(p % 2 == 0, F.floor(p / 4)).alias("code"), F.concat_ws("/", (p % 40).cast("string"), "sub_kind").alias("same"))


_SAME = "(abs({a} - {b}) <= greatest(0.002, 0.02 * greatest({a}, {b})))"
_SF, _SD, _DD = _SAME.format(a="i.size", b="d.full"), _SAME.format(a="i.size", b="d.drained"), _SAME.format(a="d.full", b="d.drained")
_HOP = f"""select i.id, {{rank}} as rank, d.store as donor, d.full as dfull, d.drained as ddrained, '{{how}}:' || d.store as source,
    case when i.drained is not null then case when {_SAME.format(a="i.drained", b="d.drained")} then row(d.full, i.drained) end when i.full is not null then case when {_SAME.format(a="i.full", b="d.full")} then row(i.full, d.drained) end
      when {_DD} then case when {_SF} then row(i.size, i.size) end when {_SD} and not {_SF} then row(d.full, i.size) when {_SF} and not {_SD} then row(i.size, d.drained) end as p
  from tins i join (select distinct {{key}}, store, "full", drained from tins where "full" is not null and drained is not null) d on i.{{key}} = d.{{key}} and i.store <> d.store where i.full is null or i.drained is null"""
_PLACED = f"""{_TINS}, hops as ({_HOP.format(rank=0, how="barcode", key="code")} union all {_HOP.format(rank=1, how="same-product", key="same")}),
placed as (select id, p[1] as "full", p[2] as drained, source from hops where p is not null qualify row_number() over (partition by id order by rank, donor, dfull, ddrained) = 1)"""

KEYS = {"barcode": "code", "same-product": "same"}


@query(f"with {_PLACED} select * from placed")
def tins_placed(spark: SparkSession, sf: str) -> DataFrame:
    """Missing weights of tins from another store's label, by number, else by the same product."""
    return rows_of_tins.placed_weights(_tins(spark, sf), "id", "store", KEYS)


_SOURCE = "case when t.{w} is not null then 'page' else p.source end"
_WHAT = "case when basis = 'drained' then 'Peso escorrido' else 'Peso total' end"


@query(f"""with {_PLACED}, m as (select t.id, t.kind, t.unit, t.size, coalesce(t.full, p.full) as "full", coalesce(t.drained, p.drained) as drained, {_SOURCE.format(w='"full"')} as fs, {_SOURCE.format(w="drained")} as ds from tins t left join placed p on t.id = p.id),
  k as (select *, unit = 'kg' and kind <> 'PROMO' as tin, "full" is null and drained is null as open from m),
  v as (select kind, unit, count(*) as n, count(*) filter (where open or drained is not null) as d, count(*) filter (where open or "full" is not null) as f from k where tin group by 1, 2),
  b as (select k.*, case when v.n is null then null when d = n then 'drained' when f = n then 'full' when d >= f then 'drained' else 'full' end as basis from k left join v on k.kind = v.kind and k.unit = v.unit),
  w as (select *, tin and not open as votes, case when basis = 'drained' then drained else "full" end as weight, case when basis = 'drained' then ds else fs end as src from b)
  select id, basis, case when votes then weight else size end as compared, case when votes and weight is null then case basis when 'drained' then 'full' else 'drained' end end as sits_out,
    case when votes and weight is not null then case split_part(src, ':', 1) when 'barcode' then {_WHAT} || ' do rótulo do mesmo produto (mesmo código de barras) no ' || split_part(src, ':', 2) || '; a loja não o indica.' when 'same-product' then {_WHAT} || ' do rótulo do mesmo produto no ' || split_part(src, ':', 2) || '; a loja não o indica.' end end as note from w""")
def tins_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of tins on one weight after placing, with the tins that sit out and where a weight is from."""
    held = _tins(spark, sf)
    placed = rows_of_tins.placed_weights(held, "id", "store", KEYS).withColumnsRenamed({"full": "pf", "drained": "pd"})
    told = lambda c: F.when(F.col(c).isNotNull(), "page").otherwise(F.col("source"))
    joined = held.join(placed, "id", "left").select("id", "kind", "unit", "size", F.coalesce("full", "pf").alias("full"), F.coalesce("drained", "pd").alias("drained"), told("full").alias("full_source"), told("drained").alias("drained_source"))
    return rows_of_tins.tin_rows(joined, ["kind", "unit"], F.col("kind") != "PROMO", {}).select("id", "basis", "compared", "sits_out", "note")
