"""Queries of the classifier over lines of documents (as names) with rule tables of their own vocabulary, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import classifier, resolve, rules
from shelfwise.plans.catalog import table
from shelfwise.plans.queries import query

#: Patterns that occur in the fixtures' prose; the operator's own defaults are Portuguese.
PATTERNS = classifier.Patterns(
    prepared_shelf="ing|ung", not_prepared_shelf="tion", coated=r"\bder\b", cooked=r"\bthat\b|\bque\b", snack_shelf=r"\bfor\b", not_snack_shelf=r"for und\b",
    snack_name=r"\bwas die\b", open_shelf=r"\b(outros|mais)\b", open_unless_sweets=r"\bthe\b", sweets_shelf="ble", without=r"\bwith ([a-z]+)", listed=r",|\band\b",
)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document as an item, with a path of two shelves made of its own words, its plain name and words.

    Lines are dealt to all tasks by item, as a file may be one task's: what is found for an item is then joined where its
    line is, so a line is moved once a reading. They are read twice, once for the words that tables of rules are made of:
    written out, names and words would take several times the input's room.
    """
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "name"))
    dealt = lines.select((F.col("doc_id") * 1000000 + F.col("i")).alias("item"), "name").repartition("item")
    i = F.pmod("item", F.lit(1000000))
    w = lambda k: F.coalesce(F.get(F.split("name", " "), F.lit(k)), F.lit(""))
    path = F.concat(w(1), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" e "), w(2))), F.when(i % 9 == 0, F.lit(" outros")).otherwise(F.lit("")), F.lit(" / "), w(3), F.when(i % 2 == 0, F.concat(F.lit(" "), w(4))).otherwise(F.lit("")))
    return dealt.select("item", "name", path.alias("path"), text.plain(F.col("name")).alias("plain"), classifier.name_words(F.col("name")).alias("words"))


def _hashed_words(lines: DataFrame) -> DataFrame:
    """Words of three to five letters with a number by hash, from which the rule tables are made."""
    words = lines.select(F.explode_outer("words").alias("word")).distinct().filter(F.length("word").between(3, 5))
    return resolve.checkpoint(words.withColumn("h", F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("int")))


def _kinds(words: DataFrame) -> DataFrame:
    """About 2,000 rules: two kinds may claim one head, some under patterns, some for names only."""
    h = F.col("h")
    letter = lambda n: F.char((n % 26) + 97)
    require = F.when(h % 4 == 0, F.concat(letter(h), F.lit(".*"), letter(F.floor(h / 26))))
    exclude = F.when(h % 7 == 0, F.concat(letter(F.floor(h / 7)), letter(h)))
    first = words.filter("h % 3 < 2").select((h * 2).alias("order"), F.concat(F.lit("k"), (h % 150).cast("string")).alias("kind"), F.array("word").alias("heads"), require.alias("require"), exclude.alias("exclude"), (h % 6 == 0).alias("name_only"), (h % 150 < 20).alias("prepared"))
    second = words.filter("h % 4 = 0").select((h * 2 + 200001).alias("order"), F.concat(F.lit("m"), (h % 40).cast("string")).alias("kind"), F.array("word").alias("heads"), F.lit(None).cast("string").alias("require"), F.lit(None).cast("string").alias("exclude"), F.lit(False).alias("name_only"), (h % 40 < 8).alias("prepared"))
    return first.unionByName(second)


ROLES = {"cut": 9, "scan-stop": 41, "mix": 23, "generic-mix": 13, "sauce": 67}


def _roles(words: DataFrame) -> DataFrame:
    made = F.array_compact(F.array(*(F.when(F.col("h") % n == 0, F.lit(role)) for role, n in ROLES.items())))
    return words.select("word", F.explode(made).alias("role"))


_STOP = "[" + ", ".join(f"'{w}'" for w in classifier.STOP_WORDS) + "]"
_PLAIN = f"lower(translate({{}}, '{text.ACCENTED}', '{text.PLAIN}'))"
_FOLD = "case when {x} like '%oes' and length({x}) >= 5 then {x}[:-4] || 'ao' when {x} like '%aes' and length({x}) >= 4 then {x}[:-4] || 'ao' when {x} like '%ais' and length({x}) >= 5 then {x}[:-4] || 'al' when {x} like '%s' and length({x}) >= 4 then {x}[:-2] else {x} end"


def _words_sql(normal: str) -> str:
    return f"list_transform(list_filter({normal}, lambda x: length(x) > 2 and not list_contains({_STOP}, x)), lambda x: {_FOLD.format(x='x')})"


_NAME_WORDS = _words_sql(rf"string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PLAIN.format('name')}, '{text.SIZE_TOKEN}', ' ', 'g'), '{text.PACK_TOKEN}', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' +')")
_SHELF_WORDS = _words_sql(f"string_split_regex({_PLAIN.format('segment')}, '[^a-z0-9]+')")
_LETTER = "chr((({}) % 26 + 97)::int)"

#: The items and the rule tables, as _lines() to _roles() make them.
TABLES = rf"""lines as (select doc_id * 1000000 + i - 1 as item, ls[i] as name, string_split(ls[i], ' ') as w, i - 1 as i from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
items as (select item, name, coalesce(w[2], '') || case when i % 3 = 0 then '' else ' e ' || coalesce(w[3], '') end || case when i % 9 = 0 then ' outros' else '' end || ' / ' || coalesce(w[4], '') || case when i % 2 = 0 then ' ' || coalesce(w[5], '') else '' end as path from lines),
base as (select item, {_PLAIN.format("name")} as plain, {_PLAIN.format("path")} as shelf, list_filter(list_transform(string_split_regex(path, '[/>]'), lambda s: trim(s)), lambda s: s <> '') as seg, {_NAME_WORDS} as words from items),
hw as (select word, ('0x' || md5(word)[1:4])::int as h from (select distinct unnest(words) as word from base) where length(word) between 3 and 5),
kinds as (select h * 2 as ord, 'k' || h % 150 as kind, word, case when h % 4 = 0 then {_LETTER.format("h")} || '.*' || {_LETTER.format("h // 26")} end as require, case when h % 7 = 0 then {_LETTER.format("h // 7")} || {_LETTER.format("h")} end as exclude, h % 6 = 0 as name_only, h % 150 < 20 as prepared from hw where h % 3 < 2
  union all select h * 2 + 200001, 'm' || h % 40, word, null, null, false, h % 40 < 8 from hw where h % 4 = 0)"""


def _role_sql(role: str) -> str:
    return f"(word in (select word from hw where h % {ROLES[role]} = 0))"


P = PATTERNS
EXPLAINED = rf"""{TABLES},
pos as (select item, plain, unnest(words) as word, unnest(range(0, len(words))) as pos from base),
claimed as (select p.item, p.pos, p.word, k.kind, k.prepared, k.ord from pos p join kinds k on p.word = k.word where coalesce(regexp_matches(plain, require), true) and not coalesce(regexp_matches(plain, exclude), false)),
hit as (select item, pos, any_value(word) as word, arg_min(kind, ord) as kind, arg_min(prepared, ord) as prepared from claimed group by item, pos),
f as (select b.item, plain, shelf, words[1] as w1, words[2] as w2, words, seg,
  regexp_matches(plain, '{P.cooked}') as cooked, (regexp_matches(shelf, '{P.prepared_shelf}') and not regexp_matches(shelf, '{P.not_prepared_shelf}')) or regexp_matches(plain, '{P.cooked}') as prep,
  (regexp_matches(string_split_regex(shelf, '[/>]')[-1], '{P.snack_shelf}') and not regexp_matches(string_split_regex(shelf, '[/>]')[-1], '{P.not_snack_shelf}')) or regexp_matches(plain, '{P.snack_name}') as snack,
  list_transform(regexp_extract_all(plain, '{P.without}', 1), lambda x: {_FOLD.format(x="x")}) as wo from base b),
g as (select f.*, h.kind as head, coalesce(w1 in (select word from hw where h % {ROLES["mix"]} = 0), false) as mix, coalesce(w2 in (select word from hw where h % {ROLES["generic-mix"]} = 0), false) as gen,
  coalesce(w1 in (select word from hw where h % {ROLES["cut"]} = 0), false) and not snack and not regexp_matches(plain, '{P.coated}') as cut from f left join hit h on f.item = h.item and h.pos = 0),
stops as (select g.item, min(pos) as stop from g join pos using (item) where pos >= 1 and ({_role_sql("scan-stop")} or ({_role_sql("sauce")} and not list_contains(wo, word))) group by 1),
cand as (select g.item, h.pos, h.kind, prep and not h.prepared as raw from g join hit h on g.item = h.item left join stops s on g.item = s.item where cut and h.pos >= 1 and (stop is null or h.pos < stop) and not list_contains(wo, h.word)),
rawat as (select item, min(pos) as raw_at from cand where raw group by 1),
seen as (select c.item, list(kind order by pos) as kinds from cand c left join rawat r on c.item = r.item where raw_at is null or pos < raw_at group by 1),
segs as (select distinct unnest([seg[-1], seg[-2]]) as segment from base),
sw as (select segment, unnest(ws) as word, unnest(range(0, len(ws))) as pos from (select segment, {_SHELF_WORDS} as ws from segs where segment is not null)),
sc as (select segment, list([{{'ids': ids, 'word': sw.word}}] order by pos) as claims from sw join (select word, list(kind order by ord) as ids from kinds group by 1) k on sw.word = k.word group by 1),
sf as (select segment, list_reduce(claims, lambda a, x: case when len(list_filter(a, lambda q: list_has_any(q.ids, x[1].ids))) = 0 then list_concat(a, x)
    else list_concat(list_filter(a, lambda q: q <> list_filter(a, lambda z: list_has_any(z.ids, x[1].ids))[1]), [{{'ids': list_concat(list_filter(a, lambda z: list_has_any(z.ids, x[1].ids))[1].ids, x[1].ids), 'word': list_filter(a, lambda z: list_has_any(z.ids, x[1].ids))[1].word}}]) end) as foods from sc),
sh as (select s.segment, coalesce(len(foods), 0) as n, foods[1].word as word, regexp_matches({_PLAIN.format("s.segment")}, '{P.open_shelf}') or (not regexp_matches({_PLAIN.format("s.segment")}, '{P.sweets_shelf}') and regexp_matches({_PLAIN.format("s.segment")}, '{P.open_unless_sweets}')) as op from segs s left join sf on s.segment = sf.segment where s.segment is not null),
ats as (select g.item, case when coalesce(l.n > 0 or l.op, false) then l.n else p.n end as n, case when coalesce(l.n > 0 or l.op, false) then l.op else p.op end as op, case when coalesce(l.n > 0 or l.op, false) then l.word else p.word end as word from g left join sh l on g.seg[-1] = l.segment left join sh p on g.seg[-2] = p.segment),
bs as (select ats.item, arg_min(k.kind, ord) as kind, arg_min(k.prepared, ord) as prepared from ats join g using (item) join kinds k on ats.word = k.word where n = 1 and not op and not name_only and coalesce(regexp_matches(plain, require), true) and not coalesce(regexp_matches(plain, exclude), false) group by 1),
d as (select g.item, head, mix and gen as generic, mix and regexp_matches(plain, '{P.listed}') as several, coalesce(len(list_distinct(kinds)), 0) as nk, kinds[1] as ck, n, coalesce(op, false) as op, bs.kind as sk, (cooked or raw_at is not null) and not coalesce(bs.prepared, false) as barred
  from g left join seen on g.item = seen.item left join rawat on g.item = rawat.item left join ats on g.item = ats.item left join bs on g.item = bs.item),
e as (select item, head, nk, several, ck, sk, case when head is not null then null when generic or (several and nk > 1) then 'a mix of several foods' when nk > 0 and (not several or nk = 1) then null when n > 1 then 'shelf names several foods' when op then 'open shelf' when sk is not null and barred then 'prepared or cooked' when sk is null then 'nothing recognised' end as why from d),
explained as (select item, case when why is null then coalesce(head, case when nk > 0 and (not several or nk = 1) then ck end, sk) end as kind, case when why is null then case when head is not null then 'head' when nk > 0 and (not several or nk = 1) then 'cut' else 'shelf' end end as step, why from e)"""


@query(f"with {EXPLAINED} select * from explained")
def kinds_explained(spark: SparkSession, sf: str) -> DataFrame:
    """K2 K3: the kind of every line by head word, cut or shelf, with the step that decided or why none did."""
    lines = _lines(spark, sf)
    words = _hashed_words(lines)
    return classifier.explain_kinds(lines, _kinds(words), _roles(words), "item", patterns=PATTERNS)


def _decided(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """Lines with the kind of the first rule that claims one of their words, by the joined table."""
    return lines.join(_first(lines, kinds).withColumnRenamed("rule", "kind"), "item", "left").withColumn("category", F.substring("kind", 1, 2))


def _first(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    return rules.match_heads(lines, kinds.withColumnRenamed("kind", "id"), "item", "words", "plain")


_FIRST = f"""{TABLES}, w as (select item, plain, unnest(list_distinct(words)) as word from base),
first as (select item, arg_min(kind, (ord, kind)) as kind from w join kinds k on w.word = k.word where coalesce(regexp_matches(plain, require), true) and not coalesce(regexp_matches(plain, exclude), false) group by 1)"""


@query(f"with {_FIRST} select item, kind as rule from first")
def head_matches(spark: SparkSession, sf: str) -> DataFrame:
    """K2: the first rule that claims any word of a line, by equi-join with a table of about 2,000 rules."""
    lines = _lines(spark, sf)
    return _first(lines, _kinds(_hashed_words(lines)))


def _sub_kind_rules(kinds: DataFrame) -> DataFrame:
    """Three ordered rules for each kind."""
    kinds = kinds.select("kind").distinct()
    n = F.conv(F.substring(F.md5("kind"), 1, 4), 16, 10).cast("int") + F.col("order") * 5
    return kinds.select("kind", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("order")).select("kind", "order", F.concat("kind", F.lit("-"), F.col("order").cast("string")).alias("sub_kind"), F.concat(F.char(n % 26 + 97), F.char(F.floor(n / 26) % 13 + 97)).alias("match"))


_SUB = f"""{_FIRST}, subs as (select kind, o, kind || '-' || o as sub_kind, {_LETTER.format("('0x' || md5(kind)[1:4])::int + o * 5")} || chr((((('0x' || md5(kind)[1:4])::int + o * 5) // 26) % 13 + 97)::int) as match from (select distinct kind from kinds), unnest(range(0, 3)) as x(o))"""


@query(f"with {_SUB}, m as (select f.item, arg_min(sub_kind, o) as sub_kind from first f join base b on f.item = b.item join subs s on f.kind = s.kind where regexp_matches(b.plain, match) group by 1) select b.item, f.kind, m.sub_kind from base b left join first f on b.item = f.item left join m on b.item = m.item")
def sub_kinds_found(spark: SparkSession, sf: str) -> DataFrame:
    """K4: the first sub-kind rule of an item's kind that its name matches; null where none does or the item has no kind."""
    lines = _lines(spark, sf)
    kinds = _kinds(_hashed_words(lines))
    return classifier.sub_kinds(_decided(lines, kinds), _sub_kind_rules(kinds), "item", also=("kind",))


def _label_rules(spark: SparkSession) -> DataFrame:
    """A dozen label rules with every kind of gate; label l3 has two."""
    rows = [
        (1, "l1", r"\bthe\b", None, None, None, None, None), (2, "l2", "tion", r"\bof\b", None, None, None, None), (3, "l3", r"\bund\b", None, None, None, None, None), (4, "l4", "eau", None, "ing", None, None, None),
        (5, "l5", "er", None, None, ["k1", "k2", "k10", "m3"], None, None), (6, "l6", "en", None, None, None, ["k3", "k4", "m8"], None), (7, "l7", "an", "la", None, None, None, ["k1", "k2", "m1"]), (8, "l3", r"\bque\b", None, None, None, None, ["k3", "k5"]),
        (9, "l9", "zzz", None, r"\bfor\b|th", None, None, ["k4", "m2", "k1"]), (10, "l10", "o", "u", None, ["k7", "k70", "k71", "k72"], ["k70"], ["k7"]), (11, "l11", r"^[a-h]", None, None, None, None, None), (12, "l12", "x", None, None, None, None, []),
    ]
    return spark.createDataFrame(rows, "order int, label string, match string, unless string, shelf string, kinds array<string>, not_kinds array<string>, categories array<string>")


_LABEL_ROWS = """lr(ord, label, match, unl, shelf, kinds, not_kinds, categories) as (values (1, 'l1', '\\bthe\\b', null::varchar, null::varchar, null::varchar[], null::varchar[], null::varchar[]), (2, 'l2', 'tion', '\\bof\\b', null, null, null, null), (3, 'l3', '\\bund\\b', null, null, null, null, null), (4, 'l4', 'eau', null, 'ing', null, null, null),
(5, 'l5', 'er', null, null, ['k1', 'k2', 'k10', 'm3'], null, null), (6, 'l6', 'en', null, null, null, ['k3', 'k4', 'm8'], null), (7, 'l7', 'an', 'la', null, null, null, ['k1', 'k2', 'm1']), (8, 'l3', '\\bque\\b', null, null, null, null, ['k3', 'k5']),
(9, 'l9', 'zzz', null, '\\bfor\\b|th', null, null, ['k4', 'm2', 'k1']), (10, 'l10', 'o', 'u', null, ['k7', 'k70', 'k71', 'k72'], ['k70'], ['k7']), (11, 'l11', '^[a-h]', null, null, null, null, null), (12, 'l12', 'x', null, null, null, null, []))"""


@query(f"""with {_FIRST}, {_LABEL_ROWS}, m as (select b.item, label, min(ord) as ord from base b left join first f on b.item = f.item join lr on (regexp_matches(plain, match) or (b.shelf <> '' and coalesce(regexp_matches(b.shelf, lr.shelf), false))) and not coalesce(regexp_matches(plain, unl), false)
    and (kinds is null or coalesce(list_contains(kinds, f.kind), false)) and not coalesce(list_contains(not_kinds, f.kind), false) and (categories is null or coalesce(list_contains(categories, f.kind[1:2]), false)) group by 1, 2),
  a as (select item, list(label order by ord) as labels from m group by 1) select b.item, coalesce(labels, []) as labels from base b left join a on b.item = a.item""")
def labels_found(spark: SparkSession, sf: str) -> DataFrame:
    """K5: every label whose gates an item passes, in the order of the table."""
    lines = _lines(spark, sf)
    kinds = _kinds(_hashed_words(lines))
    known = kinds.select("kind").union(spark.sql("select string(null)")).select("kind", F.substring("kind", 1, 2).alias("category"))
    return classifier.label_sets(_decided(lines, kinds), _label_rules(spark), "item", pairs=known)


@query(f"""with {_SUB}, m as (select f.item, arg_min(sub_kind, o) as sub_kind from first f join base b on f.item = b.item join subs s on f.kind = s.kind where regexp_matches(b.plain, match) group by 1),
  now as (select b.item, f.kind, m.sub_kind from base b left join first f on b.item = f.item left join m on b.item = m.item),
  was as (select item, case when item % 4 = 0 then null when item % 4 = 1 then 'gone' else kind end as kind, sub_kind from now where item % 5 > 0),
  d as (select n.item, n.kind, n.sub_kind, list_filter([case when n.kind is distinct from w.kind then 'kind' end, case when n.sub_kind is distinct from w.sub_kind then 'sub_kind' end], lambda x: x is not null) as changed from now n left join was w on n.item = w.item)
  select * from d where len(changed) > 0""")
def assignments_changed(spark: SparkSession, sf: str) -> DataFrame:
    """K6: what today's decision changes in stored kinds, values cleared to nothing and items without a stored row included."""
    now = resolve.checkpoint(sub_kinds_found(spark, sf))
    stored = now.filter("item % 5 > 0").withColumn("kind", F.when(F.col("item") % 4 == 0, None).when(F.col("item") % 4 == 1, "gone").otherwise(F.col("kind")))
    return classifier.assignment_changes(stored, now, "item", ("kind", "sub_kind"))
