"""The queries of this package over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import chat, decontaminate, html, infilling, jaccard, langid, media, mixing, passages, personal, secrets, substrings, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(substrings.remove_repeats(_table(spark, sf_dir, "documents")))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.jaccard_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _records(turns: DataFrame) -> DataFrame:
    """Turns as JSON records in four of the layouts, dealt by hash: a corpus gathered from sources of different schemas."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit(""))
    known = {"user": "human", "assistant": "gpt"}
    plain = F.to_json(F.struct(role, text.alias("text")))
    messages = F.to_json(F.struct(F.array(F.struct(role, text.alias("content"))).alias("messages")))
    speaker = F.when(F.col("role") == "user", known["user"]).otherwise(known["assistant"])
    shared = F.to_json(F.struct(F.array(F.struct(speaker.alias("from"), text.alias("value"))).alias("conversations")))
    prompt = F.to_json(F.struct(text.alias("prompt")))
    draw = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    record = F.when(draw == 1, messages).when((draw == 2) & F.col("role").isin(*known), shared).when((draw == 3) & (F.col("role") == "user"), prompt).otherwise(plain)
    return turns.select("conv_id", "turn", record.alias("record"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return chat.chat_digests(chat.format_chats(_records(turns.unionByName(extra)), "conv_id", "turn", "record"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.secret_digests(secrets.scan_secrets(docs, model=secrets.fit(docs)))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for fill-in-middle, as digests."""
    return infilling.infilling_digests(infilling.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, as counts and spans."""
    return personal.personal_digests(personal.personal_data(_table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return trie.prefix_trie(trie.rebuilt_conversations(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_media_columns": op3_media_columns,
    "op4_passage_dedup": op4_passage_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_chat_format": op6_chat_format,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_mix_sources": op9_mix_sources,
    "op10_html_extraction": op10_html_extraction,
    "op11_infilling": op11_infilling,
    "op12_personal_data": op12_personal_data,
    "op13_prefix_trie": op13_prefix_trie,
}


def _shingles(table: str, key: str, lowered: str) -> str:
    return rf"""select {key}, unnest(list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as g
    from (select {key}, list_filter(string_split_regex({lowered}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from {table} where text is not null)"""


_ASCII = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _located(kind: str, pattern: str, fits: str) -> str:
    """Spans (doc_id, kind, start, end, hit, and what is to the left and right) of a pattern's matches that fit."""
    return rf"""select doc_id, '{kind}' as kind, start, start + length(hit) as "end", hit, lft, rgt from (
      select doc_id, h[i] as hit, g[i] as lft, g[i + 1] as rgt, list_sum(list_transform(g[:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0)::bigint as start
      from (select doc_id, h, g, unnest(range(1, len(h) + 1)) as i from (select doc_id, regexp_extract_all(text, '{pattern}') as h, string_split_regex(text, '{pattern}') as g from (select doc_id, coalesce(text, '') as text from documents)))) where {fits}"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][({_DIGITS})[-i]::int + 1] * (1 - i % 2) + ({_DIGITS})[-i]::int * (i % 2))) % 10 = 0"
_NUMBER = "replace(hit, ' ', '')"
_MOD_97 = f"list_reduce(list_transform(string_split(substr({_NUMBER}, 5) || substr({_NUMBER}, 1, 4), ''), lambda c: case when c <= '9' then c::int else ascii(c) - 55 end), lambda a, b: (case when b < 10 then a * 10 else a * 100 end + b) % 97) = 1"
_NEAR_LINE = "regexp_matches(right(lft, 40) || '|' || left(rgt, 40), '(?i)(^|[^a-z])(tel|phone|call|fax|mobile|telefon|telefono)($|[^a-z])')"
#: The kinds of op12 as the contract writes their patterns (RE2 has no possessive runs), and the order of kinds.
_PERSONAL = {
    "email": _located("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": _located("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(hit, '.'), lambda x: try_cast(x as bigint) <= 255))"),
    "card": _located("card", r"[0-9](?:[\x20-]?[0-9])+", f"case when length({_DIGITS}) between 16 and 19 then {_LUHN} end"),
    "phone": _located("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 8 and 15"),
    "iban": _located("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", f"case when length({_NUMBER}) between 15 and 34 then {_MOD_97} end"),
    "line": _located("line", r"\(?0[0-9]{1,4}\)?[\x20.-]?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}", rf"length({_DIGITS}) between 8 and 13 and {_NEAR_LINE} and not regexp_matches(right(lft, 40), '[+0-9][\x20().-]*$') and not regexp_matches(rgt, '^[0-9]')"),
}
_BASE_KINDS = ("email", "ip", "card", "phone")
_ORDER = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(_PERSONAL)) + " end"
_SHOWN = f"string_agg(kind || ':' || start || ':' || \"end\", ',' order by {_ORDER}, start)"

#: crc32 of the digits of an id, bit by bit, in DuckDB.
_CRC = "xor(list_reduce(range(8 * length({c}::varchar)), lambda a, i: (xor(a, case when i % 8 = 0 then ascii(substr({c}::varchar, (i // 8 + 1)::int, 1)) else 0 end) >> 1)" \
    " .xor(3988292384 * (xor(a, case when i % 8 = 0 then ascii(substr({c}::varchar, (i // 8 + 1)::int, 1)) else 0 end) & 1)), 4294967295::bigint), 4294967295)"


#: What SQL can express. Left out: a trained model (op1, op7 in part), JPEG bytes (op3), windows of bytes and of
#: min-hashes (op2, op4), seeded hashes (op9), HTML trees (op10); tests hold those against brute force.
ORACLES: dict[str, str] = {
    "op5_jaccard_join": f"""with recursive sh as ({_shingles("documents", "doc_id", _ASCII)}), n as (select doc_id, count(*) as n from sh group by 1),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    links as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 75 * (x.n + y.n - k)),
    reach as (select a as doc_id, b as other from links union select reach.doc_id, links.b from reach join links on reach.other = links.a)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(r.other, d.doc_id)) as component_id
    from documents d left join n on d.doc_id = n.doc_id left join (select doc_id, min(other) as other from reach group by 1) r on d.doc_id = r.doc_id""",
    "op6_chat_format": r"""with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
      union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e as (select *, length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b')) as escaped from c)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
      sum(12 + length(role) + 1 + escaped + 11)::bigint as formatted_chars, 0::bigint as n_unknown from e group by 1""",
    "op11_infilling": r"""with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || doc_id) as h from documents),
      u as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as ws, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
      v as (select *, len(ws) as n, text = '' or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' or h3 % 100 >= 50 as plain, least(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) as a, greatest(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) as z from u),
      w as (select *, array_to_string(ws[:a], '') as p, array_to_string(ws[a + 1:z], '') as m, array_to_string(ws[z + 1:], '') as s from v)
      select doc_id, n::bigint as n, case when plain then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form, case when not plain then length(p) end::bigint as prefix_chars, case when not plain then length(m) end::bigint as middle_chars,
        sha256(case when plain then text when h4 % 100 < 80 then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from w""",
    "op12_personal_data": f"""with s as ({" union all ".join(_PERSONAL.values())}),
      b as (select doc_id, {_SHOWN} filter (where kind in {_BASE_KINDS}) as base, {_SHOWN} as spans, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in _BASE_KINDS)} from s group by doc_id)
      select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in _BASE_KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join b on d.doc_id = b.doc_id""",
    "op13_prefix_trie": f"""with t as (select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id, length(coalesce(text, '')) as chars from conversations where conv_id is not null),
      o as (select conv_id, list({{'id': id, 'chars': chars}} order by turn nulls first, id) as own, {_CRC.format(c="conv_id")} % 6 as h from t group by conv_id),
      r as (select o.conv_id, list_concat(coalesce(g.own[:o.h], []), o.own[o.h + 1:]) as ts from o left join o g on o.conv_id - o.conv_id % 100 = g.conv_id),
      p as (select conv_id, len(ts) as size, d as depth, array_to_string(list_transform(ts[:d], lambda x: x.id), '') as k, array_to_string(list_transform(ts[:d - 1], lambda x: x.id), '') as up, case when d > 0 then ts[d].chars else 0 end as chars, list_transform(range(0, d + 1), lambda j: array_to_string(list_transform(ts[:j], lambda x: x.id), '')) as above from r, unnest(range(0, len(ts) + 1)) as x(d)),
      n as (select k, min(depth) as depth, min(up) as up, min(conv_id) as conv_id, count(*) as n_convs, min(chars) as chars, any_value(above) as above, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '')) as ends_sha256 from p group by k),
      c as (select n.k, count(m.k) as n_children from n left join n m on m.depth = n.depth + 1 and m.up = n.k group by 1),
      s as (select a.k, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * chars) as saved_tokens from n join c on n.k = c.k, unnest(n.above) as a(k) group by 1)
      select n.conv_id, n.depth, q.conv_id as parent_conv_id, n.n_convs, c.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
      from n join c on n.k = c.k join s on n.k = s.k left join n q on n.depth > 0 and q.depth = n.depth - 1 and q.k = n.up""",
    "op8_decontaminate": f"""with d as ({_shingles("documents", "doc_id", "lower(text)")}), i as ({_shingles("benchmark", "item_id", "lower(text)")}), q as (select item_id, count(*) as n_item from i group by 1),
    m as (select doc_id, item_id, count(*) as n_shared from d join i on d.g = i.g group by 1, 2)
    select doc_id, m.item_id, n_item, n_shared, n_shared / n_item as containment from m join q on m.item_id = q.item_id where n_shared >= ceil(n_item * 0.75 - 1e-9)""",
}
