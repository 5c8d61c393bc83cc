"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import decoded, encoded
from .decontaminate import leaks
from .hard_negatives import hard_negatives
from .lang_id import identify
from .line_dedup import line_dedup
from .merkle import proof_text, verified_manifest
from .minhash import near_duplicates
from .mixing import fair_queue
from .quality import quality_scores
from .suffix_dedup import repeated_spans
from .token_counts import length_histogram
from .url_filter import host_of, list_keys, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc.doc_id", "held_out", "lang_pred", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = fair_queue(_table(spark, sf_dir, "documents"), ordered=False)
    return queue.filter("epoch = 0").select("doc.doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Changes of three block lists, as (list, kind, value, action, date); ``dated_list`` adds more from the pages.
URL_LIST = [
    ("spam", "domain", "cheap-pills.example.net", "add", "2024-01-10"),
    ("spam", "domain", "cheap-pills.example.net", "remove", "2024-09-01"),
    ("spam", "domain", "cheap-pills.example.net", "add", "2025-02-01"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-03-01"),
    ("spam", "host", "tionsh.example.net", "add", "2024-11-05"),
    ("spam", "host", "tionsh.example.net", "remove", "2024-11-20"),
    ("adult", "domain", "ththth.example.org", "add", "2024-05-01"),
    ("adult", "host", "m.thther.example.org", "add", "2024-02-01"),
    ("adult", "host", "m.thther.example.org", "add", "2024-08-01"),
    ("adult", "host", "m.thther.example.org", "remove", "2025-01-01"),
    ("legal", "domain", "tionble.example.com", "add", "2025-03-15"),
    ("legal", "domain", "example.org", "add", "2025-10-01"),
    ("legal", "domain", "example.org", "remove", "2025-10-15"),
    ("legal", "url", "http://tionsh.example.net/en/151?utm_source=feed", "add", "2023-06-01"),
]


def dated_list(pages: DataFrame) -> DataFrame:
    """``URL_LIST``, and changes made from the pages, as the tables hold no list: the hash of what an entry
    could name says if it was ever listed (one of 8 hosts and domains, one of 64 URLs), in which list and
    when, whether it was removed (3 of 4) and then listed again (half of these). So the list grows with the pages, as do
    those listed at several times."""
    named = pages.select("url", host_of(F.col("url")).alias("host")).select(F.explode(list_keys(F.col("url"), F.col("host"))).alias("key")).select("key.*")
    named = named.filter("value is not null and (kind != 'domain' or contains(value, '.'))").distinct()
    n = F.conv(F.substring(F.md5(F.concat_ws(" ", "kind", "value")), 1, 7), 16, 10).cast("int")
    made = named.withColumn("n", n).filter("n % if(kind = 'url', 64, 8) = 0").selectExpr(
        "element_at(array('adult', 'legal', 'spam'), cast(n div 64 % 3 + 1 as int)) as list",
        "kind",
        "value",
        "date_add(date'2024-01-01', cast(n div 256 % 600 as int)) as added",
        "if(n div 512 % 4 = 0, null, cast(n div 4096 % 200 + 1 as int)) as days",
        "n div 2048 % 2 = 0 as again",
    )
    changes = "array(named_struct('action', 'add', 'at', added), named_struct('action', 'remove', 'at', date_add(added, days)), named_struct('action', 'add', 'at', if(again, date_add(added, days + 30), null)))"
    made = made.selectExpr("list", "kind", "value", f"inline({changes})").filter("at is not null")
    fixed = pages.sparkSession.createDataFrame(URL_LIST, "list string, kind string, value string, action string, at string")
    return fixed.withColumn("at", F.col("at").cast("date")).unionByName(made)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time: page n counts as fetched n mod 730 days after 1 January 2024."""
    pages = _table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 730).cast("int"))
    judged = url_filter(pages.select("page_id", "url", fetched.alias("fetched")), dated_list(pages))
    return judged.select("page_id", "host", "fetched", F.array_join("lists", ",").alias("lists"), "blocked")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)
    return found.select("doc.doc_id", "n_shingles", "component_id", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verified_manifest(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary`` is the path of a tokenizer file on every machine, ``byte_bpe_50k.json`` by default."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    found = decoded(encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc.doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lang_id": op1_lang_id,
    "op2_ann": op2_ann,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_minhash": op9_minhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle,
    "op12_bpe": op12_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _merkle_levels(name: str, leaves: str, walkers: str, levels: int) -> str:
    """SQL that builds ``levels`` levels over ``leaves`` (g, pos, n, h) and walks ``walkers`` (with pos, n,
    seen, proof) up through them: tables ``{name}_n`` of tops and ``{name}_p`` of walkers at the top."""
    sql = f"{name}_n0 as (select g, pos, n, h from {leaves}), {name}_p0 as (select * from {walkers})"
    for k in range(levels):
        last = "" if k == levels - 1 else str(k + 1)
        sql += f""",
{name}_r{k} as (select g, pos // 16 as run, any_value(n) as n, list(h order by pos) as hs from {name}_n{k} where n > 1 group by g, pos // 16),
{name}_n{last} as (select g, run as pos, (n + 15) // 16 as n, sha256(array_to_string(hs, '')) as h from {name}_r{k} union all select g, pos, n, h from {name}_n{k} where n = 1),
{name}_p{last} as (select p.* replace (p.pos // 16 as pos, (p.n + 15) // 16 as n, p.proof || coalesce(array_to_string(hs[:p.pos % 16], '') || array_to_string(hs[p.pos % 16 + 2:], ''), '') as proof,
    coalesce(sha256(array_to_string(hs[:p.pos % 16], '') || p.seen || array_to_string(hs[p.pos % 16 + 2:], '')), p.seen) as seen)
  from {name}_p{k} p left join {name}_r{k} r on p.g is not distinct from r.g and p.pos // 16 = r.run and p.n > 1)"""
    return sql


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_RECORD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32, a bit at a time: each byte is taken in, then shifted out in eight steps.
_CRC = "xor(list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_concat([ascii(c)::bigint], list_resize([]::bigint[], 8, -1)))), lambda a, b: case when b >= 0 then xor(a, b) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, 4294967295::bigint), 4294967295::bigint)"

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select doc_id, pos, line, {_FOLD.format(f"trim(line, {_SPACE})")} as key from l),
f as (select key, min(doc_id) as lo from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
x as (select k.doc_id, k.pos, k.line, f.key is not null and k.doc_id > f.lo as gone from k left join f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from x group by doc_id""",
    "op5_mixing": """
with d as (select doc_id, source, md5(coalesce(doc_id::varchar, '-' || md5(text), '')) as key, coalesce(len(regexp_extract_all(text, '[^ \\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint as weight from s),
r as (select *, (3 * source_size)::double / weight as dry from w),
v as (select *, (sum(source_size) over ())::bigint as budget,
    coalesce(sum(3 * source_size) over (order by dry, source is null, source rows between unbounded preceding and 1 preceding), 0)::bigint as spent,
    (sum(weight) over (order by dry, source is null, source rows between current row and unbounded following))::bigint as open from r),
h as (select budget - spent as rest, open as sharing, (budget - spent)::double / open as horizon from v where (budget - spent)::double / open <= dry order by horizon desc limit 1),
t as (select source, source_size, least((3 * source_size)::double, weight * horizon) as target, least(3 * source_size, (weight * rest) // sharing) as cut from v, h),
q as (select doc_id, source, size, (sum(size) over (partition by source order by key, size rows unbounded preceding))::bigint as upto from d)
select doc_id, size, source_size, target,
  (greatest(0, least(size, cut - upto + size))
  + greatest(0, least(size, cut - source_size - upto + size))
  + greatest(0, least(size, cut - 2 * source_size - upto + size)))::bigint as taken
from q join t on q.source is not distinct from t.source""",
    "op8_url_filter": """
with f(name, kind, value, action, day) as (values """ + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in URL_LIST) + """),
b as (select page_id, url, rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.') as named from pages),
c as (select page_id, url, case when strlen(named) between 1 and 253 then named end as host,
  date '2024-01-01' + (page_id % 730)::int as fetched from b),
k as (select 'host' as kind, host as value from c union select 'url', regexp_replace(lower(url), '#.*$', '') from c
  union select 'domain', unnest([array_to_string(string_split(host, '.')[j:], '.') for j in range(1, len(string_split(host, '.')))]) from c),
n as (select kind, value, ('0x' || substr(md5(kind || ' ' || value), 1, 7))::int as n from k where value is not null),
m as (select kind, value, ['adult', 'legal', 'spam'][n // 64 % 3 + 1] as name, date '2024-01-01' + n // 256 % 600 as added,
  case when n // 512 % 4 != 0 then n // 4096 % 200 + 1 end as days, n // 2048 % 2 = 0 as again from n where n % case kind when 'url' then 64 else 8 end = 0),
e as (select name, kind, value, action, day::date as day from f
  union all select name, kind, value, 'add', added from m
  union all select name, kind, value, 'remove', added + days from m where days is not null
  union all select name, kind, value, 'add', added + days + 30 from m where days is not null and again),
i as (select distinct name, kind, value, day, action from e),
s as (select name, kind, value, day as since, action, lead(day) over (partition by name, kind, value order by day, action) as until from i),
v as (select * from s where action = 'add' and (until is null or until > since)),
h as (select c.page_id, string_agg(distinct v.name, ',' order by v.name) as lists from c join v
  on c.fetched >= v.since and (v.until is null or c.fetched < v.until)
  and (v.kind = 'host' and c.host = v.value or v.kind = 'domain' and (c.host = v.value or ends_with(c.host, '.' || v.value))
    or v.kind = 'url' and regexp_replace(lower(c.url), '#.*$', '') = v.value) group by c.page_id)
select c.page_id, c.host, c.fetched, coalesce(h.lists, '') as lists, h.page_id is not null as blocked from c left join h on c.page_id = h.page_id""",
    "op9_minhash": f"""
with recursive w as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^ \\x09-\\x0D]+') as ws from documents),
g as (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else [array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)] end) as s from w),
s as (select distinct doc_id, s from g),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union select b, a from l),
r(node, seen) as (select doc_id, doc_id from documents union select r.node, e.b from r join e on r.seen = e.a),
c as (select node, min(seen) as root from r group by node)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.root as component_id, w.doc_id = c.root as kept
from w left join n on w.doc_id = n.doc_id join c on w.doc_id = c.node""",
    "op11_merkle": f"""
with d as (select doc_id, source as g, sha256({_RECORD} || {_FIELD.format("text")}) as leaf,
    sha256({_RECORD} || {_FIELD.format(f"(case when {_CRC} % 5 = 0 then {_FOLD.format('text')} else text end)")}) as seen from documents),
l as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n, leaf as h, '' as proof from d),
{_merkle_levels("a", "l", "l", 7)},
s as (select 0 as g, row_number() over (order by g nulls first) - 1 as pos, count(*) over () as n, h, g as source from a_n),
w as (select 0 as g, s.pos, s.n, p.seen, p.proof, p.doc_id, p.leaf, s.h as subroot from a_p p join s on p.g is not distinct from s.source),
{_merkle_levels("b", "s", "w", 4)}
select doc_id, leaf, subroot, b_n.h as root, sha256(proof) as proof_sha256, seen as folded_root, seen = b_n.h as verified from b_p, b_n""",
    "op13_hard_negatives": """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other)::int as rank, other as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other) <= 3""",
}
