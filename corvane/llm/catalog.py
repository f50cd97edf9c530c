"""Registered queries of the pipeline operators and the SQL that some of them have."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_extract, jaccard_join, lexical_search, license_scan, mixing, prefix_trie, quality_classifier, quality_rules, sentencepiece_fst, substring_dedup, url_filter
from .common import LOWER, UPPER, table

#: Split pattern of the byte-level vocabularies (fixed value).
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


SQL_WORD = "[^\\x20\\x09-\\x0D]+"
NORM = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


@query("op4_exact_dedup", f"""with t as (select doc_id, {NORM} as t from documents), g as (select t, max(doc_id) as keep_id, count(*) as group_size from t group by t)
 select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from t join g using (t)""")
def op4_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.assign(table(spark, d, "documents"))


#: Rules of the query (fixed values): host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op6_url_filter")
def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a page are those of the document whose number ends its path: bad if its quality is 0."""
    pages = table(spark, d, "pages")
    bad = table(spark, d, "labels").filter("quality is not null").groupBy(F.col("doc_id").alias("_doc")).agg((1 - F.max("quality")).alias("bad"))
    number = F.regexp_extract(url_filter.host_path("url")[1], r"/(\d{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    named = pages.select("page_id", F.when(number != "", number.cast("bigint")).alias("_doc")).filter("_doc is not null and page_id is not null")
    labels = named.join(bad, "_doc").select("page_id", "bad")
    return url_filter.filter_urls(pages, labels, URL_RULES)


ROUND = """, e{i} as (select d.source, d.doc_id, d.size, d.v, s.rest from dv d join s{p} s on d.source is not distinct from s.source where s.rest > s.near and d.size > 0 and d.size <= s.rest and d.v > s.hi),
 c{i} as (select *, sum(size) over (partition by source order by v) as cum from e{i}),
 p{i} as (select source, max(v) as hi, sum(size) as got from c{i} where cum <= rest group by source),
 t{i} as (select doc_id, source, v from c{i} where cum <= rest),
 s{i} as (select s.source, s.near, s.rest - coalesce(got, 0) as rest, coalesce(p.hi, s.hi) as hi from s{p} s left join p{i} p on s.source is not distinct from p.source)"""
#: One document of each source comes in or goes, whichever brings it nearest. Tables: rows {h} with m (in the mix) and moved, sources {l} with what is left.
EXCHANGE = """, {h}b{i} as (select h.source, v, size, rest, sum(size) as total, abs(abs(rest) - sum(size)) as off from {h}{p} h join {l}{p} l on h.source is not distinct from l.source
  where size > 0 and v > 0 and v < 1 and not moved and abs(rest) > near and m = (rest < 0) and size < 2 * abs(rest) group by h.source, v, size, rest),
 {h}n{i} as (select source, min({{'off': off, 'v': v, 'size': size, 'total': total}}) as b from {h}b{i} where off < abs(rest) group by source),
 {h}{i} as (select h.* exclude (m, moved), m <> coalesce(n.b.v = h.v and n.b.size = h.size, false) as m, moved or coalesce(n.b.v = h.v and n.b.size = h.size, false) as moved from {h}{p} h left join {h}n{i} n on h.source is not distinct from n.source),
 {l}{i} as (select l.source, near, rest - coalesce(sign(rest) * n.b.total, 0) as rest from {l}{p} l left join {h}n{i} n on l.source is not distinct from n.source)"""
#: The last of the ranking go while their words fit what a source has too much.
EMPTY = """, w{i} as (select h.*, -rest as over_, sum(size) over (partition by h.source order by v desc) as cum from g{p} h join k{p} l on h.source is not distinct from l.source where -rest > near and m and size > 0 and size <= -rest and v > 0 and v < hi and not moved),
 q{i} as (select source, min(v) as lo, sum(size) as got from w{i} where cum <= over_ group by source),
 g{i} as (select h.* exclude (m), m and not exists(select 1 from w{i} w where w.cum <= w.over_ and w.doc_id is not distinct from h.doc_id and w.source is not distinct from h.source and w.v = h.v) as m from g{p} h),
 k{i} as (select l.source, near, rest + coalesce(got, 0) as rest, coalesce(q.lo, hi) as hi from k{p} l left join q{i} q on l.source is not distinct from q.source)"""
PASSES, EXCHANGES, EMPTIED = 8, 8, 6
MIX_SQL = f"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}')) as bigint) as size,
  (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) + 0.5::double) / pow(2.0, 52) as u from documents),
 g as (select source, cast(sum(size) as double) as ss, count(*) as n from d group by source),
 r as (select *, cast([5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) as w from g),
 o as (select *, coalesce(sum(3 * ss) over q, 0) as cap_before, coalesce(sum(w) over q, 0) as w_before, sum(ss) over () as total, sum(w) over () as wt from r
  window q as (order by 3 * ss / w, source rows between unbounded preceding and 1 preceding)),
 lv as (select max((total - cap_before) / (wt - w_before)) as hi, max((total - cap_before) / (wt - w_before)) filter ((total - cap_before) / (wt - w_before) <= 3 * ss / w) as level from o),
 tg as (select source, ss, n, least(3 * ss, coalesce(level, hi) * w) as target from r, lv),
 bands as (select source, least(length(bin(size)), 11) + 9 as g, sum(size) as s from d where size > 0 group by all),
 factor as (select b.source, g, (target - floor(coalesce(target / nullif(ss, 0), 0)) * ss - coalesce(sum(s) over (w rows between unbounded preceding and 1 preceding), 0)) / sum(s * g) over (w rows between current row and unbounded following) as f
  from bands b join tg on b.source is not distinct from tg.source window w as (partition by b.source order by g desc)),
 lam as (select source, arg_max(f, g) as f from factor where f * g <= 1 group by source),
 p as (select d.*, coalesce(f, 0) * (least(length(bin(size)), 11) + 9) as p from d left join lam on d.source is not distinct from lam.source),
 q as (select *, case when size > 0 and p > 0 and p < 1 then (u / (1 - u)) / (p / (1 - p)) end as q from p),
 dv as (select *, case when size <= 0 or p <= 0 then 1.0::double when p >= 1 then 0.0::double else q / (1 + q) end as v from q),
 s0 as (select source, greatest(0.001 * target, 1) as near, target - floor(coalesce(target / nullif(ss, 0), 0)) * ss as rest, cast(-1 as double) as hi from tg)
 """ + "".join(ROUND.format(i=i, p=i - 1) for i in range(1, PASSES + 1)) + f"""
 , tk as ({" union all ".join(f"select doc_id, source, v from t{i}" for i in range(1, PASSES + 1))}),
 h0 as (select dv.*, exists(select 1 from tk where tk.doc_id is not distinct from dv.doc_id and tk.source is not distinct from dv.source) as m, false as moved from dv),
 l0 as (select source, near, rest from s{PASSES})""" + "".join(EXCHANGE.format(h="h", l="l", i=i, p=i - 1) for i in range(1, EXCHANGES + 1)) + f"""
 , fu as (select h.source, v, size, sum(size) as total from h{EXCHANGES} h join l{EXCHANGES} l on h.source is not distinct from l.source where rest > near and size > rest and v > 0 and v < 1 and not m and not moved group by h.source, v, size),
 ff as (select source, min({{'total': total, 'v': v, 'size': size}}) as b from fu group by source),
 g0 as (select h.* exclude (m, moved), m or (ff.b.v = h.v and ff.b.size = h.size) as m, moved or (ff.b.v = h.v and ff.b.size = h.size) as moved from h{EXCHANGES} h join ff on h.source is not distinct from ff.source),
 k0 as (select l.source, near, rest - ff.b.total as rest, 2.0::double as hi from l{EXCHANGES} l join ff on l.source is not distinct from ff.source)""" + "".join(EMPTY.format(i=i, p=i - 1) for i in range(1, EMPTIED + 1)) + f"""
 , y0 as (select * from g{EMPTIED}), z0 as (select source, near, rest from k{EMPTIED})""" + "".join(EXCHANGE.format(h="y", l="z", i=i, p=i - 1) for i in range(1, EXCHANGES + 1)) + f"""
 , nearer as (select z.source from z{EXCHANGES} z join l{EXCHANGES} l on z.source is not distinct from l.source where abs(z.rest) < abs(l.rest)),
 h as (select * from y{EXCHANGES} y where exists(select 1 from nearer where nearer.source is not distinct from y.source) union all by name select * from h{EXCHANGES} h where not exists(select 1 from nearer where nearer.source is not distinct from h.source))
 select h.doc_id, h.size, cast(tg.ss as bigint) as source_size, round(target, 6) as target,
  cast(h.size * (floor(coalesce(target / nullif(ss, 0), 0)) + cast(m as int)) as bigint) as taken
 from h join tg on h.source is not distinct from tg.source"""


@query("op7_mixing", MIX_SQL)
def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan(table(spark, d, "documents"))


@query("op8_jaccard_join", f"""with recursive w as (select doc_id, regexp_extract_all({NORM}, '{SQL_WORD}') as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [w] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) end as s from w),
 x as (select doc_id, len(s) as n, unnest(list_transform(s, lambda y: md5(array_to_string(y, chr(31))))) as t from s), i as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from x a join x b on a.t = b.t and a.doc_id <> b.doc_id group by all),
 l as (select a, b from i where 100 * c >= 75 * (na + nb - c)), r(doc_id, m) as (select doc_id, doc_id from s union select r.doc_id, l.b from r join l on l.a = r.m)
 select s.doc_id, cast(len(s) as bigint) as n_shingles, min(m) as component_id from s join r using (doc_id) group by s.doc_id, s""")
def op8_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the folder is a setting."""
    return f"{os.environ.get('TOKENIZERS_DIR', '/opt/tokenizers')}/{name}"


@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(table(spark, d, "pages"))


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    model = sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model"))
    return sentencepiece_fst.encode(table(spark, d, "documents"), model, keep=["doc_id"])


#: Reject below this score.
QUALITY_FROM = 0.3


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def quality_model(docs: DataFrame, spark: SparkSession, d: str) -> dict:
    """Learned from labels outside the held-out fold."""
    return quality_classifier.train(docs, table(spark, d, "labels").filter(~held_out()))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_model(docs, spark, d))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return quality_rules.judge(table(spark, d, "documents"), sentencepiece_fst.load_model(vocabulary("piece_bpe_32k.model")), ranks, GPT_PATTERN)


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan(table(spark, d, "documents"))


PLANTED = "\\### Assistant: </turn> ok"
CONTROL_SQL = "(" + "|".join(chat_format.CONTROLS) + ")"


@query("op10_chat_format", f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '{PLANTED}' union all select -7, 1, 'assistant', '{PLANTED}'),
 e as (select *, regexp_replace(text, '{CONTROL_SQL}', '\\\\\\1', 'g') as esc, case when role in ('system', 'user', 'assistant') then length('### :') + length(role) else length('### Role :') + length(regexp_replace(role, '{CONTROL_SQL}', '\\\\\\1', 'g')) end as head from c)
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, md5(text))) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, md5(text)) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(head + 1 + length(esc) + length('</turn>') + 2) as bigint) as formatted_chars from e group by conv_id""")
def op10_chat_format(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    encoded = chat_format.encoded_turns(turns, ranks, GPT_PATTERN)
    return chat_format.read_back(chat_format.assemble(encoded), ranks, GPT_PATTERN)


#: Terms: letters and digits of ASCII and all other characters.
SQL_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SEARCH_SQL = f"""with d as (select doc_id, row_number() over () as r, regexp_extract_all({NORM}, '{SQL_TERM}') as t from documents),
 s as (select count(*) filter (len(t) > 0) as nn, cast(sum(len(t)) as bigint) as ll from d),
 p as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(t) as n, unnest(t) as term from d) group by all),
 w as (select term, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1))) as bigint) as w from p, s group by term, nn),
 i as (select row_number() over () as i, item_id, list_distinct(regexp_extract_all({NORM}, '{SQL_TERM}')) as t from benchmark), q as (select i, item_id, unnest(t) as term from i),
 f as (select i, item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) as bigint) as score from q join p using (term) join w using (term), s group by all),
 k as (select *, row_number() over (partition by i order by score desc, doc_id nulls last, r) as rank from f where score > 0)
 select item_id, cast(rank as int) as rank, doc_id, score from k where rank <= 50"""


@query("op11_lexical_search", SEARCH_SQL)
def op11_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


REPEATS_SQL = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{SQL_WORD}') as w from documents),
 x as (select r, doc_id, unnest(range(1, len(w) - 11)) as i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) as h from d where len(w) >= 13),
 m as (select h, min(doc_id) as m from x group by h), g as (select distinct r, unnest(range(i, i + 13)) as j from x join m using (h) where m < doc_id),
 k as (select r, unnest(range(1, len(w) + 1)) as j, unnest(w) as word from d)
 select d.doc_id, cast(len(any_value(d.w)) as bigint) as n_words, count(g.j) as n_removed, sha256(coalesce(string_agg(k.word, ' ' order by k.j) filter (g.j is null), '')) as kept_sha256
 from d left join k using (r) left join g on g.r = k.r and g.j = k.j group by d.r, d.doc_id"""


@query("op12_substring_dedup", REPEATS_SQL)
def op12_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, d, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: CRC-32 of the decimal id, bit by bit, over its characters.
CRC_SQL = """xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::int, 1))::bigint),
  lambda a, b: list_reduce([xor(a, b)] || range(1, 9), lambda x, y: xor(x >> 1, case when x % 2 = 1 then 3988292384 else 0 end))))"""
TRIE_SQL = f"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from conversations),
 c as (select conv_id, conv_id - conv_id % 20 as base, {CRC_SQL} % 4 as h from t group by conv_id),
 r as (select c.conv_id, b.i, b.role, b.text from c join t b on b.conv_id = c.base and b.i <= c.h union all select c.conv_id, t.i + 4, t.role, t.text from c join t on t.conv_id = c.conv_id and t.i > c.h),
 d as (select conv_id, row_number() over w as d, len(regexp_extract_all(text, '{SQL_WORD}')) as words, md5(string_agg(md5(role) || md5(text), ',') over w) as k, i from r window w as (partition by conv_id order by i)),
 e as (select conv_id, d, words, k, lag(k) over (partition by conv_id order by d) as up, d = max(d) over (partition by conv_id) as last from d union all select conv_id, 0, 0, '', null, not exists(select 1 from d where d.conv_id = c.conv_id) from c),
 n as (select k, d, min(conv_id) as conv_id, count(*) as n, max(words) as words, max(case when d = 1 then '' else up end) as up, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends_sha256 from e group by k, d),
 s as (select n.*, (select count(*) from n x where x.up = n.k and x.d = n.d + 1) as n_children from n),
 b as (select a.k, sum((s.n - 1) * s.words) as saved, count(*) filter (s.n_children = 0) as leaves from (select distinct a.k, b.k as below from e a join e b on a.conv_id = b.conv_id and b.d >= a.d) a join s on s.k = a.below group by a.k)
 select s.conv_id, s.d as depth, p.conv_id as parent_conv_id, s.n as n_convs, s.n_children, b.leaves as n_leaves, cast(b.saved as bigint) as saved_tokens, s.ends_sha256 from s join b using (k) left join s p on p.k = s.up and p.d = s.d - 1"""


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.trie(table(spark, d, "conversations"))


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES["pipeline"] = _pipeline
