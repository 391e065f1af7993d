"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.llm.decontaminate import contaminated
from habitus.llm.html_text import html_text
from habitus.llm.jaccard_join import jaccard_components
from habitus.llm.mixing import mix
from habitus.llm.pivot_clusters import pivot_clusters
from habitus.llm.prefix_trie import prefix_trie
from habitus.llm.quality_classifier import quality_scores
from habitus.llm.quality_rules import quality_rules
from habitus.llm.secrets import secret_scan
from habitus.llm.tables import shared_folder, table, written
from habitus.llm.token_counts import token_counts
from habitus.llm.toxicity import toxicity
from habitus.llm.url_filter import RULE, url_verdicts
from habitus.llm.warc import read_records, write_archives

QUERIES: dict = {}
ORACLES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(0))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 4) == 2
    scores, _ = toxicity(docs, labels, ~held, written)
    return scores.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 3) == 1
    scores, _ = quality_scores(docs, labels, ~held, written)
    return scores.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, _ = mix(table(spark, sf_dir, "documents"), written)
    return documents.select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark)
    index = written(write_archives(pages, f"{folder}/archives"), "index")
    kind = pages.schema["page_id"].dataType
    return read_records(index, f"{folder}/archives", payloads=False).select(
        F.when(F.col("page_id") != "None", F.col("page_id")).cast(kind).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


ORACLES["op5_warc"] = """
with hashed as (
    select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h,
           min(page_id) over (partition by coalesce(html, '')) as first
    from pages
)
select page_id, strlen(body) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + cast(((cast('0x' || substr(h, 1 + 5 * cast(i // 4 as integer), 5) as bigint)
               >> (15 - 5 * (i % 4))) & 31) as integer), 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from hashed
"""


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"), written)


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), written)


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), written
    ).drop("key")


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


ORACLES["op6_quality_rules"] = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
    select doc_id, t,
           list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
    from d
),
grams as (
    select doc_id, i, array_to_string(ws[i:i + 4], ' ') as gram
    from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
),
twice as (select doc_id, gram from grams group by all having count(*) > 1),
covered as (
    select doc_id, count(distinct i + k) as n
    from grams join twice using (doc_id, gram), (select unnest(range(0, 5)) as k)
    group by doc_id
),
m as (
    select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
           len(ls) - len(list_distinct(ls)) as n_dup_lines,
           coalesce(c.n, 0) as n_repeat_words,
           length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_upper,
           length(regexp_replace(t, '[^!]+', '', 'g')) as n_exclaimed,
           len(list_filter(ws, lambda x: lower(x) in (
               'the','of','and','to','in','is','that','it','for','was','on','as','with','be','by',
               'at','this','from','or','an','are','not','le','la','les','de','des','du','un','une',
               'et','est','en','que','qui','dans','pour','pas','sur','au','avec','par','il','elle',
               'der','die','das','und','ist','von','zu','den','mit','im','nicht','ein','eine','auf',
               'dem','sich','es','als','auch','el','los','las','y','del','se','por','con','para',
               'su','al','lo','como','más','o','pero','sus'))) as n_stop,
           len(ls) as n_lines,
           len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) as n_bullets,
           len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) as n_cut_lines
    from w left join covered c using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
       and not (word_chars / n_words < 1.5 or word_chars / n_words > 15)
       and not n_symbols / n_words > 0.25
       and not (n_words >= 50 and n_stop / n_words < 0.01)
       and not (word_chars >= 50 and n_upper / word_chars > 0.5)
       and not n_exclaimed / n_words > 0.6
       and not (n_lines >= 4 and (n_dup_lines / n_lines > 0.5 or n_bullets / n_lines > 0.9
                                  or n_cut_lines / n_lines > 0.5)) as kept
from m
"""

ORACLES["op9_ngram_jaccard"] = r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
    from documents
),
s as (
    select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as gram
    from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (
    select a.doc_id as x, b.doc_id as y, count(*) as c
    from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by all
),
l as (
    select x, y from c join n nx on nx.doc_id = x join n ny on ny.doc_id = y
    where 100 * c >= 80 * (nx.n + ny.n - c)
),
way as (select x, y from l union all select y, x from l),
reach(doc_id, r) as (
    select doc_id, doc_id from documents
    union
    select reach.doc_id, way.y from reach join way on way.x = reach.r
)
select doc_id, coalesce(max(n), 0) as n_shingles, min(r) as component_id
from reach left join n using (doc_id) group by doc_id
"""


#: Fixed rules of the query; the operator takes any table of them.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, RULE)
    return url_verdicts(table(spark, sf_dir, "pages"), rules, written)


ORACLES["op11_url_filters"] = r"""
with rules(rule_host, rule_path, verdict) as (values
    ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest as (
    select page_id, row_number() over () as n,
           case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r
    from pages
),
hosts as (select page_id, n, r, regexp_extract(r, '^[^/?#]*') as h from rest),
parts as (
    select page_id, n, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(substr(r, length(h) + 1), '^[^?#]*') as path
    from hosts
),
best as (
    select n, max(struct_pack(len := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := verdict)) as b
    from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
    group by n
)
select page_id, host, path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict
from parts left join best using (n)
"""


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = pivot_clusters(table(spark, sf_dir, "embeddings"), written)
    return rows.drop("n_measured")


def _round_sql(k: int) -> str:
    """Assignment to the centroids c{k} and, from it, the next centroids."""
    return f"""
d{k} as (
    select v.vec_id, c.cluster, cast(sum((v.x - c.x) * (v.x - c.x)) as bigint) as distance
    from v join c{k} c using (place) group by all
),
a{k} as (select vec_id, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d{k} group by vec_id),
m{k} as (
    select a.cluster, v.place, sum(v.x) as s, count(*) as n from a{k} a join v using (vec_id) group by all
),
c{k + 1} as (
    select c.cluster, c.place,
           case when n is null then c.x else cast((s - ((s % n) + n) % n) // n as bigint) end as x
    from c{k} c left join m{k} using (cluster, place)
)"""


ORACLES["op12_centroid_clusters"] = f"""
with kept as (
    select vec_id, embedding from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
),
v as (
    select vec_id, unnest(range(1, 65)) as place,
           unnest(list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))) as x
    from kept
),
seeds as (
    select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster
    from kept order by sha256('1:' || vec_id) limit 16
),
c0 as (select cluster, place, x from seeds join v using (vec_id)),
{",".join(_round_sql(k) for k in range(4))},
digests as (select cluster, sha256(string_agg(cast(x as varchar), ',' order by place)) as centroid_sha256 from c3 group by cluster)
select vec_id, cast(cluster as integer) as cluster, distance,
       cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia, centroid_sha256
from a3 join digests using (cluster)
"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), written)


CRC32_SQL = """
crc_table as (
    with recursive bits(byte, step, value) as (
        select byte, 0, byte::bigint from (select unnest(range(0, 256)) as byte)
        union all
        select byte, step + 1, case when value & 1 = 1 then xor(value >> 1, 3988292384) else value >> 1 end
        from bits where step < 8
    )
    select list(value order by byte) as crcs from bits where step = 8
)"""

ORACLES["op13_conversation_trie"] = f"""
with {CRC32_SQL},
own as (
    select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
           order by turn nulls first,
                    sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
    from conversations where conv_id is not null group by conv_id
),
heads as (
    select own.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
               string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
               lambda acc, ch: xor(acc >> 8, crcs[1 + (xor(acc, ch) & 255)])), 4294967295::bigint) % 9 as h
    from own, crc_table
),
built as (
    select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns
    from heads c left join own b on b.conv_id = c.conv_id - c.conv_id % 5
),
paths as (
    select conv_id, d as depth, turns[1:d] as prefix, len(turns) as length
    from (select *, unnest(range(0, len(turns) + 1)) as d from built)
),
nodes as (
    select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs,
           case when depth = 0 then 0 else strlen(prefix[depth].t) end as bytes,
           sha256(coalesce(string_agg(case when length = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
    from paths group by prefix, depth
),
numbered as (
    select *, row_number() over () as node from nodes
),
named as (select p.conv_id as member, p.depth, n.node from paths p join numbered n on n.prefix = p.prefix and n.depth = p.depth),
kids as (
    select above.node, count(distinct below.node) as n_children
    from named above join named below on below.member = above.member and below.depth = above.depth + 1 group by 1
),
family as (
    select distinct above.node as top, below.node as node
    from named above join named below on below.member = above.member and below.depth >= above.depth
),
sums as (
    select f.top as node, count(*) filter (where n_children is null) as n_leaves,
           cast(sum((n_convs - 1) * bytes) as bigint) as saved_tokens
    from family f join numbered n on n.node = f.node left join kids k on k.node = f.node group by 1
),
parents as (
    select distinct below.node, a.conv_id as parent_conv_id
    from named below join named above on below.member = above.member and below.depth = above.depth + 1
    join numbered a on a.node = above.node
)
select n.conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, ends_sha256
from numbered n join sums using (node) left join kids using (node) left join parents using (node)
"""
