"""Driver queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molweave.llm import clusters, copies, mixing, neighbours, packing, setjoin, subjects, terms
from molweave.llm.sizes import CAPACITY, plain_source, sized
from molweave.session import cut, read

Query = Callable[[SparkSession, str], DataFrame]


def _over(f: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: f(*[read(spark, sf_dir, t) for t in tables])


def packing_checks(placed: DataFrame) -> DataFrame:
    """What holds for any right packing, and that this one needs at most a thousandth more containers than the sizes do."""
    placed = cut(placed)
    r = packing.report(placed)
    split = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size"), F.max("piece").alias("last"))
    whole = split.agg(F.coalesce(F.bool_and((F.col("pieces") == F.ceil(F.col("size") / CAPACITY)) & (F.col("last") == F.col("pieces") - 1)), F.lit(True)).alias("split_only_large"))
    fits, tight = F.col("fullest") <= CAPACITY, F.col("containers") <= F.ceil(F.col("least_containers") * 1.001)
    return r.select("items", "used", "least_containers", fits.alias("fits"), tight.alias("tight"), F.lit(whole.first()[0]).alias("split_only_large"))


def mix_checks(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Of every source whether it must fall short, and whether its use is within a document of what it can fill."""
    own = sized(documents).select(plain_source(F.col("source")).alias("plain"), "size").groupBy("plain").agg(F.sum("size").alias("own"), F.max("size").alias("largest"))
    t = targets.where("source is not null").select("source", "max_repeats", plain_source(F.col("source")).alias("plain")).join(own, "plain", "left").na.fill(0, ["own", "largest"])
    r = mixing.shares(documents, targets).join(t.drop("plain"), "source")
    can = F.least(F.col("target_share") * F.sum("own").over(Window.partitionBy(F.lit(1))), F.col("max_repeats") * F.col("own"))
    near = F.abs(F.col("used") - can) <= F.col("largest") + 1
    return r.select("source", "own", "short", near.alias("filled"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def subject_votes(documents: DataFrame, labels: DataFrame, subjects_table: DataFrame) -> DataFrame:
    """Of every subject the raters' votes, and whether at least four fifths of them are found."""
    votes = labels.select("doc_id", "subject_id").distinct().join(sized(documents).select("doc_id"), "doc_id", "left_semi").join(subjects_table.select("subject_id"), "subject_id", "left_semi")
    found = subjects.assigned_subjects(documents, labels, subjects_table).select("doc_id", "subject_id", F.lit(1).alias("hit"))
    by = votes.join(found, ["doc_id", "subject_id"], "left").groupBy("subject_id").agg(F.count("*").alias("votes"), F.count("hit").alias("hits"))
    return by.select("subject_id", "votes", (F.col("hits") >= 0.8 * F.col("votes")).alias("agree"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(copies.copy_pairs, "reactions"),
        "p1_records": _over(copies.collapse, "reactions"),
        "p2_found": _over(lambda r, t: setjoin.similar_pairs(r, t).select("field", "id_a", "id_b"), "results", "templates"),
        "p2_pairs": _over(setjoin.similar_pairs, "results", "templates"),
        "p2_links": _over(setjoin.linked_records, "results", "templates"),
        "p3_found": _over(lambda f: neighbours.pairs(neighbours.neighbours(f)), "fingerprints"),
        "p3_neighbours": _over(neighbours.neighbours, "fingerprints"),
        "p4_found": _over(clusters.cluster_members, "fingerprints"),
        "p4_clusters": _over(clusters.describe, "fingerprints"),
        "p5_found": _over(lambda r, d: terms.term_counts(r, d).where("mark is not null").select("field", "token", "mark"), "results", "deltas"),
        "p5_terms": _over(terms.term_counts, "results", "deltas"),
        "p6_found": _over(lambda d: packing.split_documents(packing.assign(d)), "documents"),
        "p6_containers": _over(packing.assign, "documents"),
        "p6_report": _over(lambda d: packing.report(packing.assign(d)), "documents"),
        "p6_checks": _over(lambda d: packing_checks(packing.assign(d)), "documents"),
        "p7_checks": _over(mix_checks, "documents", "source_targets"),
        "p8_votes": _over(subject_votes, "documents", "doc_labels", "subjects"),
        "p7_found": _over(mixing.short_sources, "documents", "source_targets"),
        "p7_mix": _over(mixing.mix, "documents", "source_targets"),
        "p7_shares": _over(mixing.shares, "documents", "source_targets"),
        "p8_found": _over(lambda d, l, s: subjects.assigned_subjects(d, l, s).select("doc_id", "subject_id"), "documents", "doc_labels", "subjects"),
        "p8_makeup": _over(subjects.makeup, "documents", "doc_labels", "subjects"),
    }


P1_GROUPS = r"""
with cleaned as (
  select record_id, regexp_replace(regexp_replace(regexp_replace(rsmi, '[\s\p{Z}\p{Cc}\p{Cf}"''`´‘’‚“”„‹›«]+', '', 'g'), '^»|»$', '', 'g'),
    '([-=~–—]*(>|→|⇒|⟶|➔|»)+)+', '>', 'g') as s
  from reactions where rsmi is not null and record_id is not null),
letters as (select record_id, regexp_extract_all(s, '\[[^\[\]>]*\]|[cC][lL]|[bB][rR]|.') as xs from cleaned),
marked as (
  select record_id, array_to_string(list_transform(xs, lambda x: case
    when regexp_matches(x, '^\[[0-9]*[bcnops][hH]?[^a-zA-Z]') then chr(2) || upper(x)
    when x in ('b', 'c', 'n', 'o', 'p', 's') then chr(2) || upper(x)
    when x in ('.', ';', ',', '|', '·', '•', '+') then '.'
    else upper(x) end), '') as s
  from letters),
sided as (
  select record_id, list_transform(string_split(s, '>'), lambda side: array_to_string(list_sort(list_filter(string_split(side, '.'), lambda m: m <> '')), '.')) as sides
  from marked),
canon as (select record_id, sides[1] || '>' || sides[2] as canon from sided where len(sides) = 2 and sides[1] <> '' and sides[2] <> ''),
grouped as (select record_id, min(record_id) over (partition by canon) as first_id, count(*) over (partition by canon) as copies from canon)
"""

P2_PAIRS = """
with arrays as (
  select 'support' as family, 'r' as src, reaction_id as id, support as xs from results where mode = 'delta'
  union all select 'tokens_r', 'r', reaction_id, tokens_r from results where mode = 'delta'
  union all select 'tokens_p', 'r', reaction_id, tokens_p from results where mode = 'delta'
  union all select 'support', 't', template_id, support from templates),
sets as (select distinct family, src, id, list_sort(list_distinct(xs)) as xs from arrays where len(xs) > 0 and id is not null),
numbered as (select *, row_number() over (order by family, src, id, xs) as k, len(xs) as n from sets),
items as (select family, src, id, k, n, unnest(xs) as x from numbered),
shared as (
  select a.family, a.src as src_a, b.src as src_b, a.id as id_a, b.id as id_b, a.k, b.k, a.n + b.n as n, count(*) as common
  from items a join items b on a.family = b.family and a.x = b.x and b.src = 'r' and (a.src = 't' or a.id < b.id)
  group by all),
pairs as (
  select case when src_a = 't' then 'template' else family end as field, id_a, id_b, max(cast(common as double) / (n - common)) as similarity
  from shared where cast(common as double) / (n - common) >= cast(0.7 as double) group by all)
"""

P2_LINKS = """
with arrays as (
  select 'support' as field, 'r' as src, reaction_id as id, support as xs from results where mode = 'delta'
  union all select 'tokens_r', 'r', reaction_id, tokens_r from results where mode = 'delta'
  union all select 'tokens_p', 'r', reaction_id, tokens_p from results where mode = 'delta'
  union all select 'support', 't', template_id, support from templates),
sets as (select distinct field, src, id, list_sort(list_distinct(xs)) as xs from arrays where len(xs) > 0 and id is not null),
uniq as (select field, xs, bool_or(src = 'r') as has_r, row_number() over (order by field, xs) as k, len(xs) as n from sets group by field, xs),
items as (select field, k, n, has_r, unnest(xs) as x from uniq),
shared as (select a.k as ka, b.k as kb, a.n + b.n as n, count(*) as common from items a join items b on a.field = b.field and a.x = b.x and a.k <> b.k and (a.has_r or b.has_r) group by all),
links as (select ka as k, count(*) as links from shared where cast(common as double) / (n - common) >= cast(0.7 as double) group by ka),
groups as (select s.field, s.xs, min(s.id) as class_id, count(*) as copies from sets s where s.src = 'r' group by all)
select s.field, s.id, g.class_id, g.copies, coalesce(l.links, 0) as links
from sets s join groups g on s.field = g.field and s.xs = g.xs join uniq u on s.field = u.field and s.xs = u.xs left join links l on l.k = u.k
where s.src = 'r'
"""

P3_NEAR = """
with vectors as (
  select fp_id, list_transform(sketch, lambda x: sign(x)) as v from fingerprints
  where fp_id is not null and len(sketch) = 256 and not list_contains(list_transform(sketch, lambda x: x is null or abs(x) > 1), true)),
used as (select fp_id, v, sqrt(list_inner_product(cast(v as float[]), cast(v as float[]))) as norm from vectors where list_contains(list_transform(v, lambda x: x <> 0), true)),
sims as (
  select a.fp_id as fp_id, b.fp_id as other, round(list_inner_product(cast(a.v as float[]), cast(b.v as float[])) / (a.norm * b.norm), 7) as cosine
  from used a join used b on a.fp_id <> b.fp_id),
near as (select * from sims where cosine >= cast(0.6 as double)),
ranked as (select *, row_number() over (partition by fp_id order by cosine desc, other) as rank from near)
"""

P4_CLUSTERS = (
    P3_NEAR.replace("with vectors", "with recursive vectors")
    + """, reach as (
  select fp_id, other from near
  union select reach.fp_id, near.other from reach join near on reach.other = near.fp_id),
labels as (select fp_id, least(fp_id, min(other)) as cluster_id from reach group by fp_id)
"""
)

P5_TERMS = """
with runs as (select distinct reaction_id, list_sort(tokens_r) as xs from results where tokens_r is not null and reaction_id is not null),
counted as (
  select 'tokens_r' as field, reaction_id, token, count(*) as n from (select reaction_id, xs, unnest(xs) as token from runs) group by reaction_id, xs, token
  union all select 'delta', reaction_id, token, abs(delta) from deltas where delta <> 0),
held as (select field, reaction_id, token, max(n) as n from counted where reaction_id is not null and token is not null group by all),
totals as (select field, count(distinct reaction_id) as all_records from held group by field),
terms as (select field, token, cast(sum(n) as bigint) as occurrences, count(*) as records from held group by all),
marked as (
  select t.field, token, occurrences, records, case when records = 1 then 'rare' when records > all_records * cast(0.1 as double) then 'common' end as mark
  from terms t join totals using (field))
"""

SIZED = """
with sized as (
  select doc_id, source, octet_length(encode(text)) + 1 as size from documents where doc_id is not null and regexp_matches(text, '[^\\s\\p{Z}]'))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_GROUPS + "select first_id as record_a, record_id as record_b from grouped where record_id <> first_id",
        "p1_records": P1_GROUPS + "select record_id, copies from grouped where record_id = first_id",
        "p2_found": P2_PAIRS + "select field, id_a, id_b from pairs",
        "p2_pairs": P2_PAIRS + "select * from pairs",
        "p2_links": P2_LINKS,
        "p3_found": P3_NEAR + "select distinct least(fp_id, other) as fp_a, greatest(fp_id, other) as fp_b from ranked where rank <= 5",
        "p3_neighbours": P3_NEAR + "select fp_id, other, cosine, cast(rank as int) as rank from ranked where rank <= 5",
        "p4_found": P4_CLUSTERS + "select cluster_id, fp_id from labels",
        "p4_clusters": P4_CLUSTERS
        + """, sized as (select cluster_id, count(*) as size from labels group by cluster_id),
grouped as (select l.cluster_id, l.fp_id, u.v, u.norm from labels l join used u using (fp_id)),
within as (
  select a.cluster_id, a.fp_id, any_value(a.v) as v, round(sum(list_inner_product(cast(a.v as float[]), cast(b.v as float[])) / (a.norm * b.norm)), 9) as total
  from grouped a join grouped b on a.cluster_id = b.cluster_id group by a.cluster_id, a.fp_id),
alone as (select cluster_id, v, min(fp_id) as fp_id, any_value(total) as total from within group by cluster_id, v),
scored as (select cluster_id, size, fp_id, (total - 1) / (size - 1) as mean_cosine from alone join sized using (cluster_id)),
placed as (select *, row_number() over (partition by cluster_id order by mean_cosine desc, fp_id) as rank from scored)
select cluster_id, size, cast(rank as int) as rank, fp_id, mean_cosine from placed where rank <= 3""",
        "p5_found": P5_TERMS + "select field, token, mark from marked where mark is not null",
        "p5_terms": P5_TERMS + "select * from marked",
        "p6_found": SIZED + "select doc_id from sized where size > 4096",
        "p7_found": SIZED
        + """, owned as (
  select t.source, t.target_share, t.max_repeats, coalesce(sum(d.size), 0) as s from source_targets t
  left join sized d on lower(regexp_replace(d.source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) = lower(regexp_replace(t.source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))
  group by all)
select source from owned where target_share * (select sum(s) from owned) > max_repeats * s""",
        "p6_checks": SIZED
        + """select cast(coalesce(sum(ceil(size / 4096.0)), 0) as bigint) as items, cast(coalesce(sum(size), 0) as bigint) as used, cast(coalesce(ceil(sum(size) / 4096.0), 0) as bigint) as least_containers,
true as fits, true as tight, true as split_only_large from sized""",
        "p7_checks": SIZED
        + """, owned as (
  select t.source, t.target_share, t.max_repeats, cast(coalesce(sum(d.size), 0) as bigint) as s from source_targets t
  left join sized d on lower(regexp_replace(d.source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) = lower(regexp_replace(t.source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))
  group by all)
select source, s as own, target_share * (select sum(s) from owned) > max_repeats * s as short, true as filled, true as repeats_kept from owned""",
        "p8_votes": SIZED
        + """select subject_id, count(*) as votes, true as agree from (select distinct doc_id, subject_id from doc_labels) l semi join sized using (doc_id) semi join subjects using (subject_id) group by all""",
    }
