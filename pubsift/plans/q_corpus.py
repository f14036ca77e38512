"""Registered queries: versions, hygiene, ids, splits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubsift.operators import corpus as C
from pubsift.plans.catalog import query
from pubsift.plans.common import normalize
from pubsift.sources import tables as T

SEED = "42"


@query("latest_version", oracle="""
select pmid, cast(case when n_copies > 1 then version end as bigint) as version, title, content,
       date, cast(file_pos as bigint) as file_pos, cast(article_pos as bigint) as article_pos,
       n_copies, warn
from (select *, row_number() over (partition by pmid order by file_pos desc, article_pos desc) as rn,
             count(*) over (partition by pmid) as n_copies,
             max(n_v) over (partition by pmid) > 1 as warn
      from (select *, count(*) over (partition by pmid, file_pos, version) as n_v from articles_versions) v) w
where rn = 1""")
def q_latest_version(spark, sf_dir):
    return normalize(C.latest_version(T.articles_versions(spark, sf_dir)))


@query("first_per_id", oracle="""
select pmid, cast(version as bigint) as version, title, date from (
  select *, row_number() over (partition by pmid order by file_pos, article_pos) as rn
  from articles_versions) v where rn = 1""")
def q_first_per_id(spark, sf_dir):
    v = T.articles_versions(spark, sf_dir).select("pmid", "version", "title", "date",
                                                   "file_pos", "article_pos")
    return normalize(C.first_per_id(v, ["file_pos", "article_pos"])
                     .select("pmid", "version", "title", "date"))


@query("drop_missing_text", oracle="""
select pmid from articles
where not (title is null or trim(title) = '' or content is null or trim(content) = '')""")
def q_drop_missing_text(spark, sf_dir):
    return C.drop_missing_text(T.articles(spark, sf_dir)).select("pmid")


@query("quality_counts", oracle="""
select count(*) as n_rows, count(distinct pmid) as n_ids,
       count(*) - count(distinct pmid) as n_duplicates,
       count(*) filter (where title is null or trim(title) = '' or content is null
                        or trim(content) = '') as n_missing
from articles_versions""")
def q_quality_counts(spark, sf_dir):
    return C.quality_counts(T.articles_versions(spark, sf_dir))


@query("duplicate_ids", oracle="""
select pmid, count(*) as n, count(*) > 2 as more_than_twice
from articles_versions group by pmid having count(*) > 1""")
def q_duplicate_ids(spark, sf_dir):
    return C.duplicate_ids(T.articles_versions(spark, sf_dir))


@query("title_into_content", oracle="""
select pmid, concat_ws(' ', title, content) as content from articles""")
def q_title_into_content(spark, sf_dir):
    return C.title_into_content(T.articles(spark, sf_dir)).select("pmid", "content")


@query("filter_date_range", oracle="""
select pmid, date from articles
where date between try_strptime('2000/02/29', '%Y/%m/%d')::date
               and try_strptime('2009/12/31', '%Y/%m/%d')::date""")
def q_filter_date_range(spark, sf_dir):
    return C.filter_date_range(T.articles(spark, sf_dir), "2000/02/29", "2009/12/31") \
        .select("pmid", "date")


@query("count_by_period", oracle="""
select cast(year(date) as bigint) as year, count(*) as n from articles group by 1""")
def q_count_by_period(spark, sf_dir):
    return normalize(C.count_by_period(T.articles(spark, sf_dir)))


@query("id_ranges", oracle="""
select pmid from articles_versions where year(date) between 1995 and 2004""")
def q_id_ranges(spark, sf_dir):
    return C.id_ranges(T.articles_versions(spark, sf_dir), 1995, 2004)


@query("max_id", oracle="select max(pmid) as max_id from articles")
def q_max_id(spark, sf_dir):
    return C.max_id(T.articles(spark, sf_dir))


@query("assign_ids", oracle="""
select conv_id, turn,
       (select max(pmid) from articles) + row_number() over (order by conv_id, turn) as pmid
from conversations""")
def q_assign_ids(spark, sf_dir):
    conv = T.read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return C.assign_ids(conv, T.articles(spark, sf_dir), ["conv_id", "turn"])


@query("batch_ids", oracle="""
select pmid, cast(floor((row_number() over (order by pmid) - 1) / 100) as bigint) as batch,
       cast(floor((row_number() over (order by pmid) - 1) / 1000) as bigint) as "group"
from articles""")
def q_batch_ids(spark, sf_dir):
    return normalize(C.batch_ids(T.articles(spark, sf_dir)))


_SPLIT_SQL = """
select pmid, meshid, case when row_number() over (partition by meshid order by md5('42' || cast(pmid as varchar)), pmid)
                         <= ceil(count(*) over (partition by meshid) * 0.25) then 'test' else 'train' end as split
from mesh"""


@query("train_test_split", oracle="""
select pmid, case when row_number() over (order by md5('42' || cast(pmid as varchar)), pmid)
                      <= ceil(count(*) over () * 0.25) then 'test' else 'train' end as split
from articles""")
def q_train_test_split(spark, sf_dir):
    return C.train_test_split(T.articles(spark, sf_dir).select("pmid"), 0.25, SEED)


@query("corpus_sizes", oracle=f"""
select meshid as corpus, count(*) filter (where split = 'train') as trainlen,
       count(*) filter (where split = 'test') as testlen
from ({_SPLIT_SQL}) s group by meshid""")
def q_corpus_sizes(spark, sf_dir):
    s = C.train_test_split(T.mesh(spark, sf_dir), 0.25, SEED, group="meshid")
    return s.groupBy(F.col("meshid").alias("corpus")).agg(
        F.count_if(F.col("split") == "train").alias("trainlen"),
        F.count_if(F.col("split") == "test").alias("testlen"))


@query("pool_corpora", oracle=f"""
with s as ({_SPLIT_SQL}),
train as (select distinct pmid from s where split = 'train')
select pmid, 'train' as role from train
union all
select distinct pmid, 'test' from s where split = 'test' and pmid not in (select pmid from train)""")
def q_pool_corpora(spark, sf_dir):
    s = C.train_test_split(T.mesh(spark, sf_dir), 0.25, SEED, group="meshid")
    return C.pool_corpora(s)


@query("corpus_overlap", oracle="""
select a.meshid as corpus_i, b.meshid as corpus_j,
       round(count(*) / any_value(n.n_i), 6) as overlap
from mesh a join mesh b on a.pmid = b.pmid and a.meshid <> b.meshid
join (select meshid, count(*) as n_i from mesh group by meshid) n on n.meshid = a.meshid
group by a.meshid, b.meshid""")
def q_corpus_overlap(spark, sf_dir):
    m = T.mesh(spark, sf_dir).withColumnRenamed("meshid", "corpus")
    return normalize(C.corpus_overlap(m))


@query("largest_overlap", oracle="""
select corpus_i, max(overlap) as max_overlap from (
  select a.meshid as corpus_i, b.meshid as corpus_j,
         round(count(*) / any_value(n.n_i), 6) as overlap
  from mesh a join mesh b on a.pmid = b.pmid and a.meshid <> b.meshid
  join (select meshid, count(*) as n_i from mesh group by meshid) n on n.meshid = a.meshid
  group by a.meshid, b.meshid) o group by corpus_i""")
def q_largest_overlap(spark, sf_dir):
    m = T.mesh(spark, sf_dir).withColumnRenamed("meshid", "corpus")
    return normalize(C.largest_overlap(normalize(C.corpus_overlap(m))))


@query("downsample_corpora", oracle="""
with o as (select meshid, pmid,
                  row_number() over (partition by meshid order by md5('42' || cast(pmid as varchar)), pmid) as o,
                  count(*) over (partition by meshid) as size
           from mesh),
t as (select distinct count(*) as target from mesh group by meshid)
select o.meshid as corpus, t.target as sample_size, o.pmid
from o join t on t.target < o.size where o.o <= t.target""")
def q_downsample_corpora(spark, sf_dir):
    m = T.mesh(spark, sf_dir).withColumnRenamed("meshid", "corpus")
    return C.downsample_corpora(m, seed=SEED)


@query("scale_range", oracle="""
select meshid, n, round(20 + (n - min(n) over ()) * 80.0 / nullif(max(n) over () - min(n) over (), 0), 6)
       as scaled
from (select meshid, count(*) as n from mesh group by meshid) c""")
def q_scale_range(spark, sf_dir):
    c = T.mesh(spark, sf_dir).groupBy("meshid").agg(F.count(F.lit(1)).alias("n"))
    return normalize(C.scale_range(c, "n"))


@query("union_distinct_ids", oracle="""
select pmid from articles where lang = 'en' union select doc_id from labels""")
def q_union_distinct_ids(spark, sf_dir):
    en = T.articles(spark, sf_dir).where("lang = 'en'")
    lab = T.read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "pmid")
    return C.union_distinct_ids(en, lab)


@query("intersect_ids", oracle="""
select pmid from mesh where meshid = 'L_en' intersect select pmid from mesh where meshid = 'Q_high'""")
def q_intersect_ids(spark, sf_dir):
    m = T.mesh(spark, sf_dir)
    return C.intersect_ids(m.where("meshid = 'L_en'"), m.where("meshid = 'Q_high'"))


@query("exclude_ids", oracle="""
select pmid, title from articles
where pmid not in (select doc_id from labels where toxic = 1)""")
def q_exclude_ids(spark, sf_dir):
    lab = T.read_table(spark, sf_dir, "labels").where("toxic = 1") \
        .select(F.col("doc_id").alias("pmid"))
    return C.exclude_ids(T.articles(spark, sf_dir), lab).select("pmid", "title")


@query("fetch_articles", oracle="""
select l.pmid, a.title, a.date, a.pmid is not null as found
from (select distinct doc_id as pmid from labels where quality = 1
      union select distinct doc_id + 1000000 from labels where toxic = 1) l
left join articles a on a.pmid = l.pmid""")
def q_fetch_articles(spark, sf_dir):
    lab = T.read_table(spark, sf_dir, "labels")
    ids = (lab.where("quality = 1").select(F.col("doc_id").alias("pmid"))
           .union(lab.where("toxic = 1").select((F.col("doc_id") + 1000000).alias("pmid"))))
    a = T.articles(spark, sf_dir).select("pmid", "title", "date")
    return C.fetch_articles(a, ids)


@query("sample_files", oracle="""
select source as file from (select distinct source from documents) d
order by md5('42' || source), source limit 5""")
def q_sample_files(spark, sf_dir):
    files = T.read_table(spark, sf_dir, "documents").select(F.col("source").alias("file"))
    return C.sample_files(files, 5, SEED)
