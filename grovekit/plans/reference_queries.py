"""Queries on graphs, counts, prompts and metrics over the driver's tables, each with its SQL where there is some."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import keys as K
from .. import models
from ..functions import text as T
from ..graph import TaxoGraph
from ..keys import table
from ..operators import cooccur, edges, metrics, motif, tables, traverse
from ..session import materialise
from . import tune
from .core_queries import category_links

QUERIES: dict = {}
SQL: dict[str, str] = {}
ROOT = T.ROOT
_SP = r"[\s\p{Z}\x1c-\x1f\x0b\x{85}]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- graphs made of the tables

_NATION = """g as (select n1.n_name as src, n2.n_name as dst, count(*)::double as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey join nation n1 on c_nationkey = n1.n_nationkey join nation n2 on s_nationkey = n2.n_nationkey group by 1, 2)"""
_PART = f"""e as (select distinct '{ROOT}' as src, 'B ' || p_brand as dst from part union select distinct 'B ' || p_brand, 'T ' || p_type from part union select distinct 'T ' || p_type, 'N ' || p_name from part)"""
_LINKS = """cats as (select * from (select *, row_number() over (partition by id order by fetched_at desc nulls last) rn from raw_categories where id is not null) where rn = 1),
  e as (select distinct id::varchar as src, s.id::varchar as dst from (select id, unnest(sub_categories) s from cats) where s.id is not null)"""
_LIN = "(select * from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from linearised_samples where id is not null) where rn = 1)"
_PAGES = "(select * from (select *, row_number() over (partition by id order by fetched_at desc nulls last) rn from raw_pages where id is not null) where rn = 1)"


def nation_graph(spark: SparkSession, d: str) -> DataFrame:
    """Customer nations to supplier nations, weighted by line items; line items are counted by keys before nations are joined."""
    t = lambda n: table(spark, d, n)
    c = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    li = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    x = li.join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.sum("n").alias("weight"))
    n = t("nation")
    x = x.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), "c_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst")), "s_nationkey")
    return x.select("src", "dst", F.col("weight").cast("double").alias("weight"))


def part_graph(spark: SparkSession, d: str) -> TaxoGraph:
    p = table(spark, d, "part")
    b, t, n = F.concat(F.lit("B "), "p_brand"), F.concat(F.lit("T "), "p_type"), F.concat(F.lit("N "), "p_name")
    e = p.select(F.explode(F.array(F.struct(F.lit(ROOT).alias("src"), b.alias("dst")), F.struct(b.alias("src"), t.alias("dst")), F.struct(t.alias("src"), n.alias("dst")))).alias("e")).select("e.*").distinct()
    return TaxoGraph.of_edges(e.withColumn("weight", F.lit(1.0)), ROOT)


def vector_edges(spark: SparkSession, d: str, odd: int) -> DataFrame:
    v = table(spark, d, "embeddings").where((F.col("vec_id") % 2 == odd) & (F.col("vec_id") > 1))
    return v.select(F.floor(F.col("vec_id") / 2).cast("long").cast("string").alias("src"), F.col("vec_id").cast("string").alias("dst"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("title"), F.col("embedding").alias("embed"))


# ---- text to edges

_PARSED = rf"""l as (select doc_id, trim(regexp_replace(x, '^{_SP}|{_SP}$', '', 'g')) as raw, regexp_replace(x, '^{_SP}|{_SP}$', '', 'g') as line from (select doc_id, unnest(string_split(text, chr(10))) x from documents)),
p as (select doc_id, line, string_split(line, ' -> ') as parts from l where line <> ''),
v as (select doc_id, parts, len(parts) >= 2 and parts[1] = '{ROOT}' and len(list_filter(parts[2:], lambda q: q = '' or contains(q, '->'))) = 0 as ok from p),
s as (select doc_id, parts[i] as src, parts[i + 1] as dst from (select doc_id, parts, unnest(range(1, len(parts))) i from v where ok))"""


@query(f"with {_PARSED} select src, dst, count(distinct doc_id)::double as weight from s group by 1, 2")
def parse_hierarchy_edges(spark, d):
    """Edges of all paths in documents, weighted by the documents that hold them."""
    rows = T.hierarchy_rows(table(spark, d, "documents"), "doc_id", "text").where("titles is not null")
    return edges.support(rows.select("doc_id", F.explode(T.steps(F.col("titles"))).alias("s")).select("doc_id", "s.*"), "doc_id")


@query(f"""with {_PARSED}, d as (select doc_id, bool_or(not ok) as bad, count(*) as n, count(*) filter (where not ok) as nb from v group by 1)
select count(*) as samples, count(*) filter (where bad) as invalid_samples, sum(n)::bigint as paths, sum(nb)::bigint as invalid_paths,
round(100.0 * count(*) filter (where bad) / count(*), 6)::double as invalid_samples_pct, round(100.0 * sum(nb) / sum(n), 6)::double as invalid_paths_pct from d""")
def parse_quality(spark, d):
    """How many documents and lines are no paths; nulls where there are none."""
    rows = T.hierarchy_rows(table(spark, d, "documents"), "doc_id", "text")
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("titles").isNull(), 1)).alias("nb"))
    t = per.agg(F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("nb") > 0, 1)).alias("invalid_samples"), F.sum("n").alias("paths"), F.sum("nb").alias("invalid_paths"))
    pct = lambda a, b: F.round(F.try_divide(F.lit(100.0) * F.col(a), F.col(b)), 6)
    return t.select("*", pct("invalid_samples", "samples").alias("invalid_samples_pct"), pct("invalid_paths", "paths").alias("invalid_paths_pct"))


@query("""with c as (select doc_id, trim(x, ' ' || chr(10) || chr(9) || '"'',.') as concept, i from (select doc_id, unnest(string_split(text, ',')) x, generate_subscripts(string_split(text, ','), 1) i from documents where kind = 'concepts'))
select concept, count(*) as cnt from c group by 1 order by cnt desc, min(doc_id * 100000 + i) limit 50""")
def concept_topk(spark, d):
    """The 50 concepts that occur most, ties by first appearance."""
    c = table(spark, d, "documents").where("kind = 'concepts'").select("doc_id", F.posexplode(T.concepts(F.col("text"))).alias("i", "concept"))
    return c.groupBy("concept").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("doc_id", "i")).alias("first")).orderBy(F.desc("cnt"), "first").limit(50).select("concept", "cnt")


_STEPS = f"""p as (select p from (select unnest(paths) p from {_LIN} l) where len(p) >= 2), s as (select p[i] as src, p[i + 1] as dst from (select p, unnest(range(1, len(p))) i from p))"""


def sample_steps(spark, d) -> DataFrame:
    rows = K.standing(table(spark, d, "linearised_samples").select("id", "ingested_at", "paths"), "id", "ingested_at", "paths")
    return rows.select(F.explode("paths").alias("p")).where("size(p) >= 2").select(F.explode(T.steps(F.col("p"))).alias("s")).select("s.*")


@query(f"with {_STEPS}, c as (select src, dst, count(*) as cnt from s group by 1, 2) select src, dst, cnt as count, round((select avg(cnt) from c) / cnt, 6) as weight from c")
def edge_weights_inverse_freq(spark, d):
    """Steps of all samples' paths, and the mean count over their own."""
    return edges.inverse_frequency(sample_steps(spark, d)).select("src", "dst", "count", F.round("weight", 6).alias("weight"))


@query(rf"""select count(*) as papers, count(clean) as cleaned, sum(length(clean))::bigint as chars from (select array_to_string(list_filter(list_transform(string_split(abstract, chr(10)), lambda x: regexp_replace(x, '^{_SP}|{_SP}$', '', 'g')), lambda x: x <> ''), ' ') as clean from papers_with_citations)""")
def clean_text(spark, d):
    """Abstracts with their lines stripped and joined."""
    return table(spark, d, "papers_with_citations").select(T.joined_lines(F.col("abstract")).alias("clean")).agg(F.count(F.lit(1)).alias("papers"), F.count("clean").alias("cleaned"), F.sum(F.length("clean")).alias("chars"))


_DATES = "coalesce(try_strptime(paper_date, '%Y-%m-%d %H:%M:%S'), try_strptime(paper_date, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(paper_date, '%Y-%m-%d'), try_strptime(regexp_replace(paper_date, '^\\s*[A-Za-z]+,\\s*', ''), '%d %b %Y %H:%M:%S GMT'))"


@query(f"select id, t as date from (select id, {_DATES} as t from papers_with_citations) where t between timestamp '2005-01-05' and timestamp '2005-01-20'")
def date_window_filter(spark, d):
    """Papers dated within both bounds, each at midnight."""
    c = F.col("paper_date")
    t = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd")], T.version_date(c))
    return table(spark, d, "papers_with_citations").select("id", t.alias("date")).where(F.col("date").between(F.lit("2005-01-05").cast("timestamp"), F.lit("2005-01-20").cast("timestamp")))


@query("select id, citation_count from papers_with_citations where citation_count >= 10")
def min_count_filter(spark, d):
    return table(spark, d, "papers_with_citations").where("citation_count >= 10").select("id", "citation_count")


@query(f"""with c as (select id, unnest(regexp_split_to_array(lower(e), '{_SP}')) c from (select id, unnest(categories) e from papers_with_citations) where e is not null)
select c as code, coalesce(lower(a.canonical), c) as canonical, count(*) as n from c left join category_aliases a on lower(a.alias) = c where c <> '' group by 1, 2""")
def alias_normalise(spark, d):
    """Codes as delivered and their canonical form."""
    c = table(spark, d, "papers_with_citations").select(F.explode("categories").alias("e")).where("e is not null").select(F.explode(F.split(F.lower("e"), K.SPACE)).alias("code")).where("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    a = table(spark, d, "category_aliases").select(F.lower("alias").alias("code"), F.lower("canonical").alias("c"))
    return c.join(a, "code", "left").select("code", F.coalesce("c", "code").alias("canonical"), "n")


# ---- joins of pages and categories

def _refs(spark, d):
    cats = K.standing(table(spark, d, "raw_categories").select("id", "fetched_at", "pages"), "id", "fetched_at", "pages")
    pages = K.standing(table(spark, d, "raw_pages"), "id", "fetched_at", "title", "abstract")
    return tables.node_pages(cats, pages)


_REFS = f"{_LINKS}, pg as (select * from {_PAGES} q), r as (select id as node_id, unnest(pages) as page_id, generate_subscripts(pages, 1) - 1 as pos from cats)"


@query(f"with {_REFS} select node_id, page_id, pos, title from r join pg on page_id = pg.id")
def node_pages_join(spark, d):
    return _refs(spark, d)[0].select("node_id", "page_id", "pos", "title")


@query(f"with {_REFS} select count(*) as missing from r where page_id is not null and page_id not in (select id from pg)")
def missing_pages(spark, d):
    return _refs(spark, d)[1].agg(F.count(F.lit(1)).alias("missing"))


@query(f"with {_REFS} select page_id, any_value(title) as title, array_to_string(list_sort(list(distinct node_id::varchar)), ',') as categories from r join pg on page_id = pg.id group by 1")
def pages_with_categories(spark, d):
    """Each page with the categories that list it."""
    x = tables.pages_with_categories(_refs(spark, d)[0].withColumn("node_id", F.col("node_id").cast("string")))
    return x.select("page_id", "title", F.array_join("categories", ",").alias("categories"))


@query(f"select id, title from {_PAGES} p where id not in (select unnest(pages) from raw_categories where pages is not null and len(pages) > 0 and list_position(pages, null) is null) and id not in (select p from (select unnest(pages) p from raw_categories) where p is not null)")
def resume_anti_join(spark, d):
    """Standing pages that no category lists, as if those listed were done."""
    done = table(spark, d, "raw_categories").select(F.explode("pages").alias("id"))
    pages = K.standing(table(spark, d, "raw_pages"), "id", "fetched_at", "title")
    return tables.not_done(pages, done, "id")


@query("select id, title, fetched_at from (select *, row_number() over (partition by id order by fetched_at, title) rn from raw_pages) where rn = 1")
def dedup_pages_first(spark, d):
    return tables.first_of_each(table(spark, d, "raw_pages").select("id", "title", "fetched_at"), "id", F.asc_nulls_last("fetched_at"), F.asc_nulls_last("title"))


@query(f"with p as (select row_number() over (order by id, coalesce(abstract, '')) - 1 as n, coalesce(abstract, '') as t from {_PAGES} q) select n // 1000 as batch, count(*) as texts, md5(string_agg(t, chr(10) order by n)) as digest from p group by 1")
def batch_text_groups(spark, d):
    """Abstracts in files of a thousand."""
    pages = K.standing(table(spark, d, "raw_pages"), "id", "fetched_at", "abstract")
    b = tables.text_batches(pages, "id", "abstract")
    n = pages.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return b.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").select("batch", F.least(F.lit(1000), F.col("n") - F.col("batch") * 1000).cast("long").alias("texts"), F.md5("text").alias("digest"))


# ---- pruning

@query(f"with {_NATION} select src, dst, weight from g where src <> dst")
def prune_self_loops(spark, d):
    return nation_graph(spark, d).where("src <> dst")


@query(f"with {_NATION} select a.src, a.dst from g a join g b on a.src = b.dst and a.dst = b.src where b.weight > a.weight")
def prune_inverse(spark, d):
    return edges.weaker_inverses(nation_graph(spark, d))


@query(f"with {_NATION} select src, dst from (select *, row_number() over (order by weight, src, dst) r, count(*) over () n from g) where r <= floor(0.3 * n)")
def prune_absolute(spark, d):
    return edges.below_percentile(nation_graph(spark, d), 0.3)


def _nucleus(p: float) -> str:
    return f"""h as (select *, row_number() over (partition by src order by weight desc, dst) n, weight / sum(weight) over (partition by src) sh from g),
k as (select *, sum(sh) over (partition by src order by n) run from h), x as (select src, coalesce(min(n) filter (where run > {p}), 1) c from k group by 1),
lim as (select k.src, weight as lim from k join x on k.src = x.src and k.n = x.c), nuc as (select k.src, k.dst from k join lim on k.src = lim.src where weight <= lim)"""


@query(f"with {_NATION}, {_nucleus(0.9)} select src, dst from nuc")
def prune_nucleus(spark, d):
    return edges.outside_nucleus(nation_graph(spark, d), 0.9)


_POST = f"""{_NATION}, {_nucleus(0.9)}, gone as (select src, dst from nuc union select src, dst from g where src = dst union select a.src, a.dst from g a join g b on a.src = b.dst and a.dst = b.src where b.weight > a.weight
  union select src, dst from (select *, row_number() over (order by weight, src, dst) r, count(*) over () n from g) where r <= floor(0.2 * n)),
kept as (select * from g where (src, dst) not in (select src, dst from gone)),
post as (select * from kept union all select '{ROOT}', id, 1.0 from (select src as id from kept union select dst from kept) where id not in (select dst from kept))"""


@query(f"with {_POST} select src, dst, weight from post")
def post_process(spark, d):
    """All four rules together, and a root for what is left without a parent."""
    return edges.post_process(nation_graph(spark, d), 0.2, 0.9)


@query(f"with {_LINKS}, n as (select src as id from e union select dst from e) select src, dst, 1.0::double as weight from e union all select '{ROOT}', id, 1.0 from n where id not in (select dst from e)")
def attach_root(spark, d):
    e = category_links(spark, d).withColumn("weight", F.lit(1.0))
    return edges.attach_root(e, TaxoGraph.of_edges(e).nodes)[0]


# ---- traversal

_DEEP = f"{_LINKS}, seeds as (select distinct src as id from e where src not in (select dst from e))"


def _category_seeds(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("id")).distinct().join(links.select(F.col("dst").alias("id")), "id", "left_anti")


@query(f"with recursive {_DEEP}, r as (select id, 0 as depth from seeds union select dst, depth + 1 from r join e on r.id = e.src where depth < (select count(*) from cats)) select id, min(depth) as depth from r group by 1")
def bfs_depth(spark, d):
    """Steps from the nearest category that has no parent."""
    links = category_links(spark, d)
    return traverse.bfs(links, _category_seeds(links))


@query(f"with recursive {_DEEP}, r as (select id, 0 as depth from seeds union select dst, depth + 1 from r join e on r.id = e.src where depth < 2), k as (select distinct id from r) select src, dst from e where src in (select id from k) and dst in (select id from k)")
def ego_subgraph(spark, d):
    """Links among what is within two steps of a category without parents."""
    links = materialise(category_links(spark, d), "links")
    g = TaxoGraph.of_edges(links.withColumn("weight", F.lit(1.0)))
    return g.induced(traverse.bfs(links, _category_seeds(links), 2)).edges.select("src", "dst")


_SPLIT = f"""{_PART}, lv as (select dst as id, row_number() over (order by md5(dst || '/0'), dst) r, count(*) over () n from e where src = '{ROOT}'),
sd as (select id, r <= floor(0.5 * n) as test from lv), reach as (select id, test from sd union select dst, test from reach join e on reach.id = e.src),
sides as (select distinct id, test from reach union select '{ROOT}', true union select '{ROOT}', false)"""


@query(f"with recursive {_SPLIT} select case when test then 'test' else 'train' end as side, src, dst from e join sides a on src = a.id join sides b on dst = b.id and a.test = b.test cross join (select 1) select_ where a.test = b.test".replace("select case when test", "select case when a.test").replace(" cross join (select 1) select_ where a.test = b.test", ""))
def split_train_test(spark, d):
    """Edges of both halves of the part taxonomy, brands dealt out."""
    test, train = traverse.depth_split(part_graph(spark, d), 1, 0.5)
    return test.edges.select(F.lit("test").alias("side"), "src", "dst").unionByName(train.edges.select(F.lit("train").alias("side"), "src", "dst"))


@query(f"""with recursive {_SPLIT}, dep as (select id, min(depth) as depth from (select '{ROOT}' as id, 0 as depth union all select dst, case when src = '{ROOT}' then 1 when src like 'B %' then 2 else 3 end from e) group by 1),
x as (select dep.id, depth, max(case when test then 1 else 0 end) a, max(case when not test then 1 else 0 end) b from dep left join sides on dep.id = sides.id group by 1, 2)
select depth, count(*) as nodes, round(avg(a), 6) as in_a, round(avg(b), 6) as in_b, round(avg(a * b), 6) as shared, round(avg(greatest(a, b)), 6) as covered from x group by 1""")
def split_coverage(spark, d):
    g = part_graph(spark, d)
    test, train = traverse.depth_split(g, 1, 0.5)
    dist = traverse.bfs(g.edges, g.nodes.where(F.col("id") == ROOT).select("id"))
    c = traverse.split_coverage(dist, test.nodes.select("id"), train.nodes.select("id"))
    return c.select("depth", "nodes", *[F.round(x, 6).alias(x) for x in ("in_a", "in_b", "shared", "covered")])


_PATHS = f"""{_PART}, sp as (select '{ROOT}' as node, ['{ROOT}'] as path union all select dst, list_append(path, dst) from sp join e on sp.node = e.src where len(path) < 4 and not list_contains(path, dst))"""


@query(f"with recursive {_PATHS} select node, array_to_string(path, ' -> ') as path from sp")
def simple_paths(spark, d):
    return traverse.simple_paths(part_graph(spark, d).edges, ROOT, 4).select("node", F.array_join("path", " -> ").alias("path"))


def _part_samples(spark, d):
    g = part_graph(spark, d)
    p = table(spark, d, "part")
    pages = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("abstract"))
    listed = p.select(F.concat(F.lit("T "), "p_type").alias("node_id"), F.col("p_partkey").cast("string").alias("page_id"))
    return traverse.linearise(TaxoGraph(g.nodes, g.edges, g.root, pages, listed), 4)


_LINED = f"""{_PATHS}, ls as (select p_partkey::varchar as id, list_sort(list(path)) as paths from part join sp on sp.node = 'T ' || p_type group by 1)"""


@query(f"with recursive {_LINED} select id, len(paths) as n_paths, md5(array_to_string(list_transform(paths, lambda p: array_to_string(p, ' -> ')), chr(10))) as digest from ls")
def linearise(spark, d):
    """Parts with all paths to their type."""
    return _part_samples(spark, d).select("id", F.size("paths").cast("long").alias("n_paths"), F.md5(F.array_join(F.transform("paths", lambda p: F.array_join(p, T.ARROW)), "\n")).alias("digest"))


@query(f"""with s as (select paths from {_LIN} l where paths is not null), v as (select 'paths' as what, len(paths) as v from s union all select 'titles', len(p) from (select unnest(paths) p from s) where p is not null)
select what, round(avg(v), 6) as mean, quantile_cont(v, 0.05)::double as p5, quantile_cont(v, 0.25)::double as p25, quantile_cont(v, 0.5)::double as p50, quantile_cont(v, 0.75)::double as p75, quantile_cont(v, 0.95)::double as p95 from v group by 1""")
def path_length_quantiles(spark, d):
    rows = K.standing(table(spark, d, "linearised_samples").select("id", "ingested_at", "paths"), "id", "ingested_at", "paths").where("paths is not null")
    rows = rows.select(F.col("paths"))
    return traverse.path_statistics(rows.select("paths")).where("what is not null").withColumn("mean", F.round("mean", 6))


@query(f"""with {_LINKS}, te as (select distinct a.title as src, b.title as dst from e join cats a on a.id::varchar = src join cats b on b.id::varchar = dst where a.title is not null and b.title is not null), {_STEPS}
select src, dst from te where (src, dst) not in (select src, dst from s where src is not null and dst is not null)""")
def uncovered_edges(spark, d):
    """Links between category titles that no sample's path takes."""
    t = K.standing(table(spark, d, "raw_categories"), "id", "fetched_at", "title").where("title is not null").select(F.col("id").cast("string").alias("id"), "title")
    g = TaxoGraph(t, category_links(spark, d).withColumn("weight", F.lit(1.0)))
    return traverse.uncovered_edges(g.titled_edges(), sample_steps(spark, d))


@query(f"""with r as (select 'R' || r_regionkey as id, r_name as title, '{ROOT}' as parent from region where r_name <> 'ASIA'), n as (select 'N' || n_nationkey as id, n_name as title, 'R' || n_regionkey as parent from nation),
s as (select 'S' || s_suppkey as id, s_name as title, 'N' || s_nationkey as parent from supplier) select parent as src, id as dst from (select * from r union all select * from n union all select * from s)""")
def taxonomy_union(spark, d):
    """Regions, nations and suppliers as groups, archives and categories; a test group is left out."""
    r = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), (F.col("r_name") == "ASIA").alias("is_test"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.lit(None).cast("boolean").alias("is_test"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("N"), "s_nationkey").alias("parent"))
    return traverse.taxonomy(ROOT, r, n, s).edges.select("src", "dst")


# ---- counts and scores

_EV = "c as (select user_id::varchar as l, event_type as r, count(*)::double as cnt from events group by 1, 2)"
_PPMI = f"""{_EV}, pp as (select l, r, cnt, greatest(0, ln(sum(cnt) over ()) + ln(cnt) - ln(sum(cnt) over (partition by l)) - ln(sum(cnt) over (partition by r))) as ppmi from c)"""


def event_counts(spark, d):
    return cooccur.counts(table(spark, d, "events").select(F.col("user_id").cast("string").alias("l"), F.col("event_type").alias("r")))


@query(f"with {_EV} select l, r, cnt from c")
def cooc_counts(spark, d):
    return event_counts(spark, d)


@query(f"with {_PPMI} select l, r, cnt, round(ppmi, 6) as ppmi from pp")
def ppmi(spark, d):
    return cooccur.ppmi(event_counts(spark, d)).withColumn("ppmi", F.round("ppmi", 6))


@query(f"with {_EV} select l as src, r as dst, cnt as weight from c order by cnt desc, l, r limit 40")
def raw_score_topk(spark, d):
    return edges.top_edges(event_counts(spark, d).select(F.col("l").alias("src"), F.col("r").alias("dst"), F.col("cnt").alias("weight")), 40)


@query()
def svd_ppmi_topk(spark, d):
    """The 40 highest of the cells counted, by a rank-2 approximation of their PPMI."""
    c = event_counts(spark, d)
    s = cooccur.score(c.select("l", "r"), c, "svd_ppmi", 2)
    return edges.top_edges(s.select(F.col("l").alias("src"), F.col("r").alias("dst"), F.round("score", 6).alias("weight")), 40)


@query()
def negative_pairs(spark, d):
    """Ten pairs of titles that are no link for each link of the part taxonomy."""
    g = part_graph(spark, d)
    return edges.non_edges(g.nodes.select("title"), g.edges)


# ---- metrics

_TRUTH = "t as (select a.n_name as src, b.n_name as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name)"


def region_pairs(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("src")), n.select("n_regionkey", F.col("n_name").alias("dst"))
    return a.join(b, "n_regionkey").where("src <> dst").select("src", "dst")


_PRF = "select round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"with {_POST}, {_TRUTH}, hits as (select count(*)::double as hit from (select src, dst from post intersect select src, dst from t)) {_PRF} from (select hit / (select count(*) from post) as p, hit / (select count(*) from t) as r from hits)")
def literal_prf(spark, d):
    """The pruned graph of nations against pairs of one region."""
    return _rounded(metrics.literal_prf(edges.post_process(nation_graph(spark, d), 0.2, 0.9), region_pairs(spark, d)))


@query(f"with {_POST}, {_TRUTH} select src, dst from post intersect select src, dst from t")
def edge_intersection(spark, d):
    return edges.post_process(nation_graph(spark, d), 0.2, 0.9).select("src", "dst").intersect(region_pairs(spark, d))


@query("""with r as (select a.vec_id as query, b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine from embeddings a join embeddings b on a.vec_id % 100 = 0),
k as (select *, row_number() over (partition by query order by round(cosine, 12) desc, id) n from r) select query, id, round(cosine, 6) as cosine from k where n <= 5""")
def cosine_topk(spark, d):
    """The five vectors most like each whose id is divisible by 100."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embed"))
    return metrics.top_similar(e.where("id % 100 = 0"), e, 5).withColumn("cosine", F.round("cosine", 6))


_VEC = """v as (select vec_id::varchar as id, embedding::double[] as e from embeddings),
ed as (select (vec_id // 2)::varchar as src, vec_id::varchar as dst, vec_id % 2 as odd from embeddings where vec_id > 1),
ev as (select odd, src, dst, a.e as u, b.e as w from ed join v a on a.id = src join v b on b.id = dst)"""


@query(f"""with {_VEC}, m as (select x.src as s1, x.dst as d1, y.src as s2, y.dst as d2 from ev x join ev y on x.odd = 0 and y.odd = 1 where least(list_cosine_similarity(x.u, y.u), list_cosine_similarity(x.w, y.w)) >= 0.15)
{_PRF} from (select (select count(*) from (select distinct s1, d1 from m))::double / (select count(*) from ed where odd = 0) as p, (select count(*) from (select distinct s2, d2 from m))::double / (select count(*) from ed where odd = 1) as r)""")
def fuzzy_prf(spark, d):
    """Even against odd links between vectors."""
    return _rounded(metrics.fuzzy_prf(vector_edges(spark, d, 0), vector_edges(spark, d, 1), vectors(spark, d), 0.15))


@query()
def continuous_prf(spark, d):
    return _rounded(metrics.continuous_prf(vector_edges(spark, d, 0), vector_edges(spark, d, 1), vectors(spark, d)))


_SGC = """n as (select vec_id as id, embedding::double[] as x from embeddings), e0 as (select distinct vec_id // 2 as src, vec_id as dst from embeddings where vec_id > 1 and vec_id // 2 in (select id from n)),
e1 as (select src, dst from e0 union all select id, id from n), dg as (select dst, count(*)::double as d from e1 group by 1), w as (select e1.src, e1.dst, 1 / sqrt(a.d * b.d) as w from e1 join dg a on a.dst = e1.dst join dg b on b.dst = e1.src),
x0 as (select id, unnest(x) as x, generate_subscripts(x, 1) - 1 as dim from n), x1 as (select w.dst as id, dim, sum(w * x) as x from w join x0 on x0.id = w.src group by 1, 2), x2 as (select w.dst as id, dim, sum(w * x) as x from w join x1 on x1.id = w.src group by 1, 2)"""


def _conv(spark, d, hops=2):
    n = vectors(spark, d).withColumnRenamed("title", "id")
    e = vector_edges(spark, d, 0).unionByName(vector_edges(spark, d, 1)).join(n.select(F.col("id").alias("src")), "src", "left_semi")
    return n, e


@query(f"with {_SGC} select id, dim, round(x, 6) as x from x2")
def sgc_embed(spark, d):
    n, e = _conv(spark, d)
    return metrics.convolved(n, e, 2).select(F.col("id").cast("long").alias("id"), F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query()
def graph_prf(spark, d):
    """The links between vectors against those of even ids only."""
    n, e = _conv(spark, d)
    even = n.where("cast(id as long) % 2 = 0")
    return _rounded(metrics.graph_prf(n, e, even, e.join(even.select(F.col("id").alias("src")), "src", "left_semi").join(even.select(F.col("id").alias("dst")), "dst", "left_semi")))


def _motif_sql(name: str, source: str) -> str:
    code = lambda p: " + ".join(f"{1 << i} * l{p[a]}{p[b]}" for i, (a, b) in enumerate([(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)]))
    least = ", ".join(code(p) for p in itertools.permutations(range(3)))
    link = lambda a, b: f"max(case when s.src = {a} and s.dst = {b} then 1 else 0 end)"
    return f"""s{name} as (select src, dst from {source} where src <> dst), n{name} as (select src as id from s{name} union select dst from s{name}),
u{name} as (select x.id as a, y.id as b, z.id as c, {', '.join(f'{link(f"{p}.id", f"{q}.id")} as l{i}{j}' for i, p in enumerate('xyz') for j, q in enumerate('xyz') if i != j)}
  from n{name} x join n{name} y on x.id < y.id join n{name} z on y.id < z.id join s{name} s on s.src in (x.id, y.id, z.id) and s.dst in (x.id, y.id, z.id) group by 1, 2, 3),
m{name} as (select least({least}) as motif, count(*) as n from u{name} where greatest(l01, l10) + greatest(l02, l20) + greatest(l12, l21) >= 2 group by 1)"""


@query(f"with {_NATION}, {_motif_sql('g', 'g')} select motif, n from mg")
def motif_census(spark, d):
    """Triples among all nation links."""
    return motif.census(nation_graph(spark, d))


@query(f"with {_POST}, {_motif_sql('g', 'g')}, {_motif_sql('p', 'post')} select round(sum(abs(coalesce(mg.n, 0) / (select sum(n) from mg) - coalesce(mp.n, 0) / (select sum(n) from mp))) / 2, 6) as motif_dist from mg full join mp on mg.motif = mp.motif")
def motif_distance(spark, d):
    """Between all nation links and those that pruning leaves."""
    g = materialise(nation_graph(spark, d), "graph")
    return motif.distance(motif.census(g), motif.census(edges.post_process(g, 0.2, 0.9))).select(F.round("motif_dist", 6).alias("motif_dist"))


# ---- tuning

@query(f"""with {_NATION}, n as (select count(*)::double as e from g), a as (select i, case when i = 0 then 0 else 1 - pow(1 / e, (20 - (20 - i)) * 0 + (i / 20.0) * 0) end from n, range(21) t(i)),
x as (select i, 1 - pow(1 / e, 1 - (20 - i) / 20.0) as p from n, range(21) t(i)), y as (select j, 1 - 0.1 * pow(10, j / 20.0) + 0.1 as q from range(21) t(j))
select i * 21 + j as seq, round(case when i = 0 then 0 else p end, 6) as absolute_percentile, round(q, 6) as relative_percentile from x, y""".replace(" a as (select i, case when i = 0 then 0 else 1 - pow(1 / e, (20 - (20 - i)) * 0 + (i / 20.0) * 0) end from n, range(21) t(i)),\n", ""))
def hp_grid(spark, d):
    g = nation_graph(spark, d)
    return tune.grid_table(spark, g.count()).select("seq", F.round("absolute_percentile", 6).alias("absolute_percentile"), F.round("relative_percentile", 6).alias("relative_percentile"))


def _search(spark, d):
    g = materialise(nation_graph(spark, d), "graph")
    t = region_pairs(spark, d)
    ends = g.select("src", "dst").unionByName(t)
    titles = ends.select(F.col("src").alias("title")).union(ends.select("dst")).union(spark.createDataFrame([(ROOT,)], "title string"))
    return tune.search(g, t, materialise(models.embed_titles(titles, None, models.HashEmbedder), "titles"), *tune.grid(g.count()))


@query()
def hp_search(spark, d):
    """Continuous and fuzzy scores of all 441 prunings, by stand-in vectors of the titles."""
    return _search(spark, d).select("seq", "edges", *[F.round(c, 6).alias(c) for c in tune.SCORES])


@query()
def best_hp(spark, d):
    """The pruning of the highest continuous F1."""
    return tune.best(_search(spark, d), "continuous_f1").select("seq", F.round("continuous_f1", 6).alias("continuous_f1"))


@query("select max(struct_pack(f1 := f, k := k)).f1 as f1, max(struct_pack(f1 := f, k := k)).k as k from (select round(avg(l_discount), 2) as f, l_suppkey as k from lineitem group by l_suppkey)")
def best_k(spark, d):
    """The highest rounded mean discount and the largest supplier that has it, as a best rank."""
    return tune.best_rank(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_discount"), 2).alias("f1")))


# ---- prompts

@query(f"select id, 'Title: ' || coalesce(title, '') || chr(10) || coalesce(abstract, '') as prompt from {_PAGES} p")
def render_prompt(spark, d):
    p = K.standing(table(spark, d, "raw_pages"), "id", "fetched_at", "title", "abstract")
    return p.select("id", T.article_prompt(F.col("title"), F.col("abstract")).alias("prompt"))


@query(f"select id, array_to_string(list_transform(paths, lambda p: array_to_string(p, ' -> ') || chr(10)), '') as response from {_LIN} l")
def render_response(spark, d):
    p = K.standing(table(spark, d, "linearised_samples"), "id", "ingested_at", "paths")
    return p.select("id", T.response(F.col("paths")).alias("response"))


@query(f"select id, case when id % 3 = 0 then null else '<s>[INST] ' || title || ' [/INST]' || abstract || '</s>' end as chat from {_PAGES} p where title is not null and abstract is not null")
def render_chat(spark, d):
    """Chats of title and abstract; every third begins with the wrong role and is rejected."""
    p = K.standing(table(spark, d, "raw_pages"), "id", "fetched_at", "title", "abstract").where("title is not null and abstract is not null")
    first = F.when(F.col("id") % 3 == 0, "system").otherwise("user")
    m = F.array(F.struct(first.alias("role"), F.col("title").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("abstract").alias("content")))
    return p.select("id", T.chat(m).alias("chat"))


@query(f"""with x as (select p.id, r_name, row_number() over (partition by p.id order by md5(p.id || '/' || r_regionkey || '/0')) n from {_PAGES} p cross join region),
s as (select id, string_agg(r_name, ',' order by n) as shots from x where n <= 2 group by 1) select id, shots from s""")
def fewshot_examples(spark, d):
    """Two examples for each page, drawn by hash."""
    ex = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"))
    p = K.standing(table(spark, d, "raw_pages"), "id", "fetched_at", "title")
    return tables.few_shot(p.select("id"), "id", ex, 2).select("id", F.array_join(F.transform("examples", lambda e: e["title"]), ",").alias("shots"))


@query(f"""select id, md5('The following is an article''s title and abstract. Briefly break down the topics (both specific and general concepts) relevant to this article. Explain your reasoning step by step.' || chr(10) || chr(10) || '### ARTICLE ###' || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || coalesce(abstract, '') || chr(10) || '### END ARTICLE ###' || chr(10)) as digest from {_PAGES} p""")
def reasoning_prompt(spark, d):
    p = K.standing(table(spark, d, "raw_pages"), "id", "fetched_at", "title", "abstract")
    return p.select("id", F.md5(T.reasoning_prompt(F.col("title"), F.col("abstract"))).alias("digest"))


@query()
def rebel_triplets(spark, d):
    """Relations in linearised form, by a pass over the words."""
    t = table(spark, d, "documents").where("text like '%<triplet>%'").select("doc_id", F.posexplode(T.triplets(F.col("text"))).alias("i", "t"))
    return t.select("doc_id", "i", "t.head", "t.type", "t.tail")


@query()
def relation_edges(spark, d):
    """Hierarchy relations, counted once for each document."""
    t = rebel_triplets(spark, d).where(F.col("type").isin(*T.HIERARCHY_RELATIONS))
    return cooccur.counts(t.select("doc_id", F.col("head").alias("l"), F.col("tail").alias("r")), "doc_id")


@query("select id, title from (select * from raw_pages) order by md5(id || '/0'), id limit 100")
def seeded_take(spark, d):
    """A hundred pages in a seeded random order."""
    return tables.drawn(table(spark, d, "raw_pages").select("id", "title"), "id", 100)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
