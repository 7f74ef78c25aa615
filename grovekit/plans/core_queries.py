"""The core's queries on hierarchies and hot keys, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import keys as K
from ..keys import table
from ..operators import hierarchy, hotkeys
from ..session import materialise


def category_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links between categories of standing rows."""
    subs = F.transform("sub_categories", lambda s: s["id"])
    rows = K.standing(table(spark, d, "raw_categories").select("id", "fetched_at", subs.alias("subs")), "id", "fetched_at", "subs")
    return hierarchy.clean_links(rows.select("id", F.explode("subs").alias("sub")), "id", "sub")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Where a hierarchy runs into itself: categories on cycles, samples with a path that comes twice by one title."""
    cats = hierarchy.cyclic_nodes(category_links(spark, d)).select(F.lit("category").alias("kind"), F.col("node").alias("id"))

    def again(p):
        k = K.title_keys(p)
        return F.size(F.array_distinct(k)) < F.size(k)

    flag = F.coalesce(F.exists("paths", lambda p: F.coalesce(again(p), F.lit(False))), F.lit(False))
    rows = K.standing(table(spark, d, "linearised_samples").select("id", "ingested_at", flag.alias("loops")), "id", "ingested_at", "loops")
    return cats.unionByName(rows.where("loops").select(F.lit("sample").alias("kind"), "id"))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_categories").select("id").distinct()


def _labelled(spark: SparkSession, d: str):
    return hierarchy.label(category_links(spark, d), _ids(spark, d))


def p3_tree(spark: SparkSession, d: str) -> DataFrame:
    """Parent, root, depth and chain of each category in the spanning forest, cycles condensed, and its number of descendants by any way."""
    return hierarchy.with_descendants(*_labelled(spark, d)).select("node", "parent", "root", "depth", "descendants", "head", "pos")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of each category by any way, one row for each pair."""
    return hierarchy.descendants(*_labelled(spark, d))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every full path of each category; a cycle is one entry, named by its smallest category."""
    labels, grafts, cyclic = _labelled(spark, d)
    paths = hierarchy.full_paths(labels, grafts).select("node", F.array_join("path", " / ").alias("path"), (F.size("path") - 1).cast("long").alias("depth"), F.element_at("path", 1).alias("root"))
    return hierarchy.each_member(paths, "node", cyclic)


def p3_steps(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy that the steps along all paths of samples make: root and depth in the spanning forest, descendants of each title key by any way."""
    rows = K.standing(table(spark, d, "linearised_samples").select("id", "ingested_at", "paths"), "id", "ingested_at", "paths")
    k = rows.select(F.explode("paths").alias("p")).select(K.title_keys(F.col("p")).alias("k")).where("size(k) > 1")
    steps = F.transform(F.sequence(F.lit(1), F.size("k") - 1), lambda i: F.struct(F.element_at("k", i).alias("src"), F.element_at("k", i + 1).alias("dst")))
    links = hierarchy.clean_links(k.select(F.explode(steps).alias("s")).select("s.*"), "src", "dst")
    labels, grafts, cyclic = hierarchy.label(links)
    every = hierarchy.with_descendants(labels, grafts, cyclic).join(cyclic.select("node", F.lit(True).alias("on_cycle")), "node", "left")
    return every.select("node", "root", "depth", "descendants", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _topic_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each path with at least two entries whose second is a title: topic, number of entries, last title, sample."""
    paths = F.filter("paths", lambda p: F.size(p) >= 2)
    short = F.transform(paths, lambda p: F.struct(K.title_key(p[1]).alias("topic"), K.title_key(F.element_at(p, -1)).alias("leaf"), F.size(p).alias("entries")))
    rows = K.standing(table(spark, d, "linearised_samples").select("id", "ingested_at", short.alias("ps")), "id", "ingested_at", "ps")
    return rows.select("id", F.explode("ps").alias("p")).select("id", "p.*")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Topics below the root with more than one in twenty of all paths."""
    rows = _topic_rows(spark, d).withColumn("topic", F.coalesce("topic", F.lit("")))  # a path without a topic counts among all paths
    return hotkeys.dominant(hotkeys.key_totals(rows, "topic", "entries"), "topic", 20).where("topic <> ''").select("topic")


def p5_topics(spark: SparkSession, d: str) -> DataFrame:
    """Paths, samples and most specific categories of each topic, with exact quartiles of the length of its paths."""
    rows = materialise(_topic_rows(spark, d).where("topic is not null"), "topics")
    totals = materialise(hotkeys.key_totals(rows, "topic", "entries"), "totals")
    q = hotkeys.exact_quantiles(rows, "topic", "entries", (0.25, 0.5, 0.75), totals).groupBy("topic").agg(
        *[F.max(F.when(F.col("q") == x, F.col("value"))).cast("bigint").alias(n) for x, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    samples = hotkeys.distinct_by_key(rows, "topic", "id", "samples")
    leaves = hotkeys.distinct_by_key(rows, "topic", "leaf", "leaves")
    return totals.select("topic", F.col("n").alias("paths")).join(samples, "topic", "left").join(leaves, "topic", "left").join(q, "topic").select("topic", "paths", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("leaves", F.lit(0)).alias("leaves"), "q1", "q2", "q3")


def queries():
    fs = [p3_found, p3_tree, p3_descendants, p3_paths, p3_steps, p5_found, p5_topics]
    return {f.__name__: f for f in fs}


_SPACE = r"[\s\p{Z}\x1c-\x1f\x0b\x{85}]+"


def _key(t: str) -> str:
    return f"nullif(trim(lower(regexp_replace({t}, '{_SPACE}', ' ', 'g'))), '')"


_LIN = "(select * from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from linearised_samples where id is not null) where rn = 1)"
_TOPICS = f"""with p as (select id, unnest(paths) p from {_LIN} l), r as (select id, {_key('p[2]')} as topic, {_key('p[len(p)]')} as leaf, len(p) as entries from p where len(p) >= 2)"""
_CATS = """cats as (select * from (select *, row_number() over (partition by id order by fetched_at desc nulls last) rn from raw_categories where id is not null) where rn = 1),
links as (select distinct id::varchar as src, s.id::varchar as dst from (select id, unnest(sub_categories) s from cats) where s.id is not null)"""


_STEPS = f"""k as (select path, i, {_key('t')} as k from (select path, unnest(p) t, generate_subscripts(p, 1) i from (select row_number() over () as path, p from (select unnest(paths) p from {_LIN} l) where p is not null))),
kk as (select path, k as src, lead(k) over (partition by path order by i) as dst from k where k is not null), links as (select distinct src, dst from kk where dst is not null)"""
#: Links to components (comp), condensed links (cl), the forest by smallest parent, and the chains of largest children.
_FOREST = """reach as (select src, dst from links union select r.src, l.dst from reach r join links l on r.dst = l.src),
both_ as (select a.src as node, min(a.dst) as c from reach a join reach b on a.src = b.dst and a.dst = b.src group by 1),
comp as (select n.node, coalesce(c, n.node) as c from nodes n left join both_ on both_.node = n.node),
cl as (select distinct a.c as src, b.c as dst from links join comp a on a.node = src join comp b on b.node = dst where a.c <> b.c),
forest as (select x.c as node, (select min(src) from cl where dst = x.c) as parent from (select distinct c from comp) x),
anc as (select node, node as a, 0::bigint as dist from forest union all select anc.node, f.parent, dist + 1 from anc join forest f on f.node = anc.a where f.parent is not null),
top as (select node, arg_max(a, dist) as root, max(dist) as depth from anc group by 1), sizes as (select a as node, count(*) as size from anc group by 1),
below as (select src as node, count(*) as n from reach where src <> dst group by 1),
heavy as (select f.node, f.parent, f.parent is not null and row_number() over (partition by f.parent order by size desc, f.node) = 1 as is_heavy from forest f join sizes z on z.node = f.node),
chain as (select node, node as head, 0::bigint as pos from heavy where not is_heavy union all select h.node, head, pos + 1 from chain join heavy h on h.parent = chain.node and h.is_heavy)"""


def oracle_sql() -> dict[str, str]:
    cats = f"{_CATS}, nodes as (select id::varchar as node from raw_categories where id is not null union select src from links union select dst from links), {_FOREST}"
    return {
        "p3_tree": f"""with recursive {cats} select comp.node, f.parent, t.root, t.depth, coalesce(b.n, 0) as descendants, ch.head, ch.pos from comp join forest f on f.node = comp.c join top t on t.node = comp.c
join chain ch on ch.node = comp.c left join below b on b.node = comp.node""",
        "p3_descendants": f"with recursive {cats} select src as ancestor, dst as node from reach where src <> dst",
        "p3_paths": f"""with recursive {cats}, w as (select node, [node] as path from forest where parent is null union all select cl.dst, list_append(w.path, cl.dst) from w join cl on cl.src = w.node)
select comp.node, array_to_string(path, ' / ') as path, len(path) - 1 as depth, path[1] as root from w join comp on comp.c = w.node""",
        "p3_steps": f"""with recursive {_STEPS}, nodes as (select src as node from links union select dst from links), {_FOREST}
select comp.node, t.root, t.depth, coalesce(b.n, 0) as descendants, exists(select 1 from reach r where r.src = comp.node and r.dst = comp.node) as on_cycle from comp join top t on t.node = comp.c left join below b on b.node = comp.node""",
        "p3_found": f"""with recursive {_CATS}, reach as (select src, dst from links union select r.src, l.dst from reach r join links l on r.dst = l.src),
p as (select id, row_number() over () as path, p from (select id, unnest(paths) p from {_LIN} l) where p is not null), k as (select id, path, {_key('t')} as k from (select id, path, unnest(p) t from p))
select distinct 'category' as kind, src as id from reach where src = dst
union all select distinct 'sample', id from (select id, path, k from k where k is not null group by id, path, k having count(*) > 1)""",
        "p5_found": f"{_TOPICS} select topic from r where topic is not null group by topic having count(*) * 20 > (select count(*) from r)",
        "p5_topics": f"""{_TOPICS} select topic, count(*) as paths, count(distinct id) as samples, count(distinct leaf) as leaves,
  quantile_disc(entries, 0.25)::bigint as q1, quantile_disc(entries, 0.5)::bigint as q2, quantile_disc(entries, 0.75)::bigint as q3 from r where topic is not null group by topic""",
    }
