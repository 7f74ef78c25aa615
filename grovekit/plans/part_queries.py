"""Queries on single functions of the library: prompts, tokens, scores, files and splits, each with its SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import keys as K
from .. import models
from ..functions import text as T
from ..functions import tokens
from ..keys import table
from ..operators import cooccur, edges, metrics, tables, traverse
from ..session import fresh_path, materialise
from ..sources import files
from . import tune
from .reference_queries import _EV, _PAGES, _PART, _SP, _SPLIT, ROOT, event_counts, nation_graph, part_graph, region_pairs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- prompts

_ARTICLE = "'### ARTICLE ###' || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || coalesce(abstract, '') || chr(10) || '### END ARTICLE ###' || chr(10)"
_INTRO = _lit(T._OPEN + "Your task is to assign this article to a suitable category hierarchy. " + T._TASK)


def _pages(spark, d) -> DataFrame:
    return K.standing(table(spark, d, "raw_pages"), "id", "fetched_at", "title", "abstract")


@query(f"select id, md5({_INTRO} || {_lit(T._FORMAT)} || chr(10) || {_ARTICLE} || chr(10) || {_lit('Provide a category hierarchy for the above article. Use the format described above.' + chr(10))}) as digest from {_PAGES} p")
def zero_shot_prompt(spark, d):
    """The task with its format and no examples."""
    return _pages(spark, d).select("id", F.md5(T.hierarchy_prompt(F.col("title"), F.col("abstract"))).alias("digest"))


@query(f"""with shown as (select string_agg('### EXAMPLE ' || n || ' ###' || chr(10) || '### ARTICLE ###' || chr(10) || 'Title: ' || r_name || chr(10) || 'Region ' || r_regionkey || chr(10) || '### END ARTICLE ###' || chr(10) || {_lit(ROOT)} || ' -> ' || r_name || chr(10)
  || '### END EXAMPLE ' || n || ' ###' || chr(10), '' order by n) as s from (select *, row_number() over (order by r_regionkey) n from region))
select id, md5({_INTRO} || s || chr(10) || {_ARTICLE} || chr(10) || {_lit('Provide a category hierarchy for the above article. Use the same format as the examples above.' + chr(10))}) as digest from {_PAGES} p cross join shown""")
def few_shot_prompt(spark, d):
    """The task with all regions as examples, in order."""
    one = F.struct("r_regionkey", F.struct(F.col("r_name").alias("title"), F.concat(F.lit("Region "), "r_regionkey").alias("abstract"), F.array(F.array(F.lit(ROOT), F.col("r_name"))).alias("paths")).alias("e"))
    ex = table(spark, d, "region").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias("ex")).withColumn("_one", F.lit(1))  # five rows
    return _pages(spark, d).withColumn("_one", F.lit(1)).join(F.broadcast(ex), "_one").select("id", F.md5(T.hierarchy_prompt(F.col("title"), F.col("abstract"), F.col("ex"))).alias("digest"))


@query(f"select id, md5({_lit(T._CONCEPTS)} || {_ARTICLE} || chr(10) || {_lit('Give your answer as a comma-separated string.' + chr(10))}) as digest from {_PAGES} p")
def concept_prompts(spark, d):
    return _pages(spark, d).select("id", F.md5(T.concept_prompt(F.col("title"), F.col("abstract"))).alias("digest"))


# ---- lines, versions, rejects

@query("select p_partkey as id, trim(p_name) as child, trim(p_brand) as parent from part where p_size % 3 <> 0")
def pattern_line_pairs(spark, d):
    """Child and parent of extraction lines; every third line has too few bars and is ignored."""
    bars = F.when(F.col("p_size") % 3 == 0, "||").otherwise("|||")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), bars, F.lit(" "), "p_brand", bars, "p_type").alias("line"))
    child, parent = T.pattern_line(F.col("line"))
    return p.select("id", child.alias("child"), parent.alias("parent")).where("child is not null")


@query("select id, case when citation_count % 12 + 1 <= 3 then title else abstract end as created from papers_with_citations where citation_count is not null")
def first_versions(spark, d):
    """What the version of the smaller number says, numbers compared as such."""
    n = F.concat(F.lit("v"), (F.col("citation_count") % 12 + 1).cast("string"))
    rows = table(spark, d, "papers_with_citations").where("citation_count is not null")
    tie = F.when(F.col("citation_count") % 12 + 1 == 3, F.array(F.struct(F.lit("v3").alias("version"), F.col("title").alias("created"))))
    both = F.array(F.struct(n.alias("version"), F.col("title").alias("created")), F.struct(F.lit("v3").alias("version"), F.col("abstract").alias("created")))
    return rows.select("id", T.first_version(F.coalesce(tie, both)).alias("created"))


_WORDS = f"d as (select doc_id, case when text is null then null else list_filter(regexp_split_to_array(text, '{_SP}'), lambda w: w <> '') end as w from documents)"


def _document_lengths(spark, d) -> DataFrame:
    words = F.filter(F.split("text", K.SPACE), lambda w: w != "")
    return table(spark, d, "documents").select("doc_id", F.transform(words, lambda w: F.length(w)).alias("ids"))


@query(f"with {_WORDS} select doc_id, len(w)::int as n, case when w is null then 'no tokens' when len(w) > 64 then 'too long' end as reject from d")
def length_rejects(spark, d):
    """Documents of more than 64 tokens, or without any list, with the reason why they are rejected."""
    return tokens.with_reject(_document_lengths(spark, d), "ids", 64).select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n"), "reject")


@query(f"""with {_WORDS}, k as (select doc_id, list_transform(w, lambda x: length(x)) as ids from d where len(w) <= 64), m as (select least((max(len(ids)) // 8 + 1) * 8, 512) as n from k)
select doc_id, n::int as n, md5(array_to_string(list_transform(list_concat(ids, list_transform(range(n - len(ids)), lambda x: 0)), lambda x, i: case when i <= 2 or i > len(ids) then '-100' else x::varchar end), ',')) as digest from k, m""")
def padded_labels(spark, d):
    """Labels of documents padded to a common length, the first two tokens hidden."""
    x = materialise(tokens.with_reject(_document_lengths(spark, d), "ids", 64).where("reject is null").select("doc_id", "ids"), "ids")
    longest = x.agg(F.max(F.size("ids"))).first()[0] or 0
    n = tokens.padded_length(longest, 8, 512)
    mask = F.transform("ids", lambda _, i: i < 2)
    _, _, labels = tokens.pad(F.col("ids"), mask, F.lit(n), 0)
    return x.select("doc_id", F.lit(n).alias("n"), F.md5(F.array_join(labels.cast("array<string>"), ",")).alias("digest"))


# ---- joins

_CODES = f"""c as (select id, unnest(regexp_split_to_array(lower(e), '{_SP}')) c from (select id, unnest(categories) e from papers_with_citations) where e is not null),
cc as (select id, coalesce(lower(a.canonical), c) as code from c left join category_aliases a on lower(a.alias) = c where c <> '')"""


def _paper_codes(spark, d) -> DataFrame:
    c = table(spark, d, "papers_with_citations").select("id", F.explode("categories").alias("e")).where("e is not null").select("id", F.explode(F.split(F.lower("e"), K.SPACE)).alias("alias")).where("alias <> ''")
    a = table(spark, d, "category_aliases").select(F.lower("alias").alias("alias"), F.lower("canonical").alias("c"))
    return c.join(a, "alias", "left").select("id", F.coalesce("c", "alias").alias("code"))


@query(f"with {_CODES}, nodes as (select distinct lower(canonical) as code from category_aliases) select code, count(distinct id) as papers from cc where code in (select code from nodes) group by 1")
def category_members(spark, d):
    """Papers of each category that is a node."""
    nodes = table(spark, d, "category_aliases").select(F.lower("canonical").alias("id")).distinct()
    known, _ = tables.known_and_unknown(_paper_codes(spark, d), "code", nodes)
    return known.groupBy("code").agg(F.countDistinct("id").alias("papers"))


@query(f"with {_CODES}, nodes as (select distinct lower(canonical) as code from category_aliases) select code, count(*) as n from cc where code not in (select code from nodes) group by 1")
def unknown_codes(spark, d):
    """Codes without a node, the rejects, with their number."""
    nodes = table(spark, d, "category_aliases").select(F.lower("canonical").alias("id")).distinct()
    _, rest = tables.known_and_unknown(_paper_codes(spark, d), "code", nodes)
    return rest.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_EV}, names as (select distinct l as t from c union select distinct r from c), n as (select count(*) as n from names),
s as (select a.t as src, b.t as dst, coalesce(c.cnt, 0)::double as weight from names a cross join names b left join c on c.l = a.t and c.r = b.t)
select src, dst, weight from (select *, row_number() over (order by weight desc, src, dst) k from s) cross join n where k <= least(n * 10, n * n)""")
def all_pairs_topk(spark, d):
    """The ``min(10 N, N * N)`` highest of all pairs of the N names, pairs never counted at 0."""
    c = materialise(event_counts(spark, d), "counts")
    names = c.select(F.col("l").alias("title")).union(c.select("r")).distinct()
    return edges.top_pairs(names, c.select(F.col("l").alias("src"), F.col("r").alias("dst"), F.col("cnt").alias("weight")), 10)


@query(f"""with {_EV}, p as (select l, r from c where cnt > 1 union all select l, 'never' from c group by 1) select p.l, p.r, coalesce(c.cnt, 0)::double as score from p left join c on p.l = c.l and p.r = c.r""")
def scored_or_zero(spark, d):
    """Counts of pairs looked up, 0 for unknown ones."""
    c = materialise(event_counts(spark, d), "counts")
    p = c.where("cnt > 1").select("l", "r").unionByName(c.select("l").distinct().withColumn("r", F.lit("never")))
    return cooccur.scored(p, c, "cnt").select("l", "r", F.col("score").cast("double").alias("score"))


# ---- vectors and scores

@query("select a.vec_id as id, round((list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 2, 6) as s from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def scaled_neighbours(spark, d):
    """Cosines of consecutive vectors, scaled to 0 and 1."""
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("id"), F.round(metrics.scaled_cosine(F.col("embedding"), F.col("other")), 6).alias("s"))


@query("""select g as id, dim, round(sum(case when m then x else 0 end) / greatest(count(*) filter (where m), 1e-9), 6) as x from (select vec_id // 8 as g, vec_id % 3 <> 0 as m, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) group by 1, 2""")
def mean_pooled(spark, d):
    """The mean of eight vectors each, those of every third id masked out."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") / 8).cast("long").alias("id"), F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3 != 0).alias("m")).alias("s"))
    g = e.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # eight vectors
    v = g.select("id", metrics.mean_pool(F.transform("s", lambda x: x["v"]), F.transform("s", lambda x: x["m"])).alias("v"))
    return v.select("id", F.posexplode("v").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("""with x as (select l_tax > l_discount as p, l_returnflag = 'R' as t from lineitem), c as (select count(*) filter (where p and t)::double as tp, count(*) filter (where p) as pp, count(*) filter (where t) as tt, count(*) filter (where p = t) as ok, count(*) as n from x)
select round(ok / n, 6) as accuracy, round(tp / pp, 6) as precision, round(tp / tt, 6) as recall, round(2 * tp / (pp + tt), 6) as f1 from c""")
def pair_classifier(spark, d):
    """Scores of a classifier of two logits."""
    x = table(spark, d, "lineitem").select(F.col("l_discount").alias("l0"), F.col("l_tax").alias("l1"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return metrics.pair_classifier_scores(x).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("select l_orderkey, l_linenumber, round(exp(l_tax) / (exp(l_tax) + exp(l_discount)), 6) as p from lineitem where l_orderkey % 7 = l_linenumber")
def link_probabilities(spark, d):
    x = table(spark, d, "lineitem").where("l_orderkey % 7 = l_linenumber")
    return x.select("l_orderkey", "l_linenumber", F.round(metrics.link_probability(F.col("l_discount"), F.col("l_tax")), 6).alias("p"))


# ---- files

@query(f"with {_PART} select src, dst from e")
def node_link_round_trip(spark, d):
    """The part taxonomy written as one node-link document and read again."""
    path = fresh_path(spark, "graph")
    files.node_link(part_graph(spark, d)).write.text(path)
    return files.load_graph(spark, path).edges.select("src", "dst")


@query("select to_json({n_nationkey: n_nationkey, n_name: n_name, n_regionkey: n_regionkey})::varchar as value from nation")
def json_rows(spark, d):
    return files.json_row(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")).select("value")


# ---- splits and evaluation

@query(f"""with recursive {_SPLIT}, dep as (select src, dst, case when src = '{ROOT}' then 0 when src like 'B %' then 1 else 2 end as depth from e),
x as (select dep.depth, exists(select 1 from sides a join sides b on a.test and b.test and a.id = dep.src and b.id = dep.dst) as a, exists(select 1 from sides a join sides b on not a.test and not b.test and a.id = dep.src and b.id = dep.dst) as b from dep)
select depth, count(*) as edges, round(avg(a::int), 6) as in_a, round(avg(b::int), 6) as in_b, round(avg((a and b)::int), 6) as shared, round(avg((a or b)::int), 6) as covered from x group by 1""")
def split_edge_coverage(spark, d):
    """By depth, the shares of edges that either half of the part taxonomy has."""
    g = part_graph(spark, d)
    test, train = traverse.depth_split(g, 1, 0.5)
    dist = traverse.bfs(g.edges, g.nodes.where(F.col("id") == ROOT).select("id"))
    name = lambda e: e.select(F.concat_ws("\u0001", "src", "dst").alias("id"))
    at = traverse.edge_depths(g.edges, dist).select(F.concat_ws("\u0001", "src", "dst").alias("id"), "depth")
    c = traverse.split_coverage(at, name(test.edges), name(train.edges))
    return c.select("depth", F.col("nodes").alias("edges"), *[F.round(x, 6).alias(x) for x in ("in_a", "in_b", "shared", "covered")])


def _evaluated(spark, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    ends = predicted.select("src", "dst").unionByName(truth.select("src", "dst"))
    titles = ends.select(F.col("src").alias("title")).union(ends.select("dst")).distinct()
    got = tune.evaluate(predicted, truth, materialise(models.embed_titles(titles, None, models.HashEmbedder), "titles"))
    return got.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in got.dtypes])


@query()
def evaluate_pruned(spark, d):
    """All 15 figures of the pruned graph of nations against pairs of one region, by stand-in vectors."""
    return _evaluated(spark, edges.post_process(nation_graph(spark, d), 0.2, 0.9), region_pairs(spark, d))


@query()
def evaluate_memorised(spark, d):
    """The baseline that answers with the training half itself: the same figures of one half of the nations' pairs against the other."""
    pairs = region_pairs(spark, d)
    half = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")) % 2 == 0
    return _evaluated(spark, pairs.where(half), pairs.where(~half))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
