"""The driver's queries on training data, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import keys as K
from ..keys import table
from ..session import fresh_path, materialise
from . import encode, frequency, leakage, markup, overlap, pairs, pii, splits
from .codes import with_codes


def _batches(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log's rows up to the middle of its times, and those after it, as two deliveries."""
    t = F.unix_micros(F.col("at").cast("timestamp"))
    lo, hi = log.agg(F.min(t), F.max(t)).first()
    middle = ((lo or 0) + (hi or 0)) // 2
    late = F.coalesce(t > middle, F.lit(False))
    return log.where(~late), log.where(late)


def _frequency_store(spark: SparkSession, d: str):
    paths = table(spark, d, "linearised_samples").select(
        F.lit("paths").alias("field"), "id", F.col("ingested_at").alias("at"), K.title_keys(F.flatten(F.filter("paths", lambda p: p.isNotNull()))).alias("terms"))
    papers = with_codes(table(spark, d, "papers_with_citations").select("id", "categories", "ingested_at"), table(spark, d, "category_aliases"), "categories", "terms")
    papers = papers.select(F.lit("categories").alias("field"), "id", F.col("ingested_at").alias("at"), "terms")
    store = frequency.open_store(spark, fresh_path(spark, "frequency"))
    for name, log in (("paths", paths), ("papers", papers)):
        for part, rows in zip(("early", "late"), _batches(log)):
            frequency.deliver(store, rows, f"{name}-{part}")
    return store


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to tell records apart."""
    return frequency.marked(frequency.frequencies(_frequency_store(spark, d))).where("mark is not null").select("field", "term", "mark")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every term."""
    f = frequency.marked(frequency.frequencies(_frequency_store(spark, d)))
    return f.select("field", "term", "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation sample with four fifths of their words in common."""
    found = overlap.overlaps(table(spark, d, "linearised_samples"), at="ingested_at")
    rows = overlap.expand(found.pairs, found.members)
    return rows.select(F.least("id_t", "id_e").alias("id_a"), F.greatest("id_t", "id_e").alias("id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation samples with a copy in training, per split and source, and how much of them the training split covers."""
    return overlap.report(overlap.overlaps(table(spark, d, "linearised_samples"), at="ingested_at", keep=("source",)))


def _pair_store(spark: SparkSession, d: str):
    log = with_codes(table(spark, d, "papers_with_citations").select("id", "categories", "ingested_at"), table(spark, d, "category_aliases"), "categories", "items")
    store = pairs.open_store(spark, fresh_path(spark, "pairs"))
    for part, rows in zip(("early", "late"), _batches(log.select("id", F.col("ingested_at").alias("at"), "items"))):
        pairs.deliver(store, rows, part)
    return store


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Titles and abstracts that hold markup."""
    rows = K.standing(table(spark, d, "papers_with_citations"), "id", "ingested_at", "title", "abstract")
    return markup.clean_markup(rows, "id", ["title", "abstract"]).where("size(kinds) > 0").select("id", "field")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean titles and abstracts, with the kinds of markup that each held."""
    rows = K.standing(table(spark, d, "papers_with_citations"), "id", "ingested_at", "title", "abstract")
    return markup.clean_markup(rows, "id", ["title", "abstract"]).select("id", "field", "clean", F.array_join(F.array_sort(F.map_keys("kinds")), ",").alias("kinds"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of codes on at least 4 papers and at least 3 times as often as by chance."""
    return pairs.strong(pairs.associations(_pair_store(spark, d), 4), 3).select("item_a", "item_b")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of codes with its counts and its ratio to chance."""
    return pairs.associations(_pair_store(spark, d)).select("item_a", "item_b", "n_ab", F.round("lift", 6).alias("lift"))


def _records_with_keys(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "raw_categories").select(F.col("id").cast("string").alias("id"), "fetched_at", F.transform(F.filter("sub_categories", lambda s: s["id"].isNotNull()), lambda s: s["id"].cast("string")).alias("keys"))
    cats = K.standing(cats, "id", "fetched_at", "keys").select(F.lit("category").alias("kind"), "id", "keys")
    long_ = F.filter("paths", lambda p: F.size(p) >= 2)
    last = F.filter(F.transform(long_, lambda p: K.title_key(F.element_at(p, -1))), lambda k: k.isNotNull())
    samples = table(spark, d, "linearised_samples").select("id", "ingested_at", F.array_distinct(last).alias("keys"))
    samples = K.standing(samples, "id", "ingested_at", "keys").select(F.lit("sample").alias("kind"), "id", "keys")
    return cats.unionByName(samples)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records in groups of two or more that are related through others."""
    return splits.groups(_records_with_keys(spark, d)).where("group_size > 1").select("kind", "id", "group_key")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for every record, 80 / 10 / 10, such that no group is torn; records without keys are groups of their own."""
    records = materialise(_records_with_keys(spark, d), "records")
    in_group = splits.groups(records).select("kind", "id", F.col("group_key"), "group_size")
    every = records.select("kind", "id").join(in_group, ["kind", "id"], "left")
    name = F.when(F.col("group_key").isNull(), F.concat(F.lit("="), "id")).otherwise(F.concat(F.lit("+"), "group_key"))
    every = materialise(every.withColumn("group", F.concat_ws("\u0001", "kind", name)).withColumn("group_size", F.coalesce("group_size", F.lit(1))), "every")
    out = None
    for kind in ("category", "sample"):
        mine = every.where(F.col("kind") == kind)
        dealt = splits.assign(mine.select("group", "group_size").distinct(), (0.8, 0.1, 0.1), ("train", "validation", "test")).select("group", "split")
        rows = mine.join(dealt, "group").select("kind", "id", "split")
        out = rows if out is None else out.unionByName(rows)
    return out


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 15 consecutive words of an evaluation item."""
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select("doc_id", F.col("item").alias("item_id")).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of personal data in each document."""
    return pii.redacted(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.explode("kinds").alias("kind")).distinct()


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document with placeholders for personal data."""
    return pii.redacted(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("clean").alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = [p1_found, p1_counts, p2_found, p2_report, p4_found, p4_splits, p6_found, p6_clean, p7_found, p7_pairs, p8_ids, p9_found, p10_found, p10_texts]
    return {f.__name__: f for f in fs}


#: White space as the operators see it, for DuckDB's expressions.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x0b\x{85}]+"
_LIN = "(select * from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from linearised_samples where id is not null) where rn = 1)"
_PAP = "(select * from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from papers_with_citations where id is not null) where rn = 1)"
_KEY = f"nullif(trim(lower(regexp_replace(t, '{_SPACE}', ' ', 'g'))), '')"
_CODES = f"""codes as (
  select id, coalesce(lower(a.canonical), c) as code from (
    select id, unnest(regexp_split_to_array(lower(e), '{_SPACE}')) c from (select id, unnest(categories) e from {_PAP} p) where e is not null
  ) x left join category_aliases a on lower(a.alias) = c where c <> '')"""
_TERMS = f"""with {_CODES}, titles as (
  select id, {_KEY} as term from (select id, unnest(p) t from (select id, unnest(paths) p from {_LIN} l))),
counts as (
  select 'paths' as field, term, count(*) as occurrences, count(distinct id) as records, (select count(distinct id) from linearised_samples) as n from titles where term is not null group by term
  union all
  select 'categories', code, count(*), count(distinct id), (select count(distinct id) from papers_with_citations) from codes group by code),
marked as (select *, case when records < 3 then 'rare' when records * 10 > n then 'common' else '' end as mark from counts)"""
_PAIRS = f"""with {_CODES}, d as (select distinct id, code from codes), s as (select code, count(*) n from d group by code),
t as (select count(distinct id) n from papers_with_citations),
p as (select a.code as item_a, b.code as item_b, count(*) as n_ab from d a join d b on a.id = b.id and a.code < b.code group by 1, 2),
r as (select item_a, item_b, n_ab, x.n as n_a, y.n as n_b, t.n as n from p join s x on x.code = item_a join s y on y.code = item_b cross join t)"""
_WORDS = rf"""with s as (select id, case when lower(trim(regexp_replace(split, '{_SPACE}', ' ', 'g'))) = 'train' then 1 else 2 end as side, regexp_extract_all(lower(title || ' ' || abstract), '[\p{{L}}\p{{N}}]+') as w from {_LIN} l
  where lower(trim(regexp_replace(split, '{_SPACE}', ' ', 'g'))) in ('train', 'eval', 'test') and regexp_replace(title, '{_SPACE}', '', 'g') <> '' and regexp_replace(abstract, '{_SPACE}', '', 'g') <> ''),
c as (select id, side, w, len(w) as n from s where len(w) > 0), x as (select id, side, n, unnest(w) as word from c), k as (select id, side, n, word, row_number() over (partition by id, word) as k from x),
pairs as (select t.id as a, e.id as b from k t join k e on t.word = e.word and t.k = e.k and t.side = 1 and e.side = 2 and least(t.n, e.n) * 5 >= greatest(t.n, e.n) * 4 group by t.id, e.id, t.n, e.n having count(*) * 5 >= 4 * greatest(t.n, e.n))"""
_CAT = "(select * from (select *, row_number() over (partition by id order by fetched_at desc nulls last) rn from raw_categories where id is not null) where rn = 1)"
_GROUPS = f"""with recursive rk as (select distinct 'category' as kind, id::varchar as id, s.id::varchar as key from (select id, unnest(sub_categories) s from {_CAT} c) where s.id is not null
  union select 'sample', id, {_KEY} from (select id, p[len(p)] as t from (select id, unnest(paths) p from {_LIN} l) where len(p) >= 2) where {_KEY} is not null),
kk as (select distinct a.kind, a.key as s, b.key as t from rk a join rk b on a.kind = b.kind and a.id = b.id),
reach as (select kind, s, t from kk union select reach.kind, reach.s, kk.t from reach join kk on kk.kind = reach.kind and kk.s = reach.t),
g as (select kind, s as key, min(t) as group_key from reach group by 1, 2), r as (select distinct kind, id, group_key from rk join g using (kind, key))"""
_RUNS = r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null), i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
dg as (select doc_id, array_to_string(w[k:k + 14], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 13)) as k from d where len(w) >= 15)), ig as (select item_id, array_to_string(w[k:k + 14], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 13)) as k from i where len(w) >= 15))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"{_GROUPS} select kind, id, group_key from r where (kind, group_key) in (select kind, group_key from r group by 1, 2 having count(*) > 1)",
        "p9_found": f"{_RUNS} select distinct doc_id, item_id from dg join ig using (g)",
        "p2_found": f"{_WORDS} select least(a, b) as id_a, greatest(a, b) as id_b from pairs",
        "p1_found": f"{_TERMS} select field, term, mark from marked where mark <> ''",
        "p1_counts": f"{_TERMS} select field, term, occurrences, records, mark from marked",
        "p7_found": f"{_PAIRS} select item_a, item_b from r where n_ab >= 4 and n_ab::hugeint * n >= 3 * n_a::hugeint * n_b",
        "p7_pairs": f"{_PAIRS} select item_a, item_b, n_ab, round(n_ab * n::double / (n_a * n_b::double), 6) as lift from r",
    }
