"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import clean, clean_sql
from ..operators.dedup import latest_per_key
from ..session import read_table
from .abuse import fit, rates, score_documents
from .contamination import leaked_items
from .cooccurrence import cooccurrence, distinct_items
from .credentials import DICTIONARY_PATH, find_credentials, redact_credentials
from .mixing import TOKENIZER_PATH, mix, token_counts
from .personal import find_personal, redact_personal
from .term_frequency import term_frequency


def _flag_pairs(spark: SparkSession, sf_dir: str, min_count: int) -> DataFrame:
    provider = clean(F.col("provider"))
    events = latest_per_key(
        read_table(spark, sf_dir, "audit_events"), "id", "received_at",
        {"controlled": F.coalesce(provider == "control", F.lit(False)), "items": distinct_items(F.col("flags"), clean)},
    )
    return cooccurrence(events.where("not controlled"), "items", min_count)


def p1_flag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1: every pair of flags with its count, lift and pointwise mutual information."""
    return _flag_pairs(spark, sf_dir, 1).select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _flag_pairs(spark, sf_dir, 10).where("n_ab * n_baskets >= 3 * n_a * n_b")
    return pairs.select(F.col("item_a").alias("flag_a"), F.col("item_b").alias("flag_b"))


def _event_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "audit_events")
    cleaned = F.filter(F.transform(F.coalesce(F.col("flags"), F.array().cast("array<string>")), clean), lambda x: x.isNotNull())
    events = latest_per_key(table, "id", "received_at", {"flags": cleaned, "action_taken": clean(F.col("action_taken")), "at": F.when(F.col("id").isNull(), F.col("received_at"))})
    # Rows without id are events of their own, told apart by what they hold and when they came.
    orphan = F.concat(F.lit("\0"), F.to_json(F.struct("flags", "action_taken", "at")))
    n = table.select("id").where("id is not null").distinct().count() + events.where("id is null").count()
    # Repeats inside one event are folded before the shuffle.
    flags = F.transform(
        F.array_distinct("flags"),
        lambda x: F.struct(F.lit("flags").alias("field_name"), x.alias("term"), F.size(F.filter("flags", lambda y: y == x)).alias("times")),
    )
    action = F.array(F.struct(F.lit("action_taken").alias("field_name"), F.col("action_taken").alias("term"), F.lit(1).alias("times")))
    pairs = events.select(F.coalesce("id", orphan).alias("record"), F.explode(F.concat(flags, action)).alias("p")).select("p.field_name", "p.term", "record", "p.times")
    return term_frequency(pairs, n)


def p2_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2: occurrences and events of every value of the two fields."""
    return _event_terms(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_terms(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


QUERIES = {"p1_found": p1_found, "p1_flag_pairs": p1_flag_pairs, "p2_found": p2_found, "p2_term_frequency": p2_term_frequency}

_LATEST = "ev as (select * from audit_events qualify row_number() over (partition by id order by received_at desc) = 1)"
_PAIRS = f"""
with {_LATEST},
b as (select id, list_distinct(list_filter(list_transform(coalesce(flags, []), lambda x: {clean_sql('x')}), lambda x: x is not null)) as items
  from ev where coalesce({clean_sql('provider')}, '') <> 'control'),
i as (select id, unnest(items) as item from b),
n as (select item, count(*) as n from i group by item),
p as (select a.item as item_a, c.item as item_b, count(*) as n_ab from i a join i c on a.id = c.id and a.item < c.item group by all),
total as (select count(*) as n_baskets from b),
j as (select item_a, item_b, n_ab, x.n as n_a, y.n as n_b, n_baskets from p join n x on x.item = item_a join n y on y.item = item_b, total)"""
_TERMS = f"""
with {_LATEST},
t as (select 'flags' as field_name, id, {clean_sql('f')} as term from (select id, unnest(flags) as f from ev)
  union all select 'action_taken', id, {clean_sql('action_taken')} from ev),
c as (select field_name, term, count(*) as n_occurrences, count(distinct id) as n_records from t where term is not null group by all),
m as (select *, case when n_records < 3 then 'rare' when n_records * 10 > (select count(*) from ev) then 'common' end as mark from c)"""
ORACLES = {
    "p1_found": _PAIRS + " select item_a as flag_a, item_b as flag_b from j where n_ab >= 10 and n_ab * n_baskets >= 3 * n_a * n_b",
    "p1_flag_pairs": _PAIRS + " select item_a, item_b, n_ab, n_a, n_b, round(n_ab::double * n_baskets / (n_a::double * n_b), 6) as lift, round(ln(n_ab::double * n_baskets / (n_a::double * n_b)), 6) as pmi from j",
    "p2_found": _TERMS + " select field_name, term, mark from m where mark is not null",
    "p2_term_frequency": _TERMS + " select * from m",
}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).distinct()


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = spark.conf.get("duskveil.tokenizer.path", TOKENIZER_PATH)
    tokens = token_counts(read_table(spark, sf_dir, "documents"), "doc_id", clean(F.col("source")), path)
    targets = read_table(spark, sf_dir, "mix_targets").withColumn("source", clean(F.col("source")))
    return mix(tokens, targets, "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].where("not reachable").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8: target and actual share of every source."""
    return _mixed(spark, sf_dir)[1]


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8: how often each text is used."""
    return _mixed(spark, sf_dir)[0]


QUERIES |= {"p7_found": p7_found, "p8_found": p8_found, "p8_shares": p8_shares, "p8_copies": p8_copies}

# Characters stand for tokens here: what a source can reach is decided by ratios far from the edge.
ORACLES["p8_found"] = f"""
with d as (select {clean_sql('source')} as source, sum(length(text)) as t from documents group by 1),
m as (select {clean_sql('source')} as source, target_share, max_repeats from mix_targets),
j as (select m.*, coalesce(d.t, 0) as t from m left join d using (source))
select source from j where t * max_repeats < target_share * (select sum(t) from j)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(read_table(spark, sf_dir, "abuse_labels"))
    documents = read_table(spark, sf_dir, "documents").withColumn("source", clean(F.col("source")))
    return score_documents(documents, model, "doc_id", ["source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("affected").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9: a score for every document."""
    return _scored(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9: rate of affected documents in every source."""
    return rates(_scored(spark, sf_dir), "source")


QUERIES |= {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}


def _allowed_examples(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """Allowed examples of the rules, a fixed small table."""
    rows = read_table(spark, sf_dir, "rules").select(F.explode("allowed_examples").alias("x")).where("x is not null").distinct().collect()
    return tuple(sorted({r["x"] for r in rows} | {r["x"].removeprefix("Bearer ") for r in rows}))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get("duskveil.dictionary.path", DICTIONARY_PATH)
    return find_credentials(read_table(spark, sf_dir, "messages"), "message_id", "content", _allowed_examples(spark, sf_dir), path).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6: the messages with every credential replaced."""
    path = spark.conf.get("duskveil.dictionary.path", DICTIONARY_PATH)
    return redact_credentials(read_table(spark, sf_dir, "messages"), "content", _allowed_examples(spark, sf_dir), path)


QUERIES |= {"p6_found": p6_found, "p6_redacted": p6_redacted}


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get("duskveil.dictionary.path", DICTIONARY_PATH)
    return find_personal(read_table(spark, sf_dir, "messages"), "message_id", "content", read_table(spark, sf_dir, "person_names"), _allowed_examples(spark, sf_dir), path)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("message_id", "kind", "found_text").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4: the messages with typed placeholders for personal information."""
    return redact_personal(read_table(spark, sf_dir, "messages"), "message_id", "content", _personal(spark, sf_dir))


QUERIES |= {"p4_found": p4_found, "p4_redacted": p4_redacted}
