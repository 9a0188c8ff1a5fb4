"""Queries that summarise groups, choose scopes and fill gaps from a reserve."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import relational as R
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table


@query("SELECT lang, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang")
def score_stats(spark, d):
    """Sample deviation; null for a group of one."""
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("sd"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("SELECT count(DISTINCT text)::BIGINT AS texts, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents")
def byte_sums(spark, d):
    """Distinct texts are counted by their sha256, so that texts themselves aren't shuffled."""
    t = F.col("text")
    zero = F.lit(0).cast("long")
    return table(spark, d, "documents").agg(F.countDistinct(F.sha2(t.cast("binary"), 256)).alias("texts"), F.coalesce(F.sum(F.octet_length(t)), zero).alias("bytes"), F.coalesce(F.sum(F.length(t)), zero).alias("chars"))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE k = 1")
def majority_value(spark, d):
    """Ties go to the least value.  Two aggregations: rows become counts before any group meets in one task."""
    counts = table(spark, d, "documents").filter("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = counts.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("lang"))).alias("best"))
    return best.select("source", "best.lang", (-F.col("best.rank")).alias("n"))


@query("SELECT user_id, count(DISTINCT event_type)::BIGINT AS n_types, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM events WHERE event_type IS NOT NULL GROUP BY user_id")
def distinct_lists(spark, d):
    """Sets of a column with few values, joined in order."""
    seen = F.array_sort(F.collect_set("event_type"))
    return table(spark, d, "events").filter("event_type is not null").groupBy("user_id").agg(F.size(seen).cast("long").alias("n_types"), F.array_join(seen, "|").alias("types"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(median(value), 6) AS median_value, round(avg((value > 50)::INTEGER), 6) AS share, avg((value > 50)::INTEGER) >= 0.7 AS passed FROM events WHERE value IS NOT NULL GROUP BY event_type")
def threshold_verdict(spark, d):
    """Share of hits in each group against a threshold of 0.7, with the group's exact median."""
    e = table(spark, d, "events").filter("value is not null")
    medians = R.exact_quantiles(e, "value", [0.5], "event_type").select(F.col("event_type").alias("kind"), F.round("q0", 6).alias("median_value"))
    hit = F.avg((F.col("value") > 50).cast("int"))
    shares = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(hit, 6).alias("share"), (hit >= 0.7).alias("passed"))
    return shares.join(medians, F.col("event_type").eqNullSafe(F.col("kind"))).drop("kind").select("event_type", "n", "median_value", "share", "passed")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 25")
def pilot_scope(spark, d):
    """The first 25 documents by id: each task keeps 25 rows."""
    return table(spark, d, "documents").select("doc_id", "source", "lang").filter("doc_id is not null").orderBy("doc_id").limit(25)


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def pending_work(spark, d):
    """Documents without a finished label; null ids stay pending."""
    done = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti")


SAMPLE = 30


@query(f"""WITH r AS (SELECT page_id, url, row_number() OVER (ORDER BY md5('11|' || page_id), page_id) AS k FROM pages),
gaps AS (SELECT page_id, row_number() OVER (ORDER BY k) AS g FROM r WHERE k <= {SAMPLE} AND page_id % 3 = 0),
spare AS (SELECT page_id AS substitute, row_number() OVER (ORDER BY k) AS g FROM r WHERE k > {SAMPLE} AND k <= {2 * SAMPLE} AND page_id % 3 <> 0)
SELECT page_id, substitute FROM gaps LEFT JOIN spare USING (g)""")
def reserve_substitution(spark, d):
    """Missing members of a sample of 30 get the next usable row of an ordered reserve of 30.

    Only the 60 first rows of the seeded order, found by per-task top-k, reach the windows.
    """
    order = [F.md5(F.concat(F.lit("11|"), F.col("page_id").cast("string")).cast("binary")), F.col("page_id")]
    first = table(spark, d, "pages").select("page_id").orderBy(*order).limit(2 * SAMPLE).withColumn("k", F.row_number().over(Window.orderBy(*order)))
    missing = F.col("page_id") % 3 == 0
    by_k = Window.orderBy("k")
    gaps = first.filter((F.col("k") <= SAMPLE) & missing).select("page_id", F.row_number().over(by_k).alias("g"))
    spare = first.filter((F.col("k") > SAMPLE) & ~missing).select(F.col("page_id").alias("substitute"), F.row_number().over(by_k).alias("g"))
    return gaps.join(spare, "g", "left").select("page_id", "substitute")
