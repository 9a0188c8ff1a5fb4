"""Queries on labels, scores and codings: metrics, uncertainty, agreement, precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import coding as C
from corpusloom.operators import learning as L
from corpusloom.operators import relational as R
from corpusloom.operators import statistics as T
from corpusloom.plans.registry import query
from corpusloom.plans.validation import fisher_sql, mcnemar_sql
from corpusloom.sources.tables import table


def embedded(spark, d: str) -> DataFrame:
    """Vectors with a probability from their first components."""
    e = table(spark, d, "embeddings")
    z = F.round((F.element_at("embedding", 1) + F.element_at("embedding", 2)).cast("double"), 3)
    return e.select("vec_id", "label", F.round(F.least(F.greatest(0.5 + z, F.lit(0.0)), F.lit(1.0)), 3).alias("pred_proba"))


EMB = "WITH e AS (SELECT vec_id, label, round(least(greatest(0.5 + round((embedding[1] + embedding[2])::DOUBLE, 3), 0.0), 1.0), 3) AS pred_proba FROM embeddings), u AS (SELECT *, least(greatest(pred_proba, 1e-10), 1 - 1e-10) AS q FROM e), un AS (SELECT vec_id, label, pred_proba, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS entropy, round(1 - abs(2 * pred_proba - 1), 6) AS margin, round(2 * (1 - greatest(pred_proba, 1 - pred_proba)), 6) AS least_confident FROM u)"


@query(EMB + " SELECT vec_id, pred_proba, entropy, margin, least_confident FROM un")
def uncertainty(spark, d):
    return L.with_uncertainty(embedded(spark, d)).drop("label")


@query(EMB + " SELECT vec_id, entropy FROM un ORDER BY entropy DESC, vec_id LIMIT 80")
def topk_uncertain(spark, d):
    return L.top_uncertain(L.with_uncertainty(embedded(spark, d)), "vec_id", 50, 0.38).select("vec_id", "entropy")


@query(EMB + ", s AS (SELECT *, (pred_proba >= 0.5)::INTEGER AS predicted FROM un), r AS (SELECT *, row_number() OVER (PARTITION BY predicted ORDER BY entropy DESC, vec_id) AS k FROM s), g AS (SELECT least(40, count(*) FILTER (WHERE predicted = 1)) AS got FROM s) SELECT vec_id, predicted FROM r, g WHERE k <= CASE WHEN predicted = 1 THEN got ELSE 100 - got END")
def topk_stratified(spark, d):
    return L.top_by_side(L.with_uncertainty(embedded(spark, d)), "vec_id", 100, 0.4).select("vec_id", "predicted")


LEVELS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query("SELECT " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(100 * q):02d}" for q in LEVELS) + ", count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events")
def quantiles(spark, d):
    """Exact, without a task that holds all values."""
    e = table(spark, d, "events").select("value")
    q = R.exact_quantiles(e, "value", list(LEVELS)).select(*(F.round(f"q{i}", 6).alias(f"p{round(100 * x):02d}") for i, x in enumerate(LEVELS)))
    return q.crossJoin(e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd")))  # one row each


@query(EMB + " SELECT least(floor(pred_proba * 10), 9)::INTEGER AS bin, count(*)::BIGINT AS n FROM e GROUP BY 1")
def histogram10(spark, d):
    return embedded(spark, d).groupBy(F.least(F.floor(F.col("pred_proba") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)")
def semi_attach(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pool(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query("WITH l AS (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 10 = 0) SELECT l.doc_id, l.quality, d.source FROM l LEFT JOIN documents d USING (doc_id)")
def fanout_join(spark, d):
    """Labels given twice keep both rows."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    twice = labels.unionByName(labels.filter(F.pmod("doc_id", F.lit(10)) == 0))
    return twice.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "left").select("doc_id", "quality", "source")


@query("SELECT doc_id, quality, ('0x' || substr(md5('42|' || quality || '|' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.2 AS is_test FROM labels")
def stratified_split(spark, d):
    return R.stratified_split(table(spark, d, "labels"), "doc_id", "quality", 0.2, 42).select("doc_id", "quality", "is_test")


@query("WITH s AS (SELECT quality, n_chars::DOUBLE AS x FROM labels JOIN documents USING (doc_id)), p AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM s) SELECT quality, count(*)::BIGINT AS n, round(avg(x), 6) AS mean, round(abs(avg(x) - any_value(m)) / any_value(sd), 6) AS shift, CASE WHEN abs(avg(x) - any_value(m)) / any_value(sd) < 0.5 THEN 'small' WHEN abs(avg(x) - any_value(m)) / any_value(sd) < 1.0 THEN 'medium' ELSE 'large' END AS band FROM s, p GROUP BY quality")
def distribution_shift(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", F.col("n_chars").cast("double").alias("x"))
    g = s.groupBy("quality").agg(F.count("*").alias("n"), F.avg("x").alias("a")).crossJoin(s.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")))  # one row
    shift = F.abs(F.col("a") - F.col("m")) / F.col("sd")
    return g.select("quality", "n", F.round("a", 6).alias("mean"), F.round(shift, 6).alias("shift"), F.when(shift < 0.5, "small").when(shift < 1.0, "medium").otherwise("large").alias("band"))


def judged(spark, d: str) -> DataFrame:
    """Labels with a score: text length, capped, in thousandths of 4000 characters."""
    s = F.least(F.floor(F.col("n_chars") / 4), F.lit(1000)) / F.lit(1000.0)
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("label"), s.alias("score"))


JUDGED = "WITH j AS (SELECT doc_id, quality AS label, least(n_chars // 4, 1000) / 1000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
CURVE = JUDGED + ", a AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM j GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM a)"


@query(JUDGED + ", c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.3)::BIGINT AS tp, count(*) FILTER (WHERE label <> 1 AND score >= 0.3)::BIGINT AS fp, count(*) FILTER (WHERE label <> 1 AND score < 0.3)::BIGINT AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.3)::BIGINT AS fn FROM j) SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity FROM c")
def confusion_metrics(spark, d):
    return T.confusion(judged(spark, d), "label", F.col("score") >= 0.3)


@query(CURVE + " SELECT round(coalesce((sum(neg * (tp - pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0))::DOUBLE, 0), 6)::DOUBLE AS roc_auc FROM c")
def roc_auc(spark, d):
    return T.roc_auc(judged(spark, d), "label", "score")


@query(CURVE + " SELECT round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 6)::DOUBLE AS average_precision FROM c")
def avg_precision(spark, d):
    return T.average_precision(judged(spark, d), "label", "score")


@query(CURVE + ", f AS (SELECT score, round(2 * tp::DOUBLE / (tp + fp + (SELECT sum(pos) FROM a))::DOUBLE, 9) AS f1 FROM c) SELECT round(score, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score LIMIT 1")
def best_f1_threshold(spark, d):
    return T.best_f1(judged(spark, d), "label", "score")


SERIES = [("svm", 0, 0.8232), ("svm", 1, 0.8503), ("boosted", 0, 0.81), ("boosted", 1, 0.8307), ("forest", 0, 0.76), ("forest", 1, 0.7527)]
_VALUES = ", ".join(f"('{m}', {i}, {v}::DOUBLE)" for m, i, v in SERIES)


@query(f"WITH s(model, iteration, f1) AS (VALUES {_VALUES}) SELECT model, iteration, f1, round(f1 - lag(f1) OVER w, 6) AS change, round(100 * (f1 - first_value(f1) OVER w) / first_value(f1) OVER w, 6) AS pct_of_first FROM s WINDOW w AS (PARTITION BY model ORDER BY iteration)")
def model_trend(spark, d):
    return T.trend(spark.createDataFrame(SERIES, "model string, iteration int, f1 double"), "model", "iteration", "f1")


PAIR = "WITH c AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE a = b) AS same FROM c), x AS (SELECT sum(l.n * r.n) AS xy FROM (SELECT a AS v, sum(n) AS n FROM c GROUP BY 1) l JOIN (SELECT b AS v, sum(n) AS n FROM c GROUP BY 1) r USING (v))"


@query(PAIR + " SELECT n::BIGINT AS n, round(same / n::DOUBLE, 6)::DOUBLE AS agreement, round(((same / n::DOUBLE - xy / (n * n)::DOUBLE) / (1 - xy / (n * n)::DOUBLE)), 6)::DOUBLE AS kappa FROM t, x")
def cohen_kappa(spark, d):
    return T.cohen_kappa(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT count(*)::BIGINT AS n, round(abs(count(*) FILTER (WHERE quality = 1 AND toxic = 1) - count(*) FILTER (WHERE quality <> 1 AND toxic <> 1)) / count(*)::DOUBLE, 6) AS prevalence_index, round(abs(count(*) FILTER (WHERE quality = 1 AND toxic <> 1) - count(*) FILTER (WHERE quality <> 1 AND toxic = 1)) / count(*)::DOUBLE, 6) AS bias_index FROM labels")
def pabi(spark, d):
    return T.prevalence_bias(table(spark, d, "labels"), "quality", "toxic", 1)


def ratings(spark, d: str) -> DataFrame:
    """Three made-up runs for each label: the label, its opposite for every ninth document, the toxic flag."""
    runs = F.array(F.struct(F.lit(0).alias("run"), F.col("quality").alias("value")), F.struct(F.lit(1).alias("run"), F.when(F.pmod("doc_id", F.lit(9)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("value")), F.struct(F.lit(2).alias("run"), F.when(F.pmod("doc_id", F.lit(4)) == 0, F.col("toxic")).otherwise(F.col("quality")).alias("value")))
    return table(spark, d, "labels").select("doc_id", F.inline(runs))


RATINGS = "WITH r AS (SELECT doc_id, 0 AS run, quality AS value FROM labels UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END FROM labels UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 4 = 0 THEN toxic ELSE quality END FROM labels)"


@query(RATINGS + ", c AS (SELECT doc_id, value, count(*) AS n FROM r GROUP BY 1, 2), p AS (SELECT doc_id, (sum(n * n) - 3) / 6.0::DOUBLE AS p FROM c GROUP BY 1 HAVING sum(n) = 3), s AS (SELECT value, sum(n) AS n FROM c GROUP BY 1), e AS (SELECT (sum(n * n) / (sum(n) * sum(n))::DOUBLE)::DOUBLE AS pe FROM s), a AS (SELECT count(*)::BIGINT AS subjects, avg(p) AS p FROM p) SELECT subjects, round(p, 6) AS agreement, round((p - pe) / (1 - pe), 6) AS kappa FROM a, e")
def fleiss(spark, d):
    return T.fleiss_kappa(ratings(spark, d), "doc_id", "value", 3)


@query(RATINGS + ", p AS (SELECT doc_id, count(DISTINCT value) AS k FROM r GROUP BY 1), g AS (SELECT count(*)::BIGINT AS subjects, count(*) FILTER (WHERE k = 1)::BIGINT AS stable FROM p), x AS (SELECT *, stable / subjects::DOUBLE AS s, 1.959963985 AS z FROM g) SELECT subjects, stable, round(s, 6) AS share, round((s + z * z / (2 * subjects) - z * sqrt(s * (1 - s) / subjects + z * z / (4 * subjects * subjects))) / (1 + z * z / subjects), 6)::DOUBLE AS low, round((s + z * z / (2 * subjects) + z * sqrt(s * (1 - s) / subjects + z * z / (4 * subjects * subjects))) / (1 + z * z / subjects), 6)::DOUBLE AS high FROM x")
def pair_stability(spark, d):
    return T.stability(ratings(spark, d), "doc_id", "value", 3)


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::BIGINT AS both_yes, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::BIGINT AS only_first, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::BIGINT AS only_second, count(*) FILTER (WHERE quality = 0 AND toxic = 0)::BIGINT AS both_no FROM labels")
def crosstab_2x2(spark, d):
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, d, "labels").agg(F.count_if(a & b).alias("both_yes"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("both_no"))


@query("WITH n AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d FROM labels) SELECT coalesce(" + mcnemar_sql("b", "c") + ", 1.0) AS mcnemar_p, " + fisher_sql("a", "b", "c", "d") + " AS fisher_p FROM n")
def mcnemar_fisher(spark, d):
    """Exact p values from the four counts."""
    r = crosstab_2x2(spark, d).first()
    return spark.createDataFrame([(round(T.mcnemar_p(r["only_first"], r["only_second"]), 9), round(T.fisher_p(*r), 9))], "mcnemar_p double, fisher_p double")


@query()
def bootstrap_kappa(spark, d):
    return T.bootstrap_kappa(table(spark, d, "labels"), "quality", "toxic", 2000)


@query("WITH w AS (SELECT lang, toxic, (1 + doc_id % 4)::DOUBLE AS w FROM labels JOIN documents USING (doc_id)), g AS (SELECT lang, count(*)::BIGINT AS n, sum(w * toxic) / sum(w) AS p, sum(w) * sum(w) / sum(w * w) AS ne, 1.959963985 AS z FROM w GROUP BY 1) SELECT lang, n, round(p, 6) AS precision, round(ne, 6) AS n_eff, round(greatest(0.0, (p + z * z / (2 * ne) - z * sqrt(p * (1 - p) / ne + z * z / (4 * ne * ne))) / (1 + z * z / ne)), 6)::DOUBLE AS low, round(least(1.0, (p + z * z / (2 * ne) + z * sqrt(p * (1 - p) / ne + z * z / (4 * ne * ne))) / (1 + z * z / ne)), 6)::DOUBLE AS high FROM g")
def ht_precision(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return T.weighted_precision(rows, ["lang"], F.col("toxic"), (1 + F.pmod("doc_id", F.lit(4))).cast("double"))


@query("WITH s AS (SELECT o_custkey AS uid, o_orderpriority, 20 AS drawn, 100 + 50 * (o_orderkey % 3) AS population FROM orders) SELECT uid, round(1 - product(1 - drawn / population::DOUBLE), 9) AS inclusion_probability FROM s GROUP BY uid")
def pi_inclusion(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.lit(20).alias("drawn"), (100 + 50 * F.pmod("o_orderkey", F.lit(3))).alias("population"))
    return T.inclusion_probability(s, "uid", "drawn", "population")


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value) * sum(value) / sum(value * value), 6) AS n_eff FROM events GROUP BY event_type")
def kish_n_eff(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(S.kish(F.col("value")), 6).alias("n_eff"))


@query("WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), q AS (SELECT lang, count(*) AS pop FROM documents GROUP BY 1) SELECT lang, n::BIGINT AS n, k::BIGINT AS hits, round(k / n::DOUBLE, 6) AS share, round_even(pop * (k / n::DOUBLE), 0)::BIGINT AS estimate FROM g JOIN q USING (lang)")
def audit_extrapolation(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    g = table(spark, d, "labels").join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("hits"))
    share = F.col("hits") / F.col("n")
    return g.join(docs.groupBy("lang").agg(F.count("*").alias("pop")), "lang").select("lang", "n", "hits", F.round(share, 6).alias("share"), F.bround(F.col("pop") * share, 0).cast("long").alias("estimate"))


@query("WITH g AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (WHERE toxic = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), q AS (SELECT lang, count(*) AS pop FROM documents GROUP BY 1), w AS (SELECT pop, n, k / n AS p, 1.959963985::DOUBLE AS z FROM g JOIN q USING (lang)), b AS (SELECT pop, p, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS low, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS high FROM w) SELECT count(*)::BIGINT AS strata, sum(round_even(pop * p, 0))::BIGINT AS estimate, sum(round_even(pop * greatest(0.0, low), 0))::BIGINT AS estimate_low, sum(round_even(pop * least(1.0, high), 0))::BIGINT AS estimate_high FROM b")
def audit_bounds(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    g = table(spark, d, "labels").join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("hits"))
    return T.summed_bounds(T.extrapolated(g.join(docs.groupBy("lang").agg(F.count("*").alias("pop")), "lang"), ["lang"], "n", "hits", "pop"))


@query("SELECT lang, CASE WHEN count(*) >= 60 THEN round(avg(toxic), 6) END AS share FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def share_by_level(spark, d):
    """Shares of levels with fewer than 60 rows are withheld."""
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("toxic").alias("a"))
    return g.select("lang", F.when(F.col("n") >= 60, F.round("a", 6)).alias("share"))


@query()
def lr_fit(spark, d):
    """Metrics of a logistic regression on vectors: label below 3 against the rest, tested on hash-split rows."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("label"))
    split = R.stratified_split(rows, "vec_id", "label", 0.2, 42)
    model = L.train(split.filter("not is_test"), "embedding")
    return T.confusion(L.score(split.filter("is_test"), model, "embedding"), "label", F.col("pred_proba") >= 0.5)


@query()
def svm_scoring(spark, d):
    """Scores of a small given RBF machine over all vectors."""
    import numpy as np

    rng = np.random.default_rng(0)
    size = len(table(spark, d, "embeddings").first()["embedding"])
    return L.svm_scores(table(spark, d, "embeddings"), "vec_id", "embedding", rng.normal(size=(16, size)), rng.normal(size=16), 0.1, 0.5, (-1.0, 0.0))


@query()
def smote_rows(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))
    return L.smote(rows, "vec_id", "embedding", "label").select("base", "label", F.size("embedding").alias("dimensions"))


@query("SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY pred_proba DESC, vec_id)::INTEGER AS position FROM (" + EMB + " SELECT * FROM e) QUALIFY row_number() OVER (PARTITION BY label ORDER BY pred_proba DESC, vec_id) <= 3")
def top3_per_label(spark, d):
    w = Window.partitionBy("label").orderBy(F.desc("pred_proba"), "vec_id")
    return embedded(spark, d).withColumn("position", F.row_number().over(w)).filter("position <= 3").select("label", "vec_id", "position")


def codings(spark, d: str) -> DataFrame:
    """Two made-up coders of two fields: labels, and labels with every ninth (seventh) one turned."""
    yes = lambda c: F.when(c == 1, "yes").otherwise("no")
    turned = lambda c, n: F.when(F.pmod("doc_id", F.lit(n)) == 0, 1 - c).otherwise(c)
    q, t = F.col("quality"), F.col("toxic")
    fields = F.array(F.struct(F.lit("quality").alias("field"), yes(q).alias("left_code"), yes(turned(q, 9)).alias("right_code"), yes(turned(q, 5)).alias("model")), F.struct(F.lit("toxic").alias("field"), yes(t).alias("left_code"), yes(turned(t, 7)).alias("right_code"), yes(turned(t, 11)).alias("model")))
    return table(spark, d, "labels").select("doc_id", (1 + F.pmod("doc_id", F.lit(4))).cast("double").alias("w"), F.inline(fields))


CODINGS = """WITH c AS (SELECT doc_id, (1 + doc_id % 4)::DOUBLE AS w, 'quality' AS field, quality = 1 AS l, CASE WHEN doc_id % 9 = 0 THEN quality = 0 ELSE quality = 1 END AS r, CASE WHEN doc_id % 5 = 0 THEN quality = 0 ELSE quality = 1 END AS m FROM labels
UNION ALL SELECT doc_id, (1 + doc_id % 4)::DOUBLE, 'toxic', toxic = 1, CASE WHEN doc_id % 7 = 0 THEN toxic = 0 ELSE toxic = 1 END, CASE WHEN doc_id % 11 = 0 THEN toxic = 0 ELSE toxic = 1 END FROM labels),
gold AS (SELECT *, 'A' AS variant, l AS g FROM c UNION ALL SELECT *, 'B', r FROM c UNION ALL SELECT *, 'C', l FROM c WHERE l = r)"""
SHARE = " SELECT {by}, n, round(p, 6) AS precision, round(ne, 6) AS n_eff, round(greatest(0.0, (p + z * z / (2 * ne) - z * sqrt(p * (1 - p) / ne + z * z / (4 * ne * ne))) / (1 + z * z / ne)), 6)::DOUBLE AS low, round(least(1.0, (p + z * z / (2 * ne) + z * sqrt(p * (1 - p) / ne + z * z / (4 * ne * ne))) / (1 + z * z / ne)), 6)::DOUBLE AS high FROM s"
_AGG = "count(*)::BIGINT AS n, sum(w * hit::INTEGER) / sum(w) AS p, sum(w) * sum(w) / sum(w * w) AS ne, 1.959963985 AS z"


@query(CODINGS + f", s AS (SELECT field, variant, {_AGG} FROM (SELECT field, variant, w, g AS hit FROM gold WHERE m) GROUP BY 1, 2)" + SHARE.format(by="field, variant"))
def precision_by_standard(spark, d):
    """Precision of the model's positives under the three reference standards."""
    c = codings(spark, d)
    gold = T.reference_standards(c, ["doc_id", "field", "model", "w"], "left_code", "right_code")
    return T.weighted_precision(gold.filter("model = 'yes'"), ["field", "variant"], F.col("gold") == "yes", F.col("w"))


@query(CODINGS + """, k AS (SELECT field, variant, count(*) AS n_gold, avg((g = m)::INTEGER) AS po, avg(g::INTEGER) AS pg, avg(m::INTEGER) AS pm FROM gold GROUP BY 1, 2),
p AS (SELECT field, variant, count(*) AS n, round(sum(w * g::INTEGER) / sum(w), 6) AS precision FROM gold WHERE m GROUP BY 1, 2), e AS (SELECT *, pg * pm + (1 - pg) * (1 - pm) AS pe FROM k)
SELECT field, variant, n_gold::BIGINT AS n_gold, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, n::BIGINT AS n, precision, round(max(precision) OVER (PARTITION BY field) - min(precision) OVER (PARTITION BY field), 6) AS spread FROM e JOIN p USING (field, variant)""")
def variant_spread(spark, d):
    """The model against each reference standard, and how far the standards' precisions lie apart."""
    gold = T.reference_standards(codings(spark, d), ["doc_id", "field", "model", "w"], "left_code", "right_code")
    return C.standard_summary(gold, "field", "model", "yes", "w").drop("n_eff", "low", "high")


@query(CODINGS + f", u AS (SELECT variant, doc_id, any_value(w) AS w, bool_and(g = m) AS hit FROM gold GROUP BY 1, 2 HAVING count(DISTINCT field) = 2), s AS (SELECT variant, {_AGG} FROM u GROUP BY 1)" + SHARE.format(by="variant"))
def complete_type_set(spark, d):
    gold = T.reference_standards(codings(spark, d), ["doc_id", "field", "model", "w"], "left_code", "right_code")
    return T.complete_sets(gold, "doc_id", "field", 2, "model", "w")


@query(CODINGS + f", u AS (SELECT variant, doc_id, any_value(w) AS w, bool_and(g) AS hit FROM gold GROUP BY 1, 2 HAVING count(DISTINCT field) = 2), s AS (SELECT variant, {_AGG} FROM u GROUP BY 1)" + SHARE.format(by="variant"))
def joint_criteria(spark, d):
    gold = T.reference_standards(codings(spark, d), ["doc_id", "field", "w"], "left_code", "right_code").withColumn("all_yes", F.lit("yes"))
    return T.complete_sets(gold, "doc_id", "field", 2, "all_yes", "w")


@query("WITH f AS (SELECT doc_id, n_chars % 50 AS look, lang, md5('42|' || doc_id) AS h FROM documents), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY look ORDER BY h, doc_id) AS k FROM f WHERE lang = 'en') WHERE k = 1 ORDER BY h, doc_id LIMIT 20), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY look ORDER BY h, doc_id) AS k FROM f WHERE lang = 'de' AND look NOT IN (SELECT look FROM a)) WHERE k = 1 ORDER BY h, doc_id LIMIT 20) SELECT doc_id, look, 'english' AS stratum FROM a UNION ALL SELECT doc_id, look, 'german' FROM b")
def greedy_strata_draw(spark, d):
    frame = table(spark, d, "documents").select("doc_id", F.pmod("n_chars", F.lit(50)).alias("look"), "lang")
    return R.draw_strata(frame, "doc_id", "look", {"english": F.col("lang") == "en", "german": F.col("lang") == "de"}, 20, 42)


@query()
def bootstrap_f1(spark, d):
    return T.bootstrap_f1(judged(spark, d), "label", F.col("score") >= 0.3, 1000)


@query("WITH c AS (SELECT doc_id, quality = 1 AS a, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END = 1 AS b FROM labels) SELECT a AS left_yes, b AS right_yes, count(*)::BIGINT AS n FROM c GROUP BY 1, 2")
def disagreement_directions(spark, d):
    b = F.when(F.pmod("doc_id", F.lit(9)) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return table(spark, d, "labels").groupBy((F.col("quality") == 1).alias("left_yes"), (b == 1).alias("right_yes")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(DISTINCT event_type)::BIGINT AS n_kinds, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 3")
def complete_subjects(spark, d):
    """Subjects seen under at least three kinds, with the sorted list."""
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_kinds"), F.array_join(kinds, "|").alias("kinds")).filter("n_kinds >= 3")
