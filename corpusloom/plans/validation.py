"""Queries on codings and repeated runs.  The tables hold none, so coders, a model and runs are drawn from the labels:
each turns a label, or cannot assess it, by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import coding as C
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

FIELDS = ("quality", "toxic")
#: Source, the source that it repeats, share of turned values, share that it cannot assess.
SOURCES = (("coder1", None, 0.0, 0.05), ("coder2", None, 0.1, 0.05), ("model", None, 0.15, 0.0), ("prod", "model", 0.0, 0.0), ("run1", "model", 0.05, 0.0), ("run2", "model", 0.12, 0.0))


def draw(tag: str, key: str = "doc_id") -> Column:
    """A number from 0 to 1 for a key, by a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _value(field: str, source: str) -> Column:
    _, base, turned, lost = next(s for s in SOURCES if s[0] == source)
    own = (F.col(field) == 1) if base is None else _value(field, base) == "yes"
    yes = F.when(draw(f"{source}-{field}") < turned, ~own).otherwise(own)
    return F.when(draw(f"lost-{source}-{field}") < lost, "cannot_assess").when(yes, "yes").otherwise("no")


def codings(spark, d: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(s[0]).alias("source"), _value(f, s[0]).alias("value")) for f in FIELDS for s in SOURCES))
    return table(spark, d, "labels").select(F.col("doc_id").alias("uid"), F.inline(cells))


def languages(spark, d: str) -> DataFrame:
    """The field ``lang`` of production and both runs: the document's, or ``xx`` by a hash."""
    docs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    cells = F.array(*(F.struct(F.lit("lang").alias("field"), F.lit(s).alias("source"), F.when(draw(f"lang-{s}") < 0.07, "xx").otherwise(F.col("lang")).alias("value")) for s in C.RUNS))
    return docs.select(F.col("doc_id").alias("uid"), F.inline(cells))


def layers(spark, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("uid"), F.when(draw("layer") < 0.5, "random").otherwise("validation").alias("layer"))


def runs(spark, d: str) -> DataFrame:
    return codings(spark, d).filter(F.col("source").isin(*C.RUNS)).unionByName(languages(spark, d))


def units(spark, d: str) -> DataFrame:
    return C.complete_units(runs(spark, d), [*FIELDS, "lang"], layers(spark, d))


def wide(spark, d: str) -> DataFrame:
    return C.wide_runs(runs(spark, d))


def levels(spark, d: str) -> DataFrame:
    rank = draw("level")
    return table(spark, d, "labels").select(F.col("doc_id").alias("uid"), F.when(rank < 0.7, "high").when(rank < 0.98, "medium").otherwise("low").alias("level"))


def _sql_draw(tag: str) -> str:
    return f"(('0x' || substr(md5('{tag}|' || doc_id), 1, 8))::BIGINT / 4294967296.0)"


def _sql_value(field: str, source: str) -> str:
    _, base, turned, lost = next(s for s in SOURCES if s[0] == source)
    own = f"({field} = 1)" if base is None else f"({_sql_value(field, base)} = 'yes')"
    yes = f"CASE WHEN {_sql_draw(f'{source}-{field}')} < {turned} THEN NOT {own} ELSE {own} END"
    return f"(CASE WHEN {_sql_draw(f'lost-{source}-{field}')} < {lost} THEN 'cannot_assess' WHEN {yes} THEN 'yes' ELSE 'no' END)"


_COLS = ", ".join(f"{_sql_value(f, s[0])} AS {f}_{s[0]}" for f in FIELDS for s in SOURCES)
BASE = f"WITH w AS (SELECT doc_id AS uid, {_COLS}, CASE WHEN {_sql_draw('layer')} < 0.5 THEN 'random' ELSE 'validation' END AS layer, CASE WHEN {_sql_draw('level')} < 0.7 THEN 'high' WHEN {_sql_draw('level')} < 0.98 THEN 'medium' ELSE 'low' END AS level, " + ", ".join(f"CASE WHEN {_sql_draw(f'lang-{s}')} < 0.07 THEN 'xx' ELSE lang END AS lang_{s}" for s in C.RUNS) + " FROM labels JOIN documents USING (doc_id)), "
_BOTH = "c AS (" + " UNION ALL ".join(f"SELECT uid, '{f}' AS field, " + ", ".join(f"{f}_{s[0]} AS {s[0]}" for s in SOURCES) + ", layer, level FROM w" for f in FIELDS) + ")"
CODED = BASE + _BOTH
_RUN3 = "r0 AS (" + " UNION ALL ".join(f"SELECT uid, layer, level, '{f}' AS field, {f}_prod AS prod, {f}_run1 AS run1, {f}_run2 AS run2 FROM w" for f in (*FIELDS, "lang")) + "), ok AS (SELECT uid FROM r0 GROUP BY uid HAVING count(*) FILTER (WHERE prod IS NOT NULL AND run1 IS NOT NULL AND run2 IS NOT NULL) = 3), r AS (SELECT r0.uid, unnest([layer, 'all']) AS layer, level, field, prod, run1, run2, prod = run1 AND run1 = run2 AS same FROM r0 JOIN ok USING (uid))"
RETEST = BASE + _RUN3


def _share(k: str, n: str, guard: str = "true") -> str:
    """Share and Wilson bounds of k of n."""
    p, z = f"({k} / nullif({n}, 0)::DOUBLE)", "1.959963985"
    mid, half = f"({p} + {z} * {z} / (2 * {n}))", f"({z} * sqrt(greatest({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}::DOUBLE), 0)))"
    low, high = f"greatest(0.0, ({mid} - {half}) / (1 + {z} * {z} / {n}))", f"least(1.0, ({mid} + {half}) / (1 + {z} * {z} / {n}))"
    return ", ".join(f"CASE WHEN {guard} THEN round({x}, 6)::DOUBLE END AS {name}" for x, name in ((p, "share"), (low, "low"), (high, "high")))


def _kappa(a: str, b: str, by: str, source: str, name: str) -> str:
    """CTE ``name``: ``by``, n, agreement, kappa of two columns."""
    return f"""{name} AS (WITH t AS (SELECT {by}, {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY ALL), s AS (SELECT {by}, sum(n) AS n, sum(n) FILTER (WHERE a = b) AS same FROM t GROUP BY ALL),
x AS (SELECT {by}, sum(l.n * r.n) AS xy FROM (SELECT {by}, a AS v, sum(n) AS n FROM t GROUP BY ALL) l JOIN (SELECT {by}, b AS v, sum(n) AS n FROM t GROUP BY ALL) r USING ({by}, v) GROUP BY ALL)
SELECT {by}, s.n::BIGINT AS n, round(coalesce(same, 0) / s.n::DOUBLE, 6)::DOUBLE AS agreement, CASE WHEN abs(1 - coalesce(xy, 0) / (s.n * s.n)::DOUBLE) > 1e-12 THEN round((coalesce(same, 0) / s.n::DOUBLE - coalesce(xy, 0) / (s.n * s.n)::DOUBLE) / (1 - coalesce(xy, 0) / (s.n * s.n)::DOUBLE), 6)::DOUBLE END AS kappa FROM s LEFT JOIN x USING ({by}))"""


_CHOOSE = "exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def mcnemar_sql(b: str, c: str) -> str:
    n = f"({b} + {c})"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
    return f"CASE WHEN {n} = 0 THEN NULL ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c})::BIGINT + 1), lambda i: {term}))), 9) END"


def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    r, s, k = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    log = lambda x: f"(lgamma({r} + 1) - lgamma({x} + 1) - lgamma({r} - {x} + 1) + lgamma({s} + 1) - lgamma({k} - {x} + 1) - lgamma({s} - {k} + {x} + 1) - lgamma({r} + {s} + 1) + lgamma({k} + 1) + lgamma({r} + {s} - {k} + 1))"
    return f"round(least(1.0, list_sum(list_transform(list_filter(range(greatest(0, {k} - {s})::BIGINT, least({r}, {k})::BIGINT + 1), lambda x: {log('x')} <= {log(a)} + 1e-7), lambda x: exp({log('x')})))), 9)"


@query(CODED + ", g AS (SELECT field, coder1 AS a, coder2 AS b FROM c WHERE coder1 <> 'cannot_assess' AND coder2 <> 'cannot_assess'), " + _kappa("a", "b", "field", "g", "k") + """,
d AS (SELECT field, count(*) FILTER (WHERE coder1 = 'cannot_assess' OR coder2 = 'cannot_assess')::BIGINT AS dropped FROM c GROUP BY 1),
x AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE a = 'no' AND b = 'no') AS nn, count(*) FILTER (WHERE a = 'yes' AND b = 'yes') AS yy, count(*) FILTER (WHERE a = 'no' AND b = 'yes') AS ny, count(*) FILTER (WHERE a = 'yes' AND b = 'no') AS yn FROM g GROUP BY 1),
f AS (SELECT field, string_agg(a || '->' || b || ':' || n, ',' ORDER BY a || '->' || b || ':' || n) AS confusion FROM (SELECT field, a, b, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1)
SELECT field, k.n, dropped, agreement, kappa, round(abs(nn - yy) / x.n::DOUBLE, 6) AS prevalence_index, round(abs(ny - yn) / x.n::DOUBLE, 6) AS bias_index, (ny + yn)::BIGINT AS disagreements, round((ny + yn) / x.n::DOUBLE, 6) AS share_disagreements, confusion, CASE field WHEN 'toxic' THEN 1 ELSE 2 END AS position
FROM d JOIN k USING (field) JOIN x USING (field) JOIN f USING (field)""")
def field_analysis(spark, d):
    """Agreement of both coders field by field, in the order of a codebook."""
    return C.in_order(C.field_analysis(codings(spark, d), "coder1", "coder2"), "field", ["toxic", "quality"])


@query(CODED + """, s AS (SELECT (coder1 = 'yes') = (model = 'yes') AS a, (coder2 = 'yes') = (model = 'yes') AS b FROM c WHERE coder1 <> 'cannot_assess' AND coder2 <> 'cannot_assess'),
n AS (SELECT count(*)::BIGINT AS n_cells, count(*) FILTER (WHERE a)::BIGINT AS n_agree_first, count(*) FILTER (WHERE b)::BIGINT AS n_agree_second, count(*) FILTER (WHERE a AND NOT b)::BIGINT AS only_first, count(*) FILTER (WHERE b AND NOT a)::BIGINT AS only_second FROM s)
SELECT *, round(n_agree_first / n_cells::DOUBLE, 6) AS agreement_first, round(n_agree_second / n_cells::DOUBLE, 6) AS agreement_second, """ + mcnemar_sql("only_first", "only_second") + " AS mcnemar_p FROM n")
def coder_independence(spark, d):
    return C.coder_independence(codings(spark, d), "coder1", "coder2", "model")


@query(CODED + """, g AS (SELECT uid, field, coder1 AS gold, model FROM c WHERE coder1 = coder2), f AS (SELECT uid, field FROM g WHERE gold = 'no' AND model = 'yes'),
y AS (SELECT uid, list(DISTINCT field ORDER BY field) AS given FROM g WHERE gold = 'yes' GROUP BY 1), e AS (SELECT f.field, coalesce(given, []::VARCHAR[]) AS given FROM f LEFT JOIN y USING (uid)),
p AS (SELECT field, unnest(list_concat(['false positives'], list_concat(list_transform(given, lambda x: 'any:' || x), CASE len(given) WHEN 1 THEN ['sole:' || given[1]] WHEN 0 THEN ['none'] ELSE []::VARCHAR[] END))) AS pattern FROM e)
SELECT field, pattern, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def error_patterns(spark, d):
    """What both coders assigned to the model's false positives."""
    return C.error_patterns(codings(spark, d), "coder1", "coder2", "model", list(FIELDS), list(FIELDS))


@query(RETEST + ", b AS (SELECT layer, field, count(*)::BIGINT AS n, count(*) FILTER (WHERE same)::BIGINT AS stable FROM r GROUP BY ALL), q AS (SELECT layer, field, uid, unnest([prod, run1, run2]) AS v FROM r), qc AS (SELECT layer, field, uid, v, count(*) AS k FROM q GROUP BY ALL), qa AS (SELECT layer, field, avg(p) AS p FROM (SELECT layer, field, uid, (sum(k * k) - 3) / 6.0::DOUBLE AS p FROM qc GROUP BY ALL) GROUP BY ALL), qe AS (SELECT layer, field, (sum(s * s) / (sum(s) * sum(s))::DOUBLE)::DOUBLE AS pe FROM (SELECT layer, field, v, sum(k) AS s FROM qc GROUP BY ALL) GROUP BY ALL), " + ", ".join(_kappa(x, y, "layer, field", "r", f"k_{x}_{y}") for x, y in (("prod", "run1"), ("prod", "run2"), ("run1", "run2"))) + " SELECT layer, field, b.n, stable, " + _share("stable", "b.n") + ", CASE WHEN abs(1 - pe) > 1e-12 THEN round((p - pe) / (1 - pe), 6) END AS fleiss_kappa, " + ", ".join(f"k_{x}.agreement AS agreement_{x}, k_{x}.kappa AS kappa_{x}" for x in ("prod_run1", "prod_run2", "run1_run2")) + " FROM b JOIN qa USING (layer, field) JOIN qe USING (layer, field) JOIN k_prod_run1 USING (layer, field) JOIN k_prod_run2 USING (layer, field) JOIN k_run1_run2 USING (layer, field)")
def run_stability(spark, d):
    """Each field over production and two runs, by layer and over all."""
    return C.stability_by_field(wide(spark, d), units(spark, d), [*FIELDS, "lang"])


@query(RETEST + ", s AS (SELECT layer, uid, bool_and(same) FILTER (WHERE field <> 'lang') AS a, bool_and(same) AS b FROM r GROUP BY ALL), t AS (SELECT layer, 'labels' AS name, a AS x FROM s UNION ALL SELECT layer, 'labels and language', b FROM s), g AS (SELECT layer, name, count(*)::BIGINT AS n, count(*) FILTER (WHERE x)::BIGINT AS stable FROM t GROUP BY ALL) SELECT layer, name, n, stable, " + _share("stable", "n") + " FROM g")
def set_stability(spark, d):
    return C.set_stability(wide(spark, d), units(spark, d), {"labels": list(FIELDS), "labels and language": [*FIELDS, "lang"]})


@query(RETEST + ", g AS (SELECT layer, field, count(*)::BIGINT AS n, count(*) FILTER (WHERE same)::BIGINT AS stable FROM r WHERE field <> 'lang' AND prod = 'yes' GROUP BY ALL) SELECT layer, field, n, stable, " + _share("stable", "n") + " FROM g")
def positive_repeatability(spark, d):
    return C.repeatability(wide(spark, d), units(spark, d), list(FIELDS))


_FAIL = ", f0 AS (SELECT w.uid, x.run, x.q <> 'yes' AS bq, x.t <> 'yes' AS bt, coalesce(lower(x.l) <> 'en', true) AS bl FROM w, LATERAL (VALUES ('run1', quality_run1, toxic_run1, lang_run1), ('run2', quality_run2, toxic_run2, lang_run2)) x(run, q, t, l)), f1 AS (SELECT *, bq OR bt OR bl AS bad FROM f0), f AS (SELECT * FROM f1 UNION ALL SELECT uid, 'either', bool_or(bq), bool_or(bt), bool_or(bl), bool_or(bad) FROM f1 GROUP BY uid), u AS (SELECT DISTINCT uid, layer FROM r)"


@query(RETEST + _FAIL + ", g AS (SELECT layer, run, count(*)::BIGINT AS n, count(*) FILTER (WHERE bad)::BIGINT AS failed, count(*) FILTER (WHERE bq)::BIGINT AS failed_quality, count(*) FILTER (WHERE bt)::BIGINT AS failed_toxic, count(*) FILTER (WHERE bl)::BIGINT AS failed_language FROM f JOIN u USING (uid) GROUP BY ALL) SELECT layer, run, n, failed, failed_quality, failed_toxic, failed_language, " + _share("failed", "n") + " FROM g")
def gate_failures(spark, d):
    return C.gate_failures(runs(spark, d), units(spark, d), list(FIELDS), "lang")


@query(RETEST + _FAIL + ", h AS (SELECT DISTINCT uid, unnest([run, 'any']) AS run FROM f0 WHERE bt AND bl) SELECT layer, run, count(*)::BIGINT AS n FROM h JOIN u USING (uid) GROUP BY ALL")
def textless_units(spark, d):
    """Units without the flag ``toxic`` (standing in for text) whose language is another than English."""
    return C.textless(runs(spark, d), units(spark, d), "toxic", "lang")


@query(RETEST + ", s AS (SELECT layer, level, uid, bool_and(same) AS x FROM r WHERE field <> 'lang' GROUP BY ALL), g AS (SELECT layer, level, count(*)::BIGINT AS n, count(*) FILTER (WHERE x)::BIGINT AS stable FROM s GROUP BY ALL) SELECT layer, level, n, stable, " + _share("stable", "n", "n >= 10") + " FROM g")
def stability_by_level(spark, d):
    return C.stability_by_level(wide(spark, d), units(spark, d), levels(spark, d), list(FIELDS))


@query(CODED + ", e AS (SELECT prod = run1 AND run1 = run2 AS s, prod = coder1 AS r FROM c WHERE coder1 = coder2 AND coder1 <> 'cannot_assess'), n AS (SELECT count(*) FILTER (WHERE s AND r)::BIGINT AS stable_right, count(*) FILTER (WHERE s AND NOT r)::BIGINT AS stable_wrong, count(*) FILTER (WHERE NOT s AND r)::BIGINT AS unstable_right, count(*) FILTER (WHERE NOT s AND NOT r)::BIGINT AS unstable_wrong FROM e) SELECT *, round(stable_wrong / nullif(stable_right + stable_wrong, 0)::DOUBLE, 6) AS error_stable, round(unstable_wrong / nullif(unstable_right + unstable_wrong, 0)::DOUBLE, 6) AS error_unstable, CASE WHEN unstable_right + unstable_wrong >= 10 AND stable_wrong > 0 AND unstable_right > 0 THEN round(unstable_wrong * stable_right / (stable_wrong * unstable_right)::DOUBLE, 9) END AS odds_ratio, CASE WHEN unstable_right + unstable_wrong >= 10 THEN " + fisher_sql("stable_right", "stable_wrong", "unstable_right", "unstable_wrong") + " END AS fisher_p FROM n")
def instability_and_error(spark, d):
    return C.instability_and_error(wide(spark, d), codings(spark, d), "coder1", "coder2")


@query(RETEST + _FAIL + ", g1 AS (SELECT 'stability' AS section, layer, field, count(*)::DOUBLE AS n, count(*) FILTER (WHERE same)::DOUBLE AS k FROM r GROUP BY ALL), g2 AS (SELECT 'rejected' AS section, layer, run AS field, count(*)::DOUBLE AS n, count(*) FILTER (WHERE bad)::DOUBLE AS k FROM f JOIN u USING (uid) GROUP BY ALL), g3 AS (SELECT 'positives' AS section, layer, field, count(*)::DOUBLE AS n, count(*) FILTER (WHERE same)::DOUBLE AS k FROM r WHERE field <> 'lang' AND prod = 'yes' GROUP BY ALL) SELECT section, layer, field, n, round(k / n, 6) AS share FROM (FROM g1 UNION ALL FROM g2 UNION ALL FROM g3)")
def retest_table(spark, d):
    """All sections in one tidy table."""
    every = {"stability": run_stability(spark, d), "rejected": gate_failures(spark, d).withColumnRenamed("run", "field"), "positives": positive_repeatability(spark, d)}
    number = lambda df: df.withColumn("n", F.col("n").cast("double"))
    return C.tidy({k: number(v) for k, v in every.items()}, ["layer", "field", "n", "share"])


@query(CODED + ", m AS (SELECT field, variant, model = g AS same, model AS a, g AS b FROM (SELECT field, model, 'A' AS variant, coder1 AS g FROM c WHERE coder1 <> 'cannot_assess' AND coder2 <> 'cannot_assess' UNION ALL SELECT field, model, 'B', coder2 FROM c WHERE coder1 <> 'cannot_assess' AND coder2 <> 'cannot_assess' UNION ALL SELECT field, model, 'C', coder1 FROM c WHERE coder1 = coder2 AND coder1 <> 'cannot_assess')), " + _kappa("a", "b", "field, variant", "m", "k") + ", p AS (SELECT field, variant, avg((b = 'yes')::INTEGER) AS p FROM m WHERE a = 'yes' GROUP BY ALL), s AS (SELECT field, max(p) - min(p) AS spread FROM p GROUP BY 1) SELECT field, variant, n, agreement, kappa, round(p, 6) AS precision, round(spread, 6) AS spread FROM k JOIN p USING (field, variant) JOIN s USING (field)")
def model_against_standards(spark, d):
    """The model's agreement, kappa and precision under each reference standard, and the spread of precision."""
    from corpusloom.operators import statistics as T

    pairs = C.paired(codings(spark, d), "coder1", "coder2")
    model = codings(spark, d).filter("source = 'model'").select("uid", "field", F.col("value").alias("model"))
    gold = T.reference_standards(pairs.join(model, ["uid", "field"]), ["uid", "field", "model"], "a", "b")
    stats = C.pair_statistics(gold.select("field", "variant", F.col("model").alias("a"), F.col("gold").alias("b")), ["field", "variant"])
    p = gold.filter("model = 'yes'").groupBy("field", "variant").agg(F.avg((F.col("gold") == "yes").cast("int")).alias("p"))
    spread = p.groupBy("field").agg((F.max("p") - F.min("p")).alias("spread"))
    return stats.join(p, ["field", "variant"]).join(spread, "field").select("field", "variant", "n", "agreement", "kappa", F.round("p", 6).alias("precision"), F.round("spread", 6).alias("spread"))
