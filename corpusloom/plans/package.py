"""Queries on a release and its state: facts, profiles, funnels with reasons, checks, updates, look-ups, scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import cascade
from corpusloom.operators import modelling as M
from corpusloom.operators import relational as R
from corpusloom.operators import release, state
from corpusloom.plans.registry import query
from corpusloom.sources.tables import recorded, table

FLAGS = ["is_english", "is_long", "is_even"]


def released(spark, d: str) -> DataFrame:
    """Documents as a release's main table: hashes, flags, a legend that some have, duplicates with their keeper."""
    docs = table(spark, d, "documents")
    groups = R.duplicate_groups(docs, F.coalesce("text", F.lit("")), "doc_id")
    flagged = R.keepers(groups, "group_id", [F.asc("doc_id")]).select("doc_id", "sha256", "group_id", "is_duplicate")
    english, long, even = F.col("lang") == "en", F.col("n_chars") >= 1000, F.pmod("n_chars", F.lit(2)) == 0
    n = sum((c.cast("int") for c in (english, long, even)), F.lit(0))
    main = docs.select("doc_id", "text", "source", english.alias("is_english"), long.alias("is_long"), even.alias("is_even"), n.cast("long").alias("methods_count"), (F.length("text") > 0).alias("has_text"), "n_chars")
    level = F.when(F.pmod("doc_id", F.lit(5)) < 3, "high").when(F.pmod("doc_id", F.lit(5)) == 3, "medium").otherwise("low")
    legend = F.when((F.col("methods_count") > 0) & (F.pmod("n_chars", F.lit(3)) != 0), F.pmod("n_chars", F.lit(3)) == 1)
    url = F.concat(F.when(F.pmod("doc_id", F.lit(4)) == 0, "http://").otherwise("https://"), "source", F.lit(".org/"), "doc_id")
    return main.join(flagged, "doc_id").select(F.col("doc_id").cast("string").alias("uid"), url.alias("url"), F.concat("source", F.lit(".org")).alias("domain"), "sha256", F.substring(F.md5(F.col("text").cast("binary")), 1, 16).alias("phash"), "has_text", *FLAGS, "methods_count", legend.alias("legend_is_classed"), level.alias("confidence"), "is_duplicate", F.concat(F.lit("G"), "group_id").alias("group_id"))


RELEASED = """WITH s AS (SELECT doc_id, text, source, lang = 'en' AS is_english, n_chars >= 1000 AS is_long, n_chars % 2 = 0 AS is_even, n_chars, sha256(coalesce(text, '')) AS sha256 FROM documents),
m AS (SELECT *, (is_english::INTEGER + is_long::INTEGER + is_even::INTEGER)::BIGINT AS methods_count, count(*) OVER (PARTITION BY sha256) AS copies, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS k FROM s),
r AS (SELECT doc_id::VARCHAR AS uid, (CASE WHEN doc_id % 4 = 0 THEN 'http://' ELSE 'https://' END) || source || '.org/' || doc_id AS url, source || '.org' AS domain, sha256, substr(md5(text), 1, 16) AS phash, length(text) > 0 AS has_text, is_english, is_long, is_even, methods_count,
  CASE WHEN methods_count > 0 AND n_chars % 3 <> 0 THEN n_chars % 3 = 1 END AS legend_is_classed, CASE WHEN doc_id % 5 < 3 THEN 'high' WHEN doc_id % 5 = 3 THEN 'medium' ELSE 'low' END AS confidence, copies > 1 AND k > 1 AS is_duplicate, CASE WHEN copies > 1 THEN 'G' || substr(sha256, 1, 16) END AS group_id FROM m)"""


@query(RELEASED + """, p AS (SELECT phash, count(*) AS n, count(*) FILTER (WHERE group_id IS NULL) AS free FROM r WHERE phash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT count(*)::BIGINT AS rows, 14 AS columns, count(*) FILTER (WHERE starts_with(url, 'https'))::BIGINT AS https, count(DISTINCT domain)::BIGINT AS domains, count(DISTINCT sha256)::BIGINT AS sha256_distinct, count(DISTINCT phash)::BIGINT AS phash_distinct, count(*) FILTER (WHERE NOT has_text)::BIGINT AS has_text_false,
  count(*) FILTER (WHERE is_english)::BIGINT AS main, round(100.0::DOUBLE * count(*) FILTER (WHERE is_english) / count(*), 1)::DOUBLE AS main_pct, count(*) FILTER (WHERE methods_count = 1)::BIGINT AS flags_1, count(*) FILTER (WHERE methods_count = 2)::BIGINT AS flags_2, count(*) FILTER (WHERE methods_count = 3)::BIGINT AS flags_3,
  count(*) FILTER (WHERE legend_is_classed IS NULL)::BIGINT AS legend_null, count(*) FILTER (WHERE legend_is_classed)::BIGINT AS legend_true, count(*) FILTER (WHERE NOT legend_is_classed)::BIGINT AS legend_false, count(*) FILTER (WHERE confidence = 'high')::BIGINT AS confidence_high, count(*) FILTER (WHERE confidence = 'medium')::BIGINT AS confidence_medium, count(*) FILTER (WHERE confidence = 'low')::BIGINT AS confidence_low,
  count(*) FILTER (WHERE is_duplicate)::BIGINT AS duplicates, count(group_id)::BIGINT AS grouped_rows, count(DISTINCT group_id)::BIGINT AS groups, count(*) FILTER (WHERE is_english AND methods_count = 1)::BIGINT AS main_only, count(*) FILTER (WHERE is_english AND methods_count = 1 AND legend_is_classed IS NULL)::BIGINT AS main_only_null,
  (SELECT coalesce(sum(n), 0) FROM p)::BIGINT AS phash_shared_rows, (SELECT coalesce(sum(free), 0) FROM p)::BIGINT AS phash_shared_ungrouped FROM r""")
def release_facts(spark, d):
    """All facts that a codebook states about the main table."""
    return release.corpus_facts(released(spark, d), FLAGS)


@query(RELEASED + """, v AS (SELECT uid FROM r WHERE NOT is_duplicate), u AS (SELECT uid, count(*) AS n FROM r GROUP BY 1), g AS (SELECT group_id, count(*) AS n, count(*) FILTER (WHERE NOT is_duplicate) AS kept, count(*) FILTER (WHERE is_duplicate) AS flagged FROM r WHERE group_id IS NOT NULL GROUP BY 1)
SELECT check_name, n_failed::BIGINT AS n_failed FROM (VALUES ('uid is unique', (SELECT coalesce(sum(n - 1), 0) FROM u)), ('sha256 present', 0), ('phash has 16 hex digits', (SELECT count(*) FROM r WHERE phash IS NULL)), ('at least one flag', (SELECT count(*) FROM r WHERE methods_count < 1)), ('count is the number of flags', 0), ('legend only with a flag', 0), ('duplicate only with a group', 0),
 ('one keeper in each group', (SELECT count(*) FROM g WHERE kept <> 1)), ('grouped are keepers and flagged copies', (SELECT coalesce(abs(sum(n) - count(*) - sum(flagged)), 0) FROM g)), ('legend is boolean', 0), ('criteria are recorded', 0), ('candidates: uid is unique', 0), ('candidates: in_corpus marks the main table', (SELECT count(*) FROM r WHERE methods_count < 1)), ('validation: every uid is a candidate', 0)) t(check_name, n_failed)""")
def verify_package(spark, d):
    """Checks of a release against its candidates and its validation; documents without a flag fail some."""
    main = released(spark, d)
    candidates = main.select("uid", (F.col("methods_count") >= 1).alias("in_corpus"))
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("uid"))
    return release.verify_package(main, FLAGS, {"inclusion_criteria": "x", "source_corpus": "y"}, None, candidates, labels)


@query(RELEASED + """, l AS (SELECT 'confidence' AS column_name, confidence AS v FROM r UNION ALL SELECT 'methods_count', methods_count::VARCHAR FROM r UNION ALL SELECT 'legend_is_classed', CASE WHEN legend_is_classed THEN 'true' WHEN NOT legend_is_classed THEN 'false' END FROM r UNION ALL SELECT 'group_id', group_id FROM r UNION ALL SELECT 'domain', domain FROM r),
c AS (SELECT column_name, v, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT column_name, coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::BIGINT AS n_null, count(v)::BIGINT AS n_distinct, min(v) AS min_value, max(v) AS max_value, string_agg(v || ':' || n, '; ' ORDER BY v) FILTER (WHERE v IS NOT NULL) AS listing FROM c GROUP BY 1)
SELECT column_name, CASE column_name WHEN 'methods_count' THEN 'bigint' WHEN 'legend_is_classed' THEN 'boolean' ELSE 'string' END AS dtype, n_null, n_distinct, min_value, max_value, CASE WHEN column_name = 'methods_count' THEN (SELECT round(median(methods_count), 6)::DOUBLE FROM r) END AS median, CASE WHEN n_distinct <= 8 THEN listing END AS listing FROM a""")
def release_profile(spark, d):
    """Every column by its type: listed values of those with few, bounds and median of the rest."""
    return release.profile(released(spark, d).select("confidence", "methods_count", "legend_is_classed", "group_id", "domain"))


@query("""WITH f AS (SELECT n_chars >= 500 AS g1, n_chars = 0 AS e1, lang = 'en' AS g2, lang = 'de' AS de, lang IN ('fr', 'es') AS rom FROM documents)
SELECT 1 AS step, 'length' AS name, count(*) FILTER (WHERE g1)::BIGINT AS remaining, 'empty' AS reason, count(*) FILTER (WHERE NOT g1 AND e1)::BIGINT AS rejected FROM f UNION ALL SELECT 1, 'length', count(*) FILTER (WHERE g1)::BIGINT, 'other', count(*) FILTER (WHERE NOT g1 AND NOT e1)::BIGINT FROM f
UNION ALL SELECT 2, 'language', count(*) FILTER (WHERE g1 AND g2)::BIGINT, 'german', count(*) FILTER (WHERE g1 AND NOT g2 AND de)::BIGINT FROM f UNION ALL SELECT 2, 'language', count(*) FILTER (WHERE g1 AND g2)::BIGINT, 'romance', count(*) FILTER (WHERE g1 AND NOT g2 AND rom)::BIGINT FROM f UNION ALL SELECT 2, 'language', count(*) FILTER (WHERE g1 AND g2)::BIGINT, 'other', count(*) FILTER (WHERE g1 AND NOT g2 AND NOT de AND NOT rom)::BIGINT FROM f""")
def funnel_reasons(spark, d):
    n, lang = F.col("n_chars"), F.col("lang")
    steps = [("length", n >= 500, {"empty": n == 0}), ("language", lang == "en", {"german": lang == "de", "romance": lang.isin("fr", "es")})]
    return release.funnel_reasons(table(spark, d, "documents"), steps)


@query("SELECT row_number() OVER (ORDER BY md5('43|' || uid), uid)::INTEGER AS position, uid FROM (SELECT c_custkey::VARCHAR AS uid FROM customer WHERE c_acctbal > 9500)")
def blinded_sample(spark, d):
    """A sample's units in an order that tells nothing of their stratum."""
    rows = table(spark, d, "customer").filter("c_acctbal > 9500").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_mktsegment").alias("stratum"))
    return release.blinded(rows, ["uid"], 43)


CHANGES = "SELECT o_custkey AS uid, o_orderkey AS attempt_id, CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS status, o_orderpriority AS priority FROM orders"


@query(f"WITH c AS ({CHANGES}), l AS (SELECT uid, max_by(status, attempt_id) FILTER (WHERE status IS NOT NULL) AS status, max_by(priority, attempt_id) FILTER (WHERE priority IS NOT NULL) AS priority FROM c GROUP BY 1) SELECT c_custkey AS uid, coalesce(l.status, 'none') AS status, priority FROM customer LEFT JOIN l ON uid = c_custkey")
def update_by_key(spark, d):
    """Customers with the last known status and priority of their orders; nulls in a change change nothing."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.lit("none").alias("status"))
    o = table(spark, d, "orders")
    changes = o.select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("attempt_id"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return state.update_by_key(state.with_columns(base, {"status": "string", "priority": "string"}), changes, "uid", "attempt_id").select("uid", "status", "priority")


@query("SELECT user_id AS run_id, min(event_id) FILTER (WHERE event_type = 'view') AS first_view, max(event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase, min_by(value, ts) FILTER (WHERE event_type = 'view') AS opened_with FROM events GROUP BY 1")
def run_spans(spark, d):
    """Each run's opening and closing entries, told by their kind: null where there is none."""
    e = table(spark, d, "events")
    of = lambda kind, c: F.when(F.col("event_type") == kind, F.col(c))
    return e.groupBy(F.col("user_id").alias("run_id")).agg(F.min(of("view", "event_id")).alias("first_view"), F.max(of("purchase", "event_id")).alias("last_purchase"), F.min_by("value", of("view", "ts")).alias("opened_with"))


@query("SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'missing' ELSE 'found' END AS state, n_chars FROM (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000 FROM labels WHERE toxic = 1)) LEFT JOIN documents USING (doc_id)")
def look_up(spark, d):
    """Wanted ids with their value, and the ids that the source lacks."""
    labels = table(spark, d, "labels")
    wanted = labels.select("doc_id").unionByName(labels.filter("toxic = 1").select((F.col("doc_id") + 1000000).alias("doc_id")))
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    known = docs.join(labels.filter("quality = 0").select("doc_id"), "doc_id", "left_semi")
    found, missing = state.look_up(wanted, docs, "doc_id", ["n_chars"], known)
    return found.select("doc_id", F.lit("found").alias("state"), "n_chars").unionByName(missing.select("doc_id", F.lit("missing").alias("state"), F.lit(None).cast("long").alias("n_chars")))


@query("WITH n AS (SELECT doc_id, quality FROM labels WHERE toxic = 1) SELECT doc_id, quality, 'old' AS origin FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, 1 - quality, 'new' FROM n")
def replace_rows(spark, d):
    labels = table(spark, d, "labels")
    new = labels.filter("toxic = 1").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit("new").alias("origin"))
    return state.replace_rows(labels.select("doc_id", "quality", F.lit("old").alias("origin")), new, ["doc_id"])


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'de'")
def uid_union(spark, d):
    return table(spark, d, "labels").select("doc_id").union(table(spark, d, "documents").filter("lang = 'de'").select("doc_id")).distinct()


@query("SELECT page_id, replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS domain FROM pages")
def host_domains(spark, d):
    return table(spark, d, "pages").select("page_id", S.host_domain(F.col("url")).alias("domain"))


@query("SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END AS language, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def language_names(spark, d):
    return table(spark, d, "documents").groupBy(S.language_name(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT n_nationkey, lower(replace(n_name, ' ', '_')) AS key, n_regionkey::DOUBLE - 2 AS weight, n_name AS en, lower(n_name) AS xx, CASE WHEN n_nationkey % 2 = 0 THEN 'region ' || n_regionkey END AS yy FROM nation), l AS (SELECT n_nationkey, weight, unnest([{'at': 0, 'phrase': en}, {'at': 1, 'phrase': xx}, {'at': 2, 'phrase': yy}]) AS x FROM n) SELECT x.phrase AS phrase, max_by(weight, n_nationkey * 10 + x.at) AS weight FROM l WHERE x.phrase IS NOT NULL GROUP BY 1")
def flat_dictionary(spark, d):
    """Phrases in several languages as one weighted dictionary; of equal phrases the last has its weight."""
    n = table(spark, d, "nation")
    own = n.select(S.phrase_key(F.col("n_name")).alias("key"), "n_nationkey", (F.col("n_regionkey").cast("double") - 2).alias("weight"), F.col("n_name").alias("en"))
    xx = n.select(S.phrase_key(F.col("n_name")).alias("key"), F.lower("n_name").alias("xx"))
    yy = n.filter(F.pmod("n_nationkey", F.lit(2)) == 0).select(S.phrase_key(F.col("n_name")).alias("key"), F.concat(F.lit("region "), "n_regionkey").alias("yy"))
    return R.flatten_translations(R.with_translations(own, [xx, yy], "key"), "key", "weight", "n_nationkey")


ATTEMPT = "SELECT event_id, CASE WHEN value < 20 THEN 200 WHEN value < 40 THEN 404 WHEN value < 50 THEN 429 WHEN value < 60 THEN 503 WHEN value < 70 THEN 408 END AS code, CASE WHEN value >= 85 THEN 'overloaded' WHEN value >= 70 THEN 'connection refused' END AS message, user_id % 3 AS attempt, value FROM events"


def _attempts(spark, d: str) -> DataFrame:
    v = F.col("value")
    code = F.when(v < 20, 200).when(v < 40, 404).when(v < 50, 429).when(v < 60, 503).when(v < 70, 408)
    return table(spark, d, "events").select("event_id", code.alias("code"), F.when(v >= 85, "overloaded").when(v >= 70, "connection refused").alias("message"), F.pmod("user_id", F.lit(3)).alias("attempt"), "value")


@query(f"SELECT event_id, CASE WHEN attempt >= 2 THEN 'error' WHEN code = 429 OR message = 'overloaded' THEN 'wait' WHEN code IN (408, 503) THEN 'again' ELSE 'error' END AS verdict, pow(2.0, attempt)::DOUBLE AS wait_s FROM ({ATTEMPT})")
def retry_verdicts(spark, d):
    return _attempts(spark, d).select("event_id", S.retry_verdict(F.col("code"), F.col("message"), F.col("attempt"), 3).alias("verdict"), S.backoff(F.col("attempt")).alias("wait_s"))


@query(f"SELECT event_id, CASE WHEN message IS NOT NULL OR code IS NULL OR code <> 200 OR value * 2000000 > 20 * 1024 * 1024 THEN 'failed' WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 'not_image' ELSE 'success' END AS status, CASE WHEN event_id % 3 = 0 THEN '.jpg' ELSE '.png' END AS extension FROM ({ATTEMPT})")
def download_states(spark, d):
    """Status of recorded downloads: by code, size, whether they decode, and format."""
    odd, third = F.pmod("event_id", F.lit(2)) != 0, F.pmod("event_id", F.lit(3)) == 0
    image = F.when(third, "SVG").otherwise("PNG")
    answers = _attempts(spark, d)
    requests = table(spark, d, "events").select("event_id")
    seen = recorded(requests, answers, ["event_id"])
    return seen.select("event_id", S.download_status(F.col("code"), F.col("value") * 2000000, odd, image, F.col("message")).alias("status"), S.extension(image).alias("extension"))


@query("SELECT event_type, round(sum(CASE WHEN event_id % 2 = 0 THEN (k * 1.0 + (k % 7) * 5.0) / 1e6 ELSE (k * 3.0 + (k % 7) * 15.0) / 1e6 END), 9)::DOUBLE AS usd FROM (SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT::DOUBLE AS k FROM events) GROUP BY 1")
def tier_costs(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.pmod("event_id", F.lit(2)) == 0, "haiku").otherwise("sonnet").alias("model"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    usd = S.tier_cost(F.col("model"), F.col("k"), F.pmod("k", F.lit(7)), F.lit(0), F.lit(0))
    return e.groupBy("event_type").agg(F.round(F.sum(usd), 9).alias("usd"))


@query("SELECT event_id, json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS valid FROM events")
def valid_replies(spark, d):
    """Replies with real types of all fields; every third has a string for a boolean, every fifth no allowed choice."""
    flag = F.when(F.pmod("event_id", F.lit(3)) == 0, '"true"').otherwise("true")
    level = F.when(F.pmod("event_id", F.lit(5)) == 0, "sure").otherwise("high")
    body = F.concat(F.lit('{"is_map": '), flag, F.lit(', "note": "x", "legend": null, "confidence": "'), level, F.lit('"}'))
    return table(spark, d, "events").select("event_id", cascade.valid_reply(body, ("is_map",), ("note",), {"confidence": ("low", "medium", "high")}, ("legend",)).alias("valid"))


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM v GROUP BY 1) SELECT vec_id, round(sum((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END), 6) AS total FROM v JOIN s USING (i) GROUP BY 1")
def scaled_vectors(spark, d):
    """Vectors by mean and population deviation of each place, as the sum of their places."""
    rows, _ = M.population_scaled(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return rows.select("vec_id", F.round(F.aggregate("scaled_array", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT CASE WHEN source IS NULL THEN '(all)' ELSE source END AS input_file, count(*)::BIGINT AS n, count(*) FILTER (WHERE n_chars >= 2000)::BIGINT AS positives, round(count(*) FILTER (WHERE n_chars >= 2000) / count(*)::DOUBLE, 6) AS rate FROM documents GROUP BY ROLLUP (source)")
def job_stats(spark, d):
    """Rows and positives of each input, here a source, and of all."""
    docs = table(spark, d, "documents").select(F.col("source").alias("input_file"), F.when(F.col("n_chars") >= 2000, 1.0).otherwise(0.0).alias("pred_proba"))
    return M.job_stats(docs, {}).select("input_file", "n", "positives", "rate")


@query()
def model_grid(spark, d):
    """Test metrics of the linear models of the grid, plain and oversampled, ranked by F1."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("uid"), "embedding", (F.col("label") < 3).cast("int").alias("label"))
    split = R.stratified_split(rows, "uid", "label", 0.2, 42)
    _, results = M.train_grid(split.filter("not is_test"), split.filter("is_test"), "embedding", (("logistic", True), ("svm_rbf", False)))
    return M.ranked(results)
