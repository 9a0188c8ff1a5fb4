"""Queries on pages and documents: pools, phrase scores, categories, samples, duplicates, release."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import relational as R
from corpusloom.operators import release
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

EXCLUDED = ("spam-farm.example.com", "free-bets.example.com")
# A small weighted dictionary; a phrase in both parts has its negative weight.
POSITIVE = {"the": 1.5, "of the": 3.0, "und": 2.0, "de la": 2.5, "token": 1.0, "les": 0.5, "and": 1.0}
NEGATIVE = {"with": -1.0, "mit": -2.0, "por": -1.5, "and": -0.5}
WEIGHTS = {**POSITIVE, **NEGATIVE}


def pool(spark, d: str) -> DataFrame:
    """Pages with a probability, and a variant of each under another scheme with a lower one."""
    p = table(spark, d, "pages").select("page_id", "url", (F.pmod(F.col("page_id") * 7919, F.lit(1000)) / 1000.0).alias("pred_proba"))
    a = p.select(F.concat(F.lit("p"), "page_id").alias("uid"), "url", "pred_proba")
    b = p.select(F.concat(F.lit("v"), "page_id").alias("uid"), F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("/")).alias("url"), F.greatest(F.round(F.col("pred_proba") - 0.1, 3), F.lit(0.0)).alias("pred_proba"))
    return a.unionByName(b).withColumn("url_norm", S.url_norm(F.col("url"))).withColumn("domain", S.domain_of(F.col("url_norm")))


POOL = """WITH p AS (SELECT page_id, url, ((page_id * 7919) % 1000) / 1000.0::DOUBLE AS pred_proba FROM pages),
u AS (SELECT 'p' || page_id AS uid, url, pred_proba FROM p UNION ALL SELECT 'v' || page_id, regexp_replace(url, '^http:', 'https:') || '/', greatest(round(pred_proba - 0.1, 3), 0.0) FROM p),
n AS (SELECT *, trim(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/') AS url_norm FROM u),
pool AS (SELECT *, nullif(regexp_extract(url_norm, '^([^/]+)', 1), '') AS domain FROM n)""".replace("\\\\", "\\")
CLEAN = POOL + """, clean AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_norm ORDER BY pred_proba DESC, uid) AS k FROM pool
  WHERE domain IS NOT NULL AND domain NOT IN ('spam-farm.example.com', 'free-bets.example.com')) WHERE k = 1)"""


def clean_pool(spark, d: str) -> DataFrame:
    kept = pool(spark, d).filter(~F.col("domain").isin(*EXCLUDED))
    return R.keep_first(kept, ["url_norm"], [F.desc("pred_proba"), F.asc("uid")])


@query(CLEAN + " SELECT uid, url_norm, domain, pred_proba FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42|' || uid), uid) AS r FROM clean WHERE pred_proba >= 0.3) WHERE r <= 5")
def flagship_domain_capped_pool(spark, d):
    rows = clean_pool(spark, d).filter("pred_proba >= 0.3")
    return R.cap_per_key(rows, ["domain"], [S.seeded(42, F.col("uid")), F.asc("uid")], 5).select("uid", "url_norm", "domain", "pred_proba")


@query(CLEAN + " SELECT uid, url_norm, domain, pred_proba FROM clean")
def url_clean_pool(spark, d):
    return clean_pool(spark, d).select("uid", "url_norm", "domain", "pred_proba")


@query(POOL + " SELECT count(*)::BIGINT AS n, count(DISTINCT url_norm)::BIGINT AS n_urls, count(DISTINCT domain)::BIGINT AS n_domains FROM pool")
def pool_counts(spark, d):
    return pool(spark, d).agg(F.count("*").alias("n"), F.countDistinct("url_norm").alias("n_urls"), F.countDistinct("domain").alias("n_domains"))


@query(CLEAN + """ SELECT uid, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || uid), uid) AS r FROM (
  SELECT *, CASE WHEN pred_proba >= 0.7 AND pred_proba < 0.8 THEN '0.70-0.80' WHEN pred_proba >= 0.8 AND pred_proba < 0.9 THEN '0.80-0.90' WHEN pred_proba >= 0.9 AND pred_proba < 1.01 THEN '0.90-1.01' END AS stratum FROM clean) WHERE stratum IS NOT NULL)
  WHERE r <= CASE stratum WHEN '0.70-0.80' THEN 20 WHEN '0.80-0.90' THEN 40 ELSE 40 END""")
def strata_allocation(spark, d):
    return R.allocate(clean_pool(spark, d), "uid", "pred_proba", 100, [(0.7, 0.8, 0.2), (0.8, 0.9, 0.4), (0.9, 1.01, 0.4)], 7).select("uid", "stratum")


def dictionary(spark) -> DataFrame:
    make = lambda x: spark.createDataFrame(sorted(x.items()), "phrase string, weight double")
    return R.merge_dictionaries(make(POSITIVE), make(NEGATIVE))


def scored(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = R.match_phrases(docs, "doc_id", "text", dictionary(spark))
    # In the order of matches: by their end, at the same end the longer phrase first.
    keyed = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("end", (-F.length("phrase")).alias("longer"), "phrase"))))
    keys = lambda c: F.array_join(F.transform(keyed(c), lambda x: x["phrase"]), "|")
    sums = hits.groupBy("doc_id").agg(F.sum("weight").alias("score"), keys(F.col("weight") >= 0).alias("pos_keys"), keys(F.col("weight") < 0).alias("neg_keys"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("pos_keys", F.lit("")).alias("pos_keys"), F.coalesce("neg_keys", F.lit("")).alias("neg_keys"))


_DICT = ", ".join(f"('{p}', {w}::DOUBLE)" for p, w in WEIGHTS.items())
SCORED = f"""WITH dict(phrase, weight) AS (VALUES {_DICT}),
hits AS (SELECT doc_id, phrase, weight, length(regexp_extract(lower(coalesce(text, 'None')), '(?s)^(|.*?[^\\p{{L}}\\p{{N}}])' || phrase || '(?:$|[^\\p{{L}}\\p{{N}}])', 1)) + length(phrase) AS e FROM documents, dict WHERE regexp_matches(lower(coalesce(text, 'None')), '(^|[^\\p{{L}}\\p{{N}}])' || phrase || '($|[^\\p{{L}}\\p{{N}}])')),
s AS (SELECT d.doc_id, coalesce(sum(weight), 0)::DOUBLE AS score, coalesce(string_agg(phrase, '|' ORDER BY e, length(phrase) DESC) FILTER (WHERE weight >= 0), '') AS pos_keys, coalesce(string_agg(phrase, '|' ORDER BY e, length(phrase) DESC) FILTER (WHERE weight < 0), '') AS neg_keys
  FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id)"""


@query(SCORED + " SELECT doc_id, score FROM s")
def kw_score(spark, d):
    return scored(spark, d).select("doc_id", "score")


@query(SCORED + " SELECT doc_id, pos_keys, neg_keys FROM s")
def kw_keys(spark, d):
    return scored(spark, d).select("doc_id", "pos_keys", "neg_keys")


@query(SCORED + " SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE score >= -1)::BIGINT AS kept FROM s")
def kw_keep_counts(spark, d):
    return scored(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= -1).alias("kept"))


@query(SCORED + """ SELECT category, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM (SELECT CASE WHEN score = -1 THEN '-1' WHEN score = -0.5 THEN '-0.5' WHEN score = 0 THEN '0' WHEN score = 0.5 THEN '0.5' WHEN score = 1 THEN '1'
  WHEN score > 1 AND score <= 2 THEN '1 to 2' WHEN score > 2 AND score <= 5 THEN '2 to 5' WHEN score > 5 AND score <= 10 THEN '5 to 10' ELSE '10+' END AS category FROM s WHERE score >= -1) GROUP BY 1""")
def score_category(spark, d):
    """Nine classes of the scores that pass the filter; scores are multiples of a half."""
    g = scored(spark, d).filter("score >= -1").groupBy(S.score_class(F.col("score")).alias("category")).agg(F.count("*").alias("n"))
    return g.crossJoin(g.agg(F.sum("n").alias("all"))).select("category", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("pct"))  # one row


# Upper ends of the bins; the last one is open.
EDGES = (-1, -0.5, 0, 0.5, 1, 2, 5, 10)


@query(SCORED + " SELECT bin, count(*)::BIGINT AS n FROM (SELECT CASE " + " ".join(f"WHEN score > {a} AND score <= {b} THEN 'bin_{i}'" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]), 1)) + " WHEN score > 10 THEN 'bin_8' ELSE 'bin_9' END AS bin FROM s WHERE score >= -1) GROUP BY 1")
def score_bin_quirk(spark, d):
    """Half-open bins; the lowest score falls through to the last label and scores over 10 join bin_8."""
    s, out = F.col("score"), None
    for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]), 1):
        out = F.when((s > a) & (s <= b), f"bin_{i}") if out is None else out.when((s > a) & (s <= b), f"bin_{i}")
    return scored(spark, d).filter(s >= -1).groupBy(out.when(s > 10, "bin_8").otherwise("bin_9").alias("bin")).agg(F.count("*").alias("n"))


@query(SCORED + """, b AS (SELECT doc_id, floor(score)::BIGINT AS bin, md5('42|' || doc_id) AS h FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, doc_id) AS k FROM b),
rest AS (SELECT * FROM r WHERE k > 20 ORDER BY h, doc_id LIMIT 60) SELECT doc_id, bin, true AS guaranteed FROM r WHERE k <= 20 UNION ALL SELECT doc_id, bin, false FROM rest""")
def min_then_fill_sample(spark, d):
    """Twenty of each bin, then 60 of the rest at random."""
    rows = scored(spark, d).select("doc_id", F.floor("score").cast("long").alias("bin"), S.seeded(42, F.col("doc_id")).alias("h"))
    first = R.cap_per_key(rows, ["bin"], [F.asc("h"), F.asc("doc_id")], 20)
    rest = rows.join(first.select("doc_id"), "doc_id", "left_anti").orderBy("h", "doc_id").limit(60)
    return first.select("doc_id", "bin", F.lit(True).alias("guaranteed")).unionByName(rest.select("doc_id", "bin", F.lit(False).alias("guaranteed")))


@query("SELECT lang, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS pct FROM (SELECT CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'unknown' WHEN lower(trim(lang)) IN ('zh-tw', 'zh-hk') THEN 'zh-cn' ELSE lower(trim(lang)) END AS lang, count(*)::BIGINT AS n FROM documents GROUP BY 1)")
def lang_share(spark, d):
    g = table(spark, d, "documents").groupBy(S.language(F.col("lang")).alias("lang")).agg(F.count("*").alias("n"))
    return g.crossJoin(g.agg(F.sum("n").alias("all"))).select("lang", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("pct"))  # one row


@query("WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT count(*) FILTER (WHERE n >= 0.12 * t)::BIGINT AS langs_above, coalesce(sum(n) FILTER (WHERE n >= 0.12 * t), 0)::BIGINT AS docs_above, coalesce(sum(n) FILTER (WHERE n < 0.12 * t), 0)::BIGINT AS docs_below FROM g, (SELECT sum(n) AS t FROM g)")
def lang_coverage(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    above = F.col("n") >= 0.12 * F.col("t")
    return g.crossJoin(g.agg(F.sum("n").alias("t"))).agg(F.count_if(above).alias("langs_above"), F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("docs_above"), F.coalesce(F.sum(F.when(~above, F.col("n"))), F.lit(0)).alias("docs_below"))  # one row


@query("SELECT d.doc_id, 'G' || substr(h, 1, 16) AS group_id, n_copies FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) d JOIN (SELECT sha256(coalesce(text, '')) AS h, count(*)::BIGINT AS n_copies FROM documents GROUP BY 1 HAVING count(*) > 1) USING (h)")
def dup_groups(spark, d):
    g = R.duplicate_groups(table(spark, d, "documents"), F.coalesce("text", F.lit("")), "doc_id")
    return g.filter("n_copies > 1").select("doc_id", F.concat(F.lit("G"), "group_id").alias("group_id"), "n_copies")


@query("""WITH h AS (SELECT doc_id, source, n_chars, sha256(coalesce(text, '')) AS h FROM documents), v AS (SELECT h, source, count(*) AS votes FROM h GROUP BY 1, 2), g AS (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, row_number() OVER (PARTITION BY h ORDER BY votes DESC, n_chars DESC, doc_id) > 1 AS is_duplicate FROM h JOIN g USING (h) JOIN v USING (h, source)""")
def dup_keeper(spark, d):
    """In each group the row of the most voted source, then the longest, then the least id stays."""
    docs = table(spark, d, "documents")
    g = R.duplicate_groups(docs, F.coalesce("text", F.lit("")), "doc_id").filter("group_id is not null").join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    votes = g.groupBy("sha256", "source").agg(F.count("*").alias("votes"))
    return R.keepers(g.join(votes, ["sha256", "source"]), "sha256", [F.desc("votes"), F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "is_duplicate")


@query("SELECT doc_id, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) > 1 AS shares_hash FROM documents")
def shared_hash_flag(spark, d):
    """Rows whose text's whole hash occurs more than once; counts are aggregated first and only shared hashes joined."""
    h = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    shared = h.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    return h.join(shared, "h", "left").select("doc_id", F.col("n").isNotNull().alias("shares_hash"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \n\t\r]+')) AS w FROM documents), m AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS m FROM w),
v AS (SELECT doc_id, i, 2 * count(*) FILTER (WHERE ((m >> (63 - i)::UBIGINT) & 1::UBIGINT) = 1) > count(*) AS one FROM m, range(64) r(i) GROUP BY 1, 2),
h AS (SELECT doc_id, string_agg(one::INTEGER::VARCHAR, '' ORDER BY i) AS h FROM v GROUP BY 1), g AS (SELECT h, min(doc_id) AS a FROM h GROUP BY 1)
SELECT a, doc_id AS b, 0 AS bits FROM h JOIN g USING (h) WHERE doc_id <> a UNION ALL SELECT least(x.a, y.a), greatest(x.a, y.a), bit_count(xor(x.h::BIT, y.h::BIT))::INTEGER FROM g x JOIN g y ON x.h < y.h WHERE bit_count(xor(x.h::BIT, y.h::BIT)) <= 2""")
def near_dup_hamming(spark, d):
    """Documents whose SimHashes are within 2 bits; copies are linked to the least id of their hash only."""
    return R.near_hash_links(R.simhash(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "hash", 2)


GATES = "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars >= 500 END AS g1, CASE WHEN doc_id % 5 <> 0 THEN lang = 'en' END AS g2, CASE WHEN doc_id % 11 <> 0 THEN n_chars % 2 = 0 END AS g3 FROM documents"


def gates(spark, d: str) -> DataFrame:
    g = lambda n, c: F.when(F.pmod("doc_id", F.lit(n)) != 0, c)
    return table(spark, d, "documents").select("doc_id", g(7, F.col("n_chars") >= 500).alias("g1"), g(5, F.col("lang") == "en").alias("g2"), g(11, F.pmod("n_chars", F.lit(2)) == 0).alias("g3"))


@query(f"SELECT doc_id, g1, CASE WHEN g1 THEN g2 END AS g2, CASE WHEN g1 AND g2 THEN g3 END AS g3, g1 AND g2 AND g3 AS in_corpus FROM ({GATES})")
def kleene_funnel(spark, d):
    g1, g2, g3 = F.col("g1"), F.col("g2"), F.col("g3")
    return gates(spark, d).select("doc_id", "g1", release.reached(g2, g1).alias("g2"), release.reached(g3, g1 & g2).alias("g3"), release.all_of(g1, g2, g3).alias("in_corpus"))


@query(f"WITH f AS ({GATES}), c AS (SELECT count(*) AS s0, count(*) FILTER (WHERE g1) AS s1, count(*) FILTER (WHERE g1 AND g2) AS s2, count(*) FILTER (WHERE g1 AND g2 AND g3) AS s3 FROM f) SELECT 0 AS step, 'all' AS name, s0::BIGINT AS remaining, 0::BIGINT AS rejected FROM c UNION ALL SELECT 1, 'length', s1, s0 - s1 FROM c UNION ALL SELECT 2, 'language', s2, s1 - s2 FROM c UNION ALL SELECT 3, 'parity', s3, s2 - s3 FROM c")
def funnel_steps(spark, d):
    return release.funnel(gates(spark, d), [("length", F.col("g1")), ("language", F.col("g2")), ("parity", F.col("g3"))])


@query("SELECT count(*)::BIGINT AS n_rows, count(DISTINCT source)::BIGINT AS n_sources, count(DISTINCT lang)::BIGINT AS n_langs, min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(avg(n_chars), 6) AS mean_chars, count(*) FILTER (WHERE lang = 'en')::BIGINT AS n_en, count(DISTINCT md5(text))::BIGINT AS n_texts FROM documents")
def corpus_facts(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("lang") == "en").alias("n_en"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("n_texts"))


_PROFILED = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_null, count(DISTINCT {c})::BIGINT AS n_distinct, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, round(median({c}), 6)::DOUBLE AS median FROM labels" for c, t in (("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")))


@query(_PROFILED)
def column_profile(spark, d):
    return release.profile(table(spark, d, "labels")).drop("listing")


@query("SELECT 'unique key' AS check_name, (count(*) - count(DISTINCT doc_id))::BIGINT AS n_failed FROM documents UNION ALL SELECT 'length', count(*) FILTER (WHERE n_chars <> length(text))::BIGINT FROM documents UNION ALL SELECT 'hash length', count(*) FILTER (WHERE length(sha256(text)) <> 64)::BIGINT FROM documents")
def package_checks(spark, d):
    docs = table(spark, d, "documents")
    keys = docs.groupBy("doc_id").count().agg(F.lit("unique key").alias("check_name"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_failed"))
    rows = release.failed_checks(docs, {"length": F.col("n_chars") == F.length("text"), "hash length": F.length(F.sha2(F.col("text").cast("binary"), 256)) == 64})
    return keys.unionByName(rows)


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))::BIGINT AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))::BIGINT AS only_right")
def set_equality(spark, d):
    return release.differences(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def uid_intersection(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").filter("quality = 1").select("doc_id"))


@query("SELECT CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE coalesce(lang, '(null)') END AS lang, CASE WHEN grouping(source) = 1 THEN '(all)' ELSE coalesce(source, '(null)') END AS source, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 17 <> 0 THEN lang END AS lang, source FROM documents) GROUP BY ROLLUP (lang, source)")
def funnel_rollup(spark, d):
    """Totals are told from null keys, of which every seventeenth document has one."""
    docs = table(spark, d, "documents").select(F.when(F.pmod("doc_id", F.lit(17)) != 0, F.col("lang")).alias("lang"), "source")
    name = lambda c: F.when(F.grouping(c) == 1, "(all)").otherwise(F.coalesce(c, F.lit("(null)"))).alias(c)
    return docs.rollup("lang", "source").agg(F.count("*").alias("n"), name("lang").alias("_lang"), name("source").alias("_source")).select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), "n")


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS context, count(*)::BIGINT AS n_turns FROM conversations GROUP BY conv_id")
def transcript_context(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text")).alias("x"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda s: s["x"]), "|").alias("context"), F.count("*").alias("n_turns"))


@query("SELECT n_nationkey, r_name, row_number() OVER (PARTITION BY r_name ORDER BY md5('43|' || n_nationkey), n_nationkey)::INTEGER AS position FROM nation JOIN region ON n_regionkey = r_regionkey")
def presentation_order(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w = Window.partitionBy("r_name").orderBy(S.seeded(43, F.col("n_nationkey")), "n_nationkey")
    return rows.select("n_nationkey", "r_name", F.row_number().over(w).alias("position"))
