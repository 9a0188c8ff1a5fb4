"""Queries on run logs, state, gates, replies and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import cascade
from corpusloom.operators import relational as R
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table
from corpusloom.streaming.events import windowed


@query("WITH runs AS (SELECT DISTINCT user_id // 10 AS run_id FROM events) SELECT run_id, count(event_id)::BIGINT AS n_items FROM runs LEFT JOIN (SELECT event_id, user_id // 10 AS run_id FROM events WHERE event_type = 'error') USING (run_id) GROUP BY run_id")
def run_log_batches(spark, d):
    e = table(spark, d, "events").withColumn("run_id", F.floor(F.col("user_id") / 10))
    return e.select("run_id").distinct().join(e.filter("event_type = 'error'").select("run_id", "event_id"), "run_id", "left").groupBy("run_id").agg(F.count("event_id").alias("n_items"))


STATE = "SELECT c_custkey AS uid FROM customer WHERE c_mktsegment = 'BUILDING'"


@query(f"SELECT uid, order_id, total FROM (SELECT o_custkey AS uid, o_orderkey AS order_id, o_totalprice AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1 AND uid NOT IN ({STATE})")
def insert_ignore(spark, d):
    """Orders, latest first, offered under their customer's id: one row of each customer that the state lacks."""
    state = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("uid"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), "o_orderdate")
    return R.insert_ignore(state, rows, "uid", [F.desc("o_orderdate"), F.asc("order_id")]).select("uid", "order_id", "total")


@query(f"SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN ({STATE}))::BIGINT AS inserted, (SELECT count(*) FROM orders)::BIGINT - (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN ({STATE}))::BIGINT AS skipped")
def insert_counts(spark, d):
    state = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("uid"))
    return R.insert_counts(state, table(spark, d, "orders").select(F.col("o_custkey").alias("uid")), "uid")


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def latest_revision(spark, d):
    return R.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, min_by(value, event_id) FILTER (WHERE value > 5) AS value FROM events WHERE value > 5 GROUP BY 1")
def first_writer(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 5, F.col("value")).alias("value"))
    return R.first_writer(e, ["user_id"], "value", "event_id")


@query("SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'pending') AS status, count(*)::BIGINT AS n FROM events GROUP BY 1")
def status_report(spark, d):
    status = F.when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, d, "events").groupBy(F.coalesce(status, F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, count(*) FILTER (WHERE l_quantity < 10)::BIGINT AS below_10, count(*) FILTER (WHERE l_quantity < 20)::BIGINT AS below_20, count(*) FILTER (WHERE l_quantity < 30)::BIGINT AS below_30 FROM lineitem")
def resolution_row(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.avg(q), 6).alias("mean"), *(F.count_if(q < n).alias(f"below_{n}") for n in (10, 20, 30)))


@query("SELECT count(*) FILTER (WHERE l_returnflag = 'A')::BIGINT AS a, count(*) FILTER (WHERE l_returnflag = 'N')::BIGINT AS n, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS r, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS o, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE l_tax = 0)::BIGINT AS untaxed, count(*) FILTER (WHERE l_discount > 0.05)::BIGINT AS discounted FROM lineitem")
def flag_sums(spark, d):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, d, "lineitem").agg(*(F.count_if(flag == x).alias(x.lower()) for x in "ANR"), *(F.count_if(status == x).alias(x.lower()) for x in "OF"), F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("SELECT p_size_bytes, n_parts FROM (SELECT l_partkey % 50 AS p_size_bytes, count(DISTINCT l_partkey)::BIGINT AS n_parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1)")
def size_buckets(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.pmod("l_partkey", F.lit(50)).alias("p_size_bytes")).agg(F.countDistinct("l_partkey").alias("n_parts"))
    return g.filter("n_parts > 1")


CHAIN = "SELECT doc_id, n_chars >= 400 AND length(text) >= 400 AS size_ok, n_chars % 3 <> 0 AS s1, lang = 'en' AS s2, n_chars % 2 = 0 AS s3 FROM documents"


@query(f"SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE size_ok)::BIGINT AS passed_size, count(*) FILTER (WHERE size_ok AND s1)::BIGINT AS passed_1, count(*) FILTER (WHERE size_ok AND s1 AND s2)::BIGINT AS passed_2, count(*) FILTER (WHERE size_ok AND s1 AND s2 AND s3)::BIGINT AS passed_3 FROM ({CHAIN})")
def gate_chain(spark, d):
    docs = table(spark, d, "documents")
    size = cascade.size_gate(F.col("n_chars"), F.length("text"))
    steps = [size, F.pmod("n_chars", F.lit(3)) != 0, F.col("lang") == "en", F.pmod("n_chars", F.lit(2)) == 0]
    passed, sums = F.lit(True), [F.count("*").alias("n")]
    for name, ok in zip(("passed_size", "passed_1", "passed_2", "passed_3"), steps):
        passed = passed & ok
        sums.append(F.count_if(passed).alias(name))
    return docs.agg(*sums)


@query("WITH f AS (SELECT event_id, event_id % 2 = 0 AS c, event_id % 3 = 0 AS g, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 = 0 END AS l FROM events) SELECT event_id, (c::INTEGER + g::INTEGER)::INTEGER AS methods, c OR g AS f2, coalesce(NOT c OR l, false) AS f3, (c OR g) AND coalesce(NOT c OR l, false) AS passed FROM f")
def step4_rule(spark, d):
    mod = lambda n: F.pmod("event_id", F.lit(n)) == 0
    flags = {"choropleth": mod(2), "diagrams": mod(3)}
    f2, f3, passed = cascade.type_rule(flags, F.when(mod(5), F.lit(None).cast("boolean")).otherwise(mod(7)))
    return table(spark, d, "events").select("event_id", cascade.methods_count(flags).alias("methods"), f2.alias("f2"), f3.alias("f3"), passed.alias("passed"))


@query("SELECT event_id, json_extract(props, '$.k')::INTEGER AS k, json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') AS k_is_number, json_type(props, '$.missing') = 'BOOLEAN' AS flag FROM events")
def json_validate(spark, d):
    v = F.try_parse_json("props")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), (kind == "BIGINT").alias("k_is_number"), S.strict_bool(F.col("props"), "missing").alias("flag"))


@query("SELECT reply, CASE WHEN reply LIKE '%{%}%' AND json_valid(regexp_extract(reply, '(?s)(\\{.*\\})', 1)) THEN regexp_extract(reply, '(?s)(\\{.*\\})', 1) END AS body FROM (SELECT CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'no object' ELSE props || ' done' END AS reply FROM events)")
def tolerant_json(spark, d):
    e = table(spark, d, "events")
    k = F.pmod("event_id", F.lit(3))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, "no object").otherwise(F.concat("props", F.lit(" done")))
    return e.select(reply.alias("reply")).select("reply", S.json_object(F.col("reply")).alias("body"))


TOKENS = "SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events"


@query(f"SELECT event_type, sum(k)::BIGINT AS tokens_in, sum(k % 7)::BIGINT AS tokens_out, round(sum(k * 1.0::DOUBLE + (k % 7) * 5.0::DOUBLE) / 1e6, 9)::DOUBLE AS usd FROM ({TOKENS}) GROUP BY 1")
def token_cost(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    g = e.groupBy("event_type").agg(F.sum("k").alias("tokens_in"), F.sum(F.pmod("k", F.lit(7))).alias("tokens_out"))
    usd = S.cost(F.col("tokens_in"), F.col("tokens_out"), F.lit(0), F.lit(0), (1.0, 5.0, 0.1, 1.25))
    return g.select("event_type", "tokens_in", "tokens_out", F.round(usd, 9).alias("usd"))


@query(f"SELECT event_id, spent FROM (SELECT event_id, (sum(k) OVER (ORDER BY event_id))::BIGINT AS spent FROM ({TOKENS})) WHERE spent <= 100000")
def budget_cutoff(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return R.running(e, "event_id", {"spent": "k"}).filter("spent <= 100000").select("event_id", "spent")


@query("SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(sum(value) FILTER (WHERE event_type = 'error'), 6) AS error, round(sum(value) FILTER (WHERE event_type = 'view'), 6) AS view FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY user_id")
def eav_pivot(spark, d):
    kinds = ["click", "error", "view"]
    return table(spark, d, "events").filter(F.col("event_type").isin(*kinds)).groupBy("user_id").pivot("event_type", kinds).agg(F.round(F.sum("value"), 6))


@query("SELECT doc_id, field, value FROM (SELECT doc_id, 'quality' AS field, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)")
def json_unpivot(spark, d):
    return table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "field", "value")


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'failed' WHEN vec_id % 5 = 1 THEN 'ok' WHEN vec_id % 5 IN (2, 3) THEN 'recoded' ELSE 'changed' END AS verdict FROM embeddings")
def verify_download(spark, d):
    k = F.pmod("vec_id", F.lit(5))
    got = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "a").otherwise("b")
    seen = F.when(k == 2, "ffff00000000000f").when(k == 3, "ffff00000000000c").otherwise("0000ffffffff0000")
    return table(spark, d, "embeddings").select("vec_id", S.download_verdict(got, F.lit("a"), seen, F.lit("ffff00000000000f")).alias("verdict"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'alive' WHEN event_id % 4 IN (1, 2) THEN 'dead' ELSE 'error' END AS status FROM events")
def http_states(spark, d):
    k = F.pmod("event_id", F.lit(4))
    code, error = F.when(k == 0, 200).when(k == 1, 404), F.when(k == 2, "timeout").when(k == 3, "tls")
    return table(spark, d, "events").select("event_id", S.http_status(code, error).alias("status"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windowed(table(spark, d, "events"), "ts", "event_type", "value")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def price_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
