"""State, gates, connectors, codings and models on hand-written cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import cascade, coding, learning, modelling, relational, release, state, statistics


def test_updates_leave_what_a_change_does_not_give(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "uid string, n int, s string")
    changes = spark.createDataFrame([("a", None, "y", 1), ("a", 5, None, 2), ("c", 9, "z", 3)], "uid string, n int, s string, version int")
    got = state.update_by_key(base, changes.withColumn("extra", F.col("s")), "uid", "version")
    assert sorted(map(tuple, got.select("uid", "n", "s", "extra").collect())) == [("a", 5, "y", "y"), ("b", 2, None, None)]
    assert state.with_columns(base, {"S": "int", "w": "double"}).columns == ["uid", "n", "s", "w"]
    assert state.if_present(base, ["s", "missing", "UID"]).columns == ["s", "uid"]
    got = state.renamed(base.withColumn("name_de", F.lit("d")), {"name": ("name_en", "name_de"), "n": ("n",), "no": ("never",)})
    assert got.columns == ["name", "n"] and got.first()["name"] == "d"
    assert sorted(map(tuple, state.replace_rows(base, base.filter("uid = 'a'").withColumn("n", F.lit(7)), ["uid"]).collect())) == [("a", 7, "x"), ("b", 2, None)]


def test_insert_ignore_keeps_the_first_row(spark):
    rows = spark.createDataFrame([("k", 9, 1), ("k", 1, 2), ("k", 5, 3), ("s", 2, 4), (None, 3, 5)], "uid string, v int, at int")
    known = spark.createDataFrame([("s",)], "uid string")
    assert [tuple(r) for r in relational.insert_ignore(known, rows, "uid", [F.asc("at")]).collect()] == [("k", 9, 1)]
    assert tuple(relational.insert_counts(known, rows, "uid").first()) == (1, 4)


def test_run_log_and_look_ups(spark):
    log = state.started(spark, 1, "check", "{}").unionByName(state.finished(spark, 1, 5, 4, 1, "ok"), True).unionByName(state.started(spark, 2, "load"), True)
    got = {r["run_id"]: r for r in state.run_log(log).collect()}
    assert (got[1]["step"], got[1]["processed"], got[1]["notes"]) == ("check", 5, "ok") and got[2]["finished_at"] is None and got[2]["success"] is None
    wanted, source = spark.createDataFrame([("a",), ("b",), ("b",)], "uid string"), spark.createDataFrame([("a", 1), ("c", 2)], "uid string, n int")
    found, missing = state.look_up(wanted, source, "uid", ["n"])
    assert [tuple(r) for r in found.collect()] == [("a", 1)] and [r["uid"] for r in missing.collect()] == ["b"]


def test_budget_stops_and_goes_on(spark, tmp_path):
    queue, saved = spark.range(10).select(F.col("id").cast("string").alias("uid")), []

    def save(df):
        saved.append(str(tmp_path / f"b{len(saved)}"))
        df.write.parquet(saved[-1])
        return spark.read.parquet(*saved)

    step = lambda df: df.withColumn("usd", F.lit(1.0))
    first = state.with_budget(queue, ["uid"], "usd", 4.0, step, save, batch=3)
    assert first.count() == 6 and len(saved) == 2
    assert state.with_budget(queue, ["uid"], "usd", 100.0, step, save, done=first, batch=3).select("uid").distinct().count() == 10


def test_gates_stop_force_and_count(spark, tmp_path):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "uid string, x int")
    calls, log = [], spark.createDataFrame([], cascade.ATTEMPT + ", tokens long")

    def gate(least):
        return lambda df: calls.append(df.count()) or df.select("uid", F.when(F.col("x") == 1, "error").otherwise("done").alias("status"), (F.col("x") >= least).alias("passed"), F.lit(10).cast("long").alias("tokens"))

    def save(df):
        path = str(tmp_path / f"l{len(calls)}-{id(df)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    gates = [("g1", gate(2)), ("g2", gate(3))]
    log = cascade.run_gates(items, log, gates, save, stop_after="g1")
    assert calls == [3]
    log = cascade.run_gates(items, log, gates, save)
    assert calls == [3, 1, 2]  # what failed with an error is tried again
    log = cascade.run_gates(items, log, gates, save, force=True)
    assert calls[3:] == [3, 2]
    got = {r["gate"]: r.asDict() for r in cascade.gate_counters(log, ("tokens",)).collect()}
    assert got["g1"] == {"gate": "g1", "n": 3, "done": 2, "passed": 2, "failed": 0, "errors": 1, "tokens": 70} and got["g2"]["passed"] == 1 == got["g2"]["failed"]
    with pytest.raises(ValueError):
        cascade.in_scope(items, True, pilot=1)
    assert [r["uid"] for r in cascade.in_scope(items, pilot=2).collect()] == ["a", "b"] and cascade.in_scope(items, uids=["c"]).count() == 1 and cascade.in_scope(items, True).count() == 3


def test_connector_retries_and_reports(spark):
    requests = spark.createDataFrame([("ok",), ("garbled",), ("limit",), ("down",)], "uid string").coalesce(1)

    def call(request):
        call.seen = {**getattr(call, "seen", {})}
        n = call.seen[request["uid"]] = call.seen.get(request["uid"], 0) + 1
        if request["uid"] == "garbled":
            raise ValueError("no JSON")
        if request["uid"] == "limit" and n < 3:
            raise RuntimeError("429 rate_limit")
        if request["uid"] == "down":
            raise RuntimeError("refused")
        return {"answer": request["uid"].upper()}

    got = {r["uid"]: tuple(r)[1:] for r in cascade.connect(requests, call, "answer string", 3).collect()}
    assert got == {"ok": ("OK", "done", 1, None), "garbled": (None, "parse_error", 3, "parse: no JSON"), "limit": ("LIMIT", "done", 3, None), "down": (None, "error", 3, "refused")}


def test_rules_of_corpus_and_subset(spark):
    good = {"size_status": "pass", "step3_status": "done", "methods_count": 1, "map_language": "en", "is_map": True, "is_map_dominant": True, "is_statistical_map": True, "has_admin_units": True, "has_quantitative_data": True, "step4_passed": True}
    rows = [good, {**good, "map_language": "EN"}, {**good, "methods_count": 0}, {**good, "is_map": None}, {**good, "size_status": None}, {**good, "step4_passed": None}]
    schema = "size_status string, step3_status string, methods_count int, map_language string, is_map boolean, is_map_dominant boolean, is_statistical_map boolean, has_admin_units boolean, has_quantitative_data boolean, step4_passed boolean"
    got = spark.createDataFrame([tuple(r.values()) for r in rows], schema).select(cascade.corpus_rule().alias("c"), cascade.subset_rule().alias("s")).collect()
    assert [r["c"] for r in got] == [True, False, False, False, False, True] and [r["s"] for r in got] == [True, False, True, False, False, False]


def test_scalar_rules(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {t}" for k, t in zip(v, ["string", "int"] if len(v) > 1 else ["string"]))).select(c).first()[0]
    assert one(S.host_domain(F.col("u")), u="http://www.a.www.b.com:80/x") == "a.b.com:80"
    assert [one(S.verdict_flag(F.col("u")), u=x) for x in ("YES", "NO", "INVALID")] == [1, 0, None]
    assert one(S.phrase_key(F.col("u")), u="GDP per Capita") == "gdp_per_capita" and one(S.language_name(F.col("u")), u="tlh") == "tlh"
    assert [one(coding.read_bool(F.col("u")), u=x) for x in ("True", "false", "", "x")] == [True, False, None, None]
    assert [one(coding.read_legend(F.col("u")), u=x) for x in ("classed", "true", "false", "", "zz")] == ["classed", "classed", "continuous", "other", "other"]
    assert one(S.extension(F.col("u"), S.FETCHED), u="GIF") == ".img" and one(S.extension(F.col("u")), u="XYZ") == ".jpg"
    assert release.rendered(1234567) == "1,234,567" and release.rendered(1, 8) == "12.5%" and release.rendered(True) == "true" and release.rendered(None) == "-"
    assert spark.range(1).select(S.utc_stamp(F.lit("2024-05-01 10:20:30").cast("timestamp"))).first()[0] == "2024-05-01T10:20:30+00:00"


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=501)] + [("b", float(v)) for v in rng.integers(0, 3, 40)] + [(None, 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in relational.exact_quantiles(df, "v", [0.0, 0.3, 0.5, 1.0], "g").collect()}
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g]
        assert [got[g][f"q{i}"] for i in range(4)] == pytest.approx(list(np.quantile(values, [0.0, 0.3, 0.5, 1.0]))) and got[g]["n"] == len(values)
    assert "c" not in got and relational.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_no_text_is_shuffled_and_strata_are_top_k(spark):
    docs = spark.createDataFrame([(1, "GDP per capita")], "id long, text string")
    words = spark.createDataFrame([("gdp", 3.0), ("per capita", 4.0)], "phrase string, weight double")
    for most in ((64, 200_000), (0, 200_000)):
        assert "Exchange hashpartitioning" not in relational.match_phrases(docs, "id", "text", words, *most)._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(1000).select("id", (F.col("id") / 1000).alias("p"))
    taken = relational.allocate(rows, "id", "p", 100, [(0.0, 0.5, 0.2), (0.5, 1.0, 0.4)], 7)
    assert taken._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") == 2 and taken.count() == 60


def test_gold_and_independence_on_small_codings(spark):
    rows = []
    for uid, left, right, model in (("a", "yes", "yes", "yes"), ("b", "no", "no", "yes"), ("c", "yes", "no", "yes"), ("d", "cannot_assess", "no", "no"), ("e", "no", "no", "no")):
        rows += [(uid, "m1", s, v) for s, v in (("l", left), ("r", right), ("m", model))]
    rows += [("b", "m2", "l", "yes"), ("b", "m2", "r", "yes")]
    df = spark.createDataFrame(rows, "uid string, field string, source string, value string")
    got = {r["field"]: r for r in coding.field_analysis(df, "l", "r").collect()}
    assert (got["m1"]["n"], got["m1"]["dropped"], got["m1"]["agreement"], got["m1"]["confusion"]) == (4, 1, 0.75, "no->no:2,yes->no:1,yes->yes:1")
    assert got["m1"]["kappa"] == pytest.approx(0.5) and got["m2"]["prevalence_index"] is None and got["m2"]["kappa"] is None
    r = coding.coder_independence(df, "l", "r", "m").first()
    assert (r["n_cells"], r["n_agree_first"], r["n_agree_second"], r["only_first"], r["only_second"], r["mcnemar_p"]) == (4, 3, 2, 1, 0, 1.0)
    patterns = {(r["field"], r["pattern"]): r["n"] for r in coding.error_patterns(df, "l", "r", "m", ["m1", "m2"], ["m1"]).collect()}
    assert patterns == {("m1", "false positives"): 1, ("m1", "any:m2"): 1, ("m1", "sole:m2"): 1}


def test_instability_and_error_on_small_codings(spark, tmp_path):
    kinds = [("yes", "yes", "yes", "yes", 9), ("yes", "yes", "yes", "no", 2), ("yes", "no", "yes", "yes", 3), ("no", "yes", "no", "yes", 8), ("yes", "no", "no", "cannot_assess", 4)]
    rows = [(f"{k}-{i}", "f", *v) for k, (*v, n) in enumerate(kinds) for i in range(n)]
    wide = spark.createDataFrame([r[:5] for r in rows], "uid string, field string, prod string, run1 string, run2 string")
    spark.createDataFrame([(r[0], "f", s, r[5]) for r in rows for s in ("l", "r")], "uid string, field string, source string, value string").write.parquet(str(tmp_path / "codings"))
    got = coding.instability_and_error(wide, spark.read.parquet(str(tmp_path / "codings")), "l", "r")
    assert tuple(got.first()) == (9, 2, 3, 8, 0.181818, 0.727273, 12.0, round(statistics.fisher_p(9, 2, 3, 8), 9))
    assert got.inputFiles() == []  # counted before, not again


def test_smote_lies_between_neighbours(spark):
    rng = np.random.default_rng(3)
    minority = rng.normal(size=(30, 2))
    rows = [(f"m{i}", [float(x) for x in v], 1) for i, v in enumerate(minority)] + [(f"n{i}", [float(i), 0.0], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "uid string, v array<double>, label int")
    near = {i: np.argsort(((minority - v) ** 2).sum(1))[1:4] for i, v in enumerate(minority)}
    for block in (7, 4096):
        new = learning.smote(df, "uid", "v", "label", block=block).collect()
        assert len(new) == 60
        for r in new:
            a, x = int(r["base"][1:]), np.array(r["v"])
            assert any(np.isclose(np.linalg.norm(x - minority[a]) + np.linalg.norm(x - minority[b]), np.linalg.norm(minority[a] - minority[b])) for b in near[a])
    assert learning.smote(df.limit(0), "uid", "v", "label").count() == 0


@pytest.fixture(scope="module")
def rings(spark):
    """A disc in a ring: an RBF machine can tell them, a linear one can't."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        label = int(i % 4 == 0)
        radius, angle = (rng.uniform(0, 1) if label else rng.uniform(1.6, 2.6)), rng.uniform(0, 2 * math.pi)
        rows.append((f"u{i}", [radius * math.cos(angle), radius * math.sin(angle)], label))
    return spark.createDataFrame(rows, "uid string, v array<double>, label int").withColumn("is_test", F.pmod(F.xxhash64("uid"), F.lit(3)) == 0).cache()


def test_grid_selection_storage_and_retraining(spark, rings, tmp_path):
    train, test = rings.filter("not is_test"), rings.filter("is_test")
    models, results = modelling.train_grid(train, test, "v", (("logistic", True), ("logistic_l1", False), ("svm_rbf", False)))
    rows = {r["model"]: r for r in results.collect()}
    assert set(rows) == {"logistic", "logistic + smote", "logistic_l1", "svm_rbf"} and rows["svm_rbf"]["f1"] > 0.9 > rows["logistic"]["f1"]
    best = modelling.select_best(models, results)
    assert best.name == "svm_rbf"
    scored = best.score(test.select("uid", "v", "label"), "v")
    assert all(0 <= r["pred_proba"] <= 1 for r in scored.collect())
    found = modelling.metrics(scored)
    assert found["f1"] == rows["svm_rbf"]["f1"] and found["best_f1"] >= found["f1"]
    root = str(tmp_path / "models")
    modelling.save_model(spark, root, models["logistic"], {}, "1")
    path = modelling.save_model(spark, root, best, found, "2")
    again, about = modelling.load_model(spark, root)
    assert about["metrics"] == found and path.endswith("svm_rbf-2")
    assert {r["uid"]: round(r["pred_proba"], 9) for r in again.score(test.select("uid", "v"), "v").collect()} == {r["uid"]: round(r["pred_proba"], 9) for r in scored.collect()}
    assert modelling.load_model(spark, root, f"{root}/logistic-1")[0].name == "logistic"
    notes = test.limit(5).unionByName(train.limit(5)).select("uid", "v", F.lit("YES").alias("answer")).unionByName(spark.createDataFrame([("n1", [0.1, 0.1], "YES"), ("n2", [2.0, 0.0], "NO"), ("n3", [0.0, 0.0], "INVALID")], "uid string, v array<double>, answer string"))
    _, later = modelling.retrain(train, notes, test, "v", (("logistic", False),))
    assert later.count() == 1


def test_trees_of_the_grid_can_be_trained(rings):
    few = rings.limit(120).cache()
    for name in ("forest", "forest_subsample", "boosted"):
        fitted = modelling.fit(few, "v", name)
        assert modelling.metrics(fitted.score(few.select("uid", "v", "label"), "v"))["f1"] > 0.9


def test_platt_and_linear_margins(spark):
    rng = np.random.default_rng(5)
    f = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-2.0 * f + 0.5))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(f, y)], "m double, label int")
    a, b = modelling.platt_fit(df, "m", "label")
    assert a == pytest.approx(-2.0, abs=0.25) and b == pytest.approx(0.5, abs=0.2)
    rows = spark.createDataFrame([(float(x), [float(x), 1.0], int(x > 0)) for x in f[:300]], "m double, v array<double>, label int")
    model = learning.train(rows, "v", "linear_svm")
    got = learning.score(rows, model, "v", (-2.0, 0.0)).collect()
    assert all((r["pred_proba"] > 0.5) == (r["m"] > 0) for r in got if abs(r["m"]) > 0.2)


def test_perceptual_hash(spark):
    rng = np.random.default_rng(6)
    gray = rng.integers(0, 256, 1024).astype(float)
    noisy = np.clip(gray + rng.normal(0, 2, 1024), 0, 255)
    other = rng.integers(0, 256, 1024).astype(float)
    df = spark.createDataFrame([("a", gray.tolist()), ("b", noisy.tolist()), ("c", other.tolist()), ("d", [1.0]), ("e", None)], "uid string, g array<double>")
    got = {r["uid"]: r["phash"] for r in modelling.perceptual_hash(df, "g").collect()}
    bits = lambda x, y: bin(int(got[x], 16) ^ int(got[y], 16)).count("1")
    assert bits("a", "b") <= 6 < bits("a", "c") and got["d"] is None and got["e"] is None and len(got["a"]) == 16


def test_blinding_and_keepers(spark):
    rows = spark.createDataFrame([(f"u{i}", "s" if i < 5 else "t") for i in range(10)], "uid string, stratum string")
    got = release.blinded(rows, ["uid"], 1).collect()
    assert [r["position"] for r in got] == list(range(1, 11)) and [r["uid"] for r in got] != sorted(r["uid"] for r in got)
    dup = relational.keepers(spark.createDataFrame([(1, "g"), (2, "g"), (3, None), (4, None)], "k int, g string"), "g", [F.asc("k")])
    assert {r["k"]: r["is_duplicate"] for r in dup.collect()} == {1: False, 2: True, 3: False, 4: False}


def test_spread_of_standards_and_summed_bounds(spark):
    codes = [(i, "q", "yes" if i % 2 else "no", "yes" if i % 3 else "no", "yes" if i < 8 else "no", 1.0 + i % 2) for i in range(12)] + [(1, "none", "yes", "no", "no", 1.0), (2, "none", None, "no", "no", 1.0)]
    gold = statistics.reference_standards(spark.createDataFrame(codes, "uid int, field string, l string, r string, model string, w double"), ["uid", "field", "model", "w"], "l", "r")
    got = {(r["field"], r["variant"]): r for r in coding.standard_summary(gold, "field", "model", "yes", "w").collect()}
    assert set(got) == {("q", "A"), ("q", "B"), ("q", "C"), ("none", "A"), ("none", "B")}
    for variant, pick in (("A", 2), ("B", 3)):
        rows = [c for c in codes[:12] if c[4] == "yes"]
        assert got["q", variant]["precision"] == round(sum(c[5] for c in rows if c[pick] == "yes") / sum(c[5] for c in rows), 6)
        assert got["q", variant]["agreement"] == round(sum(c[pick] == c[4] for c in codes[:12]) / 12, 6)
    p = [got["q", v]["precision"] for v in "ABC"]
    assert got["q", "A"]["spread"] == round(max(p) - min(p), 6) and got["q", "C"]["n_gold"] == sum(c[2] == c[3] for c in codes[:12])
    assert (got["none", "A"]["n"], got["none", "A"]["precision"], got["none", "A"]["spread"]) == (0, None, None)
    strata = spark.createDataFrame([("a", 10, 5, 101), ("b", 0, 0, 50), ("c", 4, 4, 7)], "s string, n long, k long, pop long")
    each = statistics.extrapolated(strata, ["s"], "n", "k", "pop")
    rows = {r["s"]: r for r in each.collect()}
    assert (rows["a"]["estimate"], rows["b"]["estimate"], rows["c"]["estimate"], rows["c"]["estimate_high"]) == (50, None, 7, 7)  # 50.5 goes to the even 50
    assert tuple(statistics.summed_bounds(each).first()) == (2, 57, rows["a"]["estimate_low"] + rows["c"]["estimate_low"], rows["a"]["estimate_high"] + 7)
    assert tuple(statistics.summed_bounds(each.limit(0)).first()) == (0, 0, 0, 0)


def test_best_f1_takes_the_lowest_score_and_a_half_without_rows(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    assert tuple(statistics.best_f1(rows, "label", "score").first()) == (0.7, 0.8)
    assert tuple(statistics.best_f1(rows.filter("label = 0"), "label", "score").first()) == (0.1, 0.0)
    assert tuple(statistics.best_f1(rows.limit(0), "label", "score").first()) == (0.5, 0.0)


def test_bootstraps_agree_with_resampled_rows(spark):
    rng = np.random.default_rng(8)
    a = rng.random(300) < 0.4
    b = np.where(rng.random(300) < 0.15, ~a, a)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "label int, p int")

    def kappa(x, y):
        po, pe = (x == y).mean(), x.mean() * y.mean() + (1 - x.mean()) * (1 - y.mean())
        return (po - pe) / (1 - pe)

    draws = [rng.integers(0, 300, 300) for _ in range(2000)]
    want = np.percentile([kappa(a[i], b[i]) for i in draws], [2.5, 97.5])
    r = statistics.bootstrap_kappa(df, "label", "p", 2000).first()
    assert (r["low"], r["high"]) == pytest.approx(tuple(want), abs=0.02) and r["n"] == 300
    got = {r["metric"]: r for r in statistics.bootstrap_f1(df, "label", F.col("p") == 1).collect()}
    for metric, f in (("precision", lambda x, y: (x & y).sum() / y.sum()), ("recall", lambda x, y: (x & y).sum() / x.sum()), ("f1", lambda x, y: 2 * (x & y).sum() / (x.sum() + y.sum()))):
        low, high = np.percentile([f(a[i], b[i]) for i in draws], [2.5, 97.5])
        assert (got[metric]["low"], got[metric]["high"]) == pytest.approx((low, high), abs=0.02)
    empty = statistics.bootstrap_f1(df.limit(0), "label", F.col("p") == 1).first()
    assert empty["n"] == 0 and empty["mean"] is None
