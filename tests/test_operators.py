"""Hand-written cases and properties."""

import hashlib
import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import cascade, relational, release, statistics
from corpusloom.sources import tables


def one(spark, col, rows="1 as x"):
    return spark.range(1).selectExpr(*rows.split(";")).select(col).first()[0]


@pytest.mark.parametrize("text,expected", [("GDP per capita", 7.0), ("statewide state State", 1.0), ("a_gdp b", 3.0), (None, 0.0), ("gdps", 0.0)])
def test_phrase_scores(spark, text, expected):
    words = spark.createDataFrame([("gdp", 3.0), ("per capita", 4.0), ("state", 1.0)], "phrase string, weight double")
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    hits = relational.match_phrases(docs, "id", "text", words).collect()
    assert sum(h["weight"] for h in hits) == expected
    for most in ((0, 200_000), (0, 0)):
        assert sorted(hits) == sorted(relational.match_phrases(docs, "id", "text", words, *most).collect())


def test_negative_weight_wins(spark):
    make = lambda x: spark.createDataFrame(x, "phrase string, weight double")
    got = relational.merge_dictionaries(make([("a", 1.0), ("b", 2.0)]), make([("b", -1.0)])).collect()
    assert sorted(map(tuple, got)) == [("a", 1.0), ("b", -1.0)]


@pytest.mark.parametrize("url,norm,domain", [("http://www.a.com/x/", "a.com/x", "a.com"), ("https://a.com/x", "a.com/x", "a.com"), ("", "", None), (None, None, None)])
def test_urls(spark, url, norm, domain):
    r = spark.createDataFrame([(url,)], "u string").select(S.url_norm(F.col("u")).alias("n"), S.domain_of(S.url_norm(F.col("u"))).alias("d")).first()
    assert (r["n"], r["d"]) == (norm, domain)


@pytest.mark.parametrize("w,h,ok", [(400, 4000, True), (399, 4000, False), (None, 500, False)])
def test_size_gate(spark, w, h, ok):
    assert spark.createDataFrame([(w, h)], "w int, h int").select(cascade.size_gate(F.col("w"), F.col("h"))).first()[0] is ok


def test_type_rule_and_repairs(spark):
    df = spark.createDataFrame([(True, None, False, True)], "choropleth boolean, legend boolean, stat boolean, quant boolean")
    f2, f3, passed = cascade.type_rule({"choropleth": F.col("choropleth")}, F.col("legend"))
    q = cascade.repaired_quantitative(F.col("stat"), F.col("quant"))
    assert tuple(df.select(f2, f3, passed, q, cascade.data_level(F.col("stat"), q)).first()) == (True, False, False, False, "not_applicable")


def test_wilson_kish_entropy(spark):
    df = spark.createDataFrame([(0.5, 0), (1.0, 10)], "p double, n int")
    low, high = S.wilson(F.col("p"), F.col("n"))
    a, b = df.select(low.alias("l"), high.alias("h")).collect()
    assert tuple(a) == (None, None) and b["h"] == 1.0 and 0 < b["l"] < 1
    assert spark.createDataFrame([(10.0,), (1.0,)], "w double").agg(S.kish(F.col("w"))).first()[0] == pytest.approx(121 / 101)
    r = spark.createDataFrame([(0.5,)], "p double").select(*(f(F.col("p")) for f in (S.entropy, S.margin, S.least_confident))).first()
    assert tuple(r) == pytest.approx((1.0, 1.0, 1.0))


def test_kappa_undefined(spark):
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert tuple(statistics.cohen_kappa(same, "x", "y").first()) == (3, 1.0, None)
    empty = spark.createDataFrame([], "x string, y string")
    assert tuple(statistics.cohen_kappa(empty, "x", "y").first()) == (0, None, None)


def test_exact_tests():
    assert statistics.mcnemar_p(0, 0) == 1.0
    assert statistics.mcnemar_p(1, 9) == pytest.approx(2 * (1 + 10) / 1024)
    assert statistics.fisher_p(3, 1, 1, 3) == pytest.approx(34 / 70)


def plain_fisher(a, b, c, d):
    """By whole numbers, each weight from the one before."""
    r, s, k = a + b, c + d, a + c
    own, x, total = math.comb(r, a) * math.comb(s, c), max(0, k - s), 0
    w = math.comb(r, x) * math.comb(s, k - x)
    for x in range(x, min(r, k) + 1):
        total += w if w <= own else 0
        w = w * (r - x) * (k - x) // ((x + 1) * (s - k + x + 1))
    return total / math.comb(r + s, k)


def test_fisher_of_small_tables_and_ties():
    for q in itertools.product(range(6), repeat=4):
        assert statistics.fisher_p(*q) == pytest.approx(plain_fisher(*q), rel=1e-12)


@pytest.mark.parametrize("counts", [(6000, 18000, 6100, 18100), (6050, 5950, 5950, 6050), (2162, 15670, 0, 2766), (6100, 17900, 6000, 18100)])
def test_fisher_of_great_counts_is_exact_and_quick(counts):
    began = time.process_time()
    p = statistics.fisher_p(*counts)
    assert time.process_time() - began < 0.5
    assert p == pytest.approx(plain_fisher(*counts), rel=1e-11)


@pytest.mark.parametrize("counts", [(10_000, 10_000), (10_300, 9_900), (9_900, 10_301), (0, 20_000), (60_000, 59_500)])
def test_mcnemar_of_great_counts_is_exact_and_quick(counts):
    began = time.process_time()
    p = statistics.mcnemar_p(*counts)
    assert time.process_time() - began < 0.5
    n, w, total = sum(counts), 1, 0
    for i in range(min(counts) + 1):
        total, w = total + w, w * (n - i) // (i + 1)
    assert p == pytest.approx(min(1.0, 2 * total / 2**n), rel=1e-11)


def test_running_matches_plain_sums(spark):
    rows = [(i % 37, i, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "o long, id long, v long")
    for descending in (False, True):
        got = {(r["o"], r["id"]): r["total"] for r in relational.running(df, "o", {"total": "v"}, buckets=8, descending=descending, tie="id").collect()}
        total = 0
        for o, i, v in sorted(rows, key=lambda r: (-r[0] if descending else r[0], r[1])):
            total += v
            assert got[o, i] == total
    assert relational.running(df.limit(0), "o", {"total": "v"}).count() == 0


def test_simhash_links_near_texts_and_not_every_pair_of_copies(spark):
    body = " ".join(f"word{i}" for i in range(400))
    texts = {9: body, 1: body, 2: body.upper(), 3: body + " one", 4: " ".join(f"other{i}" for i in range(400)), 5: None, 6: " \n"}
    hashes = relational.simhash(spark.createDataFrame([*texts.items(), (None, body)], "k long, t string"), "k", "t")
    got = {r["k"]: r["hash"] for r in hashes.collect()}
    assert got[9] == got[1] == got[2] == got[None] and got[5] is None and got[6] is None

    def votes(text, bit):
        return sum(1 if int(hashlib.md5(w.encode()).hexdigest()[:16], 16) >> bit & 1 else -1 for w in text.lower().split())

    assert all(int(got[k], 16) == sum((votes(texts[k], b) > 0) << b for b in range(64)) for k in (1, 3, 4))
    links = {tuple(r) for r in relational.near_hash_links(hashes, "k", "hash").collect()}
    bits = bin(int(got[1], 16) ^ int(got[3], 16)).count("1")
    assert links == {(1, 2, 0), (1, 9, 0)} | ({(1, 3, bits)} if bits <= 2 else set())


def test_near_hash_links_miss_no_pair(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = {k: base[k % 20] ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(3))}) for k in range(200)}
    df = spark.createDataFrame([(k, f"{h:016x}") for k, h in hashes.items()], "k long, h string")
    node = {}
    for k, h in sorted(hashes.items()):
        node.setdefault(h, k)
    want = {(node[h], k, 0) for k, h in hashes.items() if node[h] != k}
    want |= {(a, b, bin(g ^ h).count("1")) for g, a in node.items() for h, b in node.items() if a < b and bin(g ^ h).count("1") <= 2}
    got = [tuple(r) for r in relational.near_hash_links(df, "k", "h").collect()]
    assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        relational.near_hash_links(df, "k", "h", 3)


def test_cascade_is_idempotent(spark, tmp_path):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "uid string, x int")
    calls = []

    def gate(least):
        def run(df):
            calls.append(df.count())
            return df.select("uid", F.lit("done").alias("status"), (F.col("x") >= least).alias("passed"))

        return run

    def save(df):
        path = str(tmp_path / f"log{len(calls)}-{id(df)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    gates = [("g1", gate(2)), ("g2", gate(3))]
    log = cascade.run_gates(items, spark.createDataFrame([], cascade.ATTEMPT), gates, save)
    assert calls == [3, 2] and log.count() == 5
    again = cascade.run_gates(items, log, gates, save)
    assert calls == [3, 2, 0, 0] and again.count() == 5


def test_json_and_verdicts(spark):
    df = spark.createDataFrame([('```json\n{"a": true}\n```',), ("none",), ('{"a": "true"}',)], "t string")
    got = df.select(S.json_object(F.col("t")).alias("b")).select("b", S.strict_bool(F.col("b"), "a").alias("a")).collect()
    assert [r["a"] for r in got] == [True, None, None] and got[1]["b"] is None
    img = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n0000"),), (bytearray(b"zz"),)], "c binary").select(tables.image_format(F.col("c"))).collect()
    assert [r[0] for r in img] == ["PNG", None]


def test_json_is_the_longest_prefix_that_parses(spark):
    want = {
        '{"a":1} see {b}': '{"a":1}', '{"a":1}} x': '{"a":1}', '{"a":{"b":"}"}} t } u': '{"a":{"b":"}"}}', '{"a":1} {"b":2}': '{"a":1}', '{"a":1},{"b":2}': '{"a":1}',
        '{"a":1},"b":{}': '{"a":1}', '{"a":1}] }': '{"a":1}', 'x {b} {"a":1}': None, '{"a": 1': None, "}{": None, "": None, None: None, 'so: {"a": [{}, {}]}\n': '{"a": [{}, {}]}',
    }
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", S.json_object(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["b"] for r in got} == want


def test_require_and_markdown(spark):
    df = spark.createDataFrame([("x", 3)], "name string, n long")
    release.require(df, {"x": 3})
    with pytest.raises(ValueError):
        release.require(df, {"x": 4})
    assert "| x | 3 |" in tables.markdown(df.collect(), ["name", "n"])


def test_files(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 as part")
    tables.write_parts(df, str(tmp_path / "parts"))
    assert tables.shards(spark, str(tmp_path / "parts"), [1], ["id"]).count() == 5
    (tmp_path / "d.json").write_text('{"a b": 1.5, "c": -2}')
    assert sorted(map(tuple, tables.json_map(spark, str(tmp_path / "d.json")).collect())) == [("a b", 1.5), ("c", -2.0)]
    (tmp_path / "x.csv").write_text("a,b\n1,\n,2\n")
    assert sorted(map(tuple, tables.csv(spark, str(tmp_path / "x.csv")).collect())) == [("", "2"), ("1", "")]
    assert tables.key_values(["# c", "A='x'", "B = y"]) == {"A": "x", "B": "y"}


def test_stream_resumes(spark, tmp_path):
    from corpusloom.streaming.events import resume_files

    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    spark.range(5).write.parquet(src)
    for extra in (0, 3):
        if extra:
            spark.range(extra).write.mode("append").parquet(src)
        resume_files(spark, src, "id long", lambda df: df.filter("id > 0"), sink, mark)
    assert spark.read.parquet(sink).count() == 4 + 2


def test_svm_scores(spark):
    import numpy as np

    from corpusloom.operators import learning

    rng = np.random.default_rng(1)
    x, sv, a = rng.normal(size=(5, 3)), rng.normal(size=(4, 3)), rng.normal(size=4)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "k long, v array<double>")
    got = {r["k"]: r["pred_proba"] for r in learning.svm_scores(df, "k", "v", sv, a, 0.2, 0.5, (-2.0, 0.1)).collect()}
    for i, row in enumerate(x):
        f = sum(w * math.exp(-0.5 * ((row - s) ** 2).sum()) for w, s in zip(a, sv)) + 0.2
        assert got[i] == pytest.approx(1 / (1 + math.exp(-2.0 * f + 0.1)))
