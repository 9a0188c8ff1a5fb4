"""Near-duplicate groups and the whole pipeline."""

import random
import zlib

import numpy as np
import pytest
from plain import SECRETS, contamination, near_groups, near_links, probability_jaccard, quality, shingle_counts, spans
from pyspark.sql import functions as F

from corpusloom.llm import components, neardup
from corpusloom.llm import quality as Q
from corpusloom.llm.encoder import public_path


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = {0: None, 1: "", 2: "two words", 3: "two  words", 4: "\n "}
    base = [rng.choices(vocabulary, k=120) for _ in range(n)]
    for words in base:
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = "edit"
            out[len(out)] = " ".join(copy)
    hub = rng.choices(vocabulary, k=150)
    for _ in range(80):
        copy = list(hub)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        out[len(out)] = " ".join(copy)
    out[len(out)] = "a line that repeats itself often. " * 30 + " ".join(rng.choices(vocabulary, k=30))
    out[len(out)] = "a line that repeats itself often. " * 29 + " ".join(rng.choices(vocabulary, k=30))
    return out


def test_signatures_estimate_probability_jaccard():
    docs = corpus()
    texts = [docs[i] for i in list(docs)[5:60]]
    sets = [neardup.shingles(t) for t in texts]
    sigs = neardup.prob_minhash(sets, 2048)
    plain = [shingle_counts(t) for t in texts]
    for i in range(0, len(texts) - 1):
        want = probability_jaccard(plain[i], plain[i + 1])
        assert neardup.probability_jaccard(*sets[i], *sets[i + 1]) == pytest.approx(want)
        assert abs(neardup.estimate((sigs[i] == sigs[i + 1]).sum(), 2048) - want) < 0.06
    a = ({"x": 3, "y": 1}, {"x": 1, "y": 2, "z": 4})
    arrays = [(np.array([ord(k) for k in s], np.uint64), np.array(list(s.values()))) for s in a]
    assert neardup.probability_jaccard(*arrays[0], *arrays[1]) == pytest.approx(probability_jaccard(*a))


@pytest.mark.parametrize("block", [7, 512])
def test_groups_match_brute_force(spark, block):
    docs = corpus()
    want = near_groups(docs)
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in docs.items()], "doc_id long, text string, key string, n int").repartition(5)
    out = neardup.near_duplicates(df, block=block, canopy_block=block, spokes=block).collect()
    assert {r["doc_id"]: r["group_id"] for r in out} == want and len(out) == len(docs)
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in out)


def test_kept_rows_and_clashing_columns(spark):
    docs = {i: t for i, t in corpus(2, 12).items()}
    names = ["row", "_row", "gone", "id", "hub", "node", "key"]
    df = spark.createDataFrame([(i, t, *[f"c{i}"] * len(names)) for i, t in docs.items()], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).repartition(5)
    kept = neardup.drop_near_duplicates(df)
    rows = kept.collect()
    assert kept.columns == df.columns and {r["doc_id"] for r in rows} == set(near_groups(docs).values())
    assert all(r["gone"] == r["row"] == f"c{r['doc_id']}" and r["text"] == docs[r["doc_id"]] for r in rows)
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_recall_on_a_real_table(spark):
    """Links of all pairs are found: of whole documents, copies and near copies as they are in the tables."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    groups = {r["doc_id"]: r["group_id"] for r in neardup.op1_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    links = near_links(docs)
    found = sum(groups[a] == groups[b] for a, b in links)
    assert len(links) > 50 and found >= 0.99 * len(links)
    assert groups.items() <= near_groups(docs).items() or found < len(links)


def test_a_very_long_text_and_its_copy(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (4, "w " * 300_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_rows_grow_with_the_group_not_its_square(spark):
    """Stars write a row for each spoke and part; blocks of a large class meet only the few blocks of others."""
    for m in (1_000, 20_000):
        pairs = spark.range(1, m).selectExpr("0L as hub", "id as node")
        assert neardup._stars(pairs, 256).count() <= m - 1 + -(-m // 256)
        rows = spark.range(m + 10).selectExpr("0L as canopy", "id as node", "case when id < " + str(m) + " then 0L else id end as class")
        across = neardup._across(rows, "canopy", 128)
        assert across.count() <= 3 * m
    met = {(r["i"], r["j"]) for r in across.collect()}
    own = {r["node"]: r["own"] for r in across.collect()}
    assert all((min(own[a], own[b]), max(own[a], own[b])) in met for a in range(20_000, 20_010) for b in range(0, 20_010, 97) if a != b)


def test_comparisons_across_classes_miss_no_link():
    rng = np.random.default_rng(3)
    sets = [neardup.shingles(" ".join(f"w{v}" for v in rng.integers(0, 3, 40))) for _ in range(20)]
    sets += [sets[0], sets[5]]
    classes = np.array([0, 0, 1, 1, *range(2, 20)])
    for sides in (None, np.arange(22) % 2):
        links = neardup.verified_links(sets, 0.5, classes, sides)
        u = neardup._sides(22, classes, None)[0]
        for i, j in links:
            assert classes[i] != classes[j]
            u.join(i, j)
        for i in range(22):
            for j in range(i + 1, 22):
                common = len(np.intersect1d(sets[i][0], sets[j][0]))
                alike = common / (len(sets[i][0]) + len(sets[j][0]) - common) >= 0.5 or neardup.probability_jaccard(*sets[i], *sets[j]) >= 0.5
                if alike and (sides is None or sides[i] != sides[j]):
                    assert u.find(i) == u.find(j)


def test_scratch_is_deleted_and_a_shared_folder_demanded(spark):
    from corpusloom.llm import shared

    scratch = shared.Scratch(spark, "t")
    scratch.put(spark.range(3), "a")
    assert shared.exists(spark, scratch.folder)
    scratch.drop()
    assert not shared.exists(spark, scratch.folder)
    assert shared.fresh("a", ["A", "a_"]) == "a__"

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


def test_plain_links_of_texts_that_repeat_a_line(spark):
    rng = random.Random(7)
    docs = {}
    for g in range(12):
        body = [f"b{g}w{rng.randrange(10**6)}" for _ in range(200)]
        line = [f"b{g}l{k}" for k in range(12)]
        for times in (1, 21, 41):
            docs[len(docs)] = " ".join(body + line * times)
    sets = [shingle_counts(t) for t in docs.values()]
    for i in range(0, len(sets), 3):
        assert len(sets[i].keys() & sets[i + 1].keys()) >= 0.9 * len(sets[i].keys() | sets[i + 1].keys())
        assert probability_jaccard(sets[i], sets[i + 1]) < 0.6
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(df).collect()} == {i: i - i % 3 for i in docs}


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(5, "some text of six words here"), (5, "some text of six words here"), (None, "x")], "doc_id long, text string")
    assert [tuple(r) for r in neardup.near_duplicates(df).collect()] == [(5, 5, True)] * 2
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    copied, unique, null_only = ("text number %d with six words more" % n for n in range(3))
    rows = [(3, copied), (5, copied), (5, unique), (7, "same row twice in this table"), (7, "same row twice in this table"), (None, copied), (None, null_only), (None, null_only), (None, None), (8, "")]
    for shift in (0, (1 << 63) - 9):
        df = spark.createDataFrame([(None if i is None else i + shift, t, "x") for i, t in rows], "doc_id long, text string, other string").repartition(3)
        out = sorted(((r["doc_id"] is None, (r["doc_id"] or shift) - shift, None if r["group_id"] is None else r["group_id"] - shift, r["kept"]) for r in neardup.near_duplicate_rows(df.select("doc_id", "text")).collect()), key=str)
        want = [(False, 3, 3, True), (False, 5, 3, False), (False, 5, 5, True), (False, 7, 7, True), (False, 7, 7, False), (False, 8, 8, True), (True, 0, 3, False), (True, 0, None, True), (True, 0, None, False), (True, 0, None, True)]
        assert out == sorted(want, key=str)
        kept = neardup.drop_near_duplicates(df)
        assert kept.columns == df.columns
        left = [(3, copied), (5, unique), (7, "same row twice in this table"), (None, null_only), (None, None), (8, "")]
        assert sorted(map(str, ((None if r[0] is None else r[0] - shift, r[1]) for r in kept.collect()))) == sorted(map(str, left))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {v: v for e in edges for v in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def plain_redact(text):
    out, at = "", 0
    for start, _, end, _ in spans(text, SECRETS):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    source = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{source}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    fails = spark.createDataFrame(sorted({(line,) for t in docs.values() for line in t.split("\n")}), "line string").select("line", Q.line_fails(F.col("line")).alias("f"))
    bad = {r["line"] for r in fails.collect() if r["f"]}
    kept = {}
    for i, text in docs.items():
        n_words, chars, _, _, repeated = quality(text)
        clean = "\n".join(line for line in text.split("\n") if line not in bad)
        lost = chars - quality(clean)[1]
        if n_words >= 50 and 100 * repeated <= 50 * n_words and lost <= chars / 2:
            kept[i] = clean
    groups = near_groups(kept)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    kept = {i: plain_redact(t) for i, t in kept.items() if not contamination(t, items)[-1]}
    tok = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, source).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(kept) and 4 <= len(corpus_pipeline.STAGES) <= 5
    for i, parts in pieces.items():
        ids = np.array(tok.encode(kept[i], add_special_tokens=False).ids + [1], "<u4")
        assert sum(p["length"] for p in parts) == len(ids)
        assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in parts)


def test_pipeline_stages_with_nulls_clashes_and_no_rows(spark):
    """Every stage but the last returns the columns it got, whatever they are called, and drops no unexamined row."""
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    good = " ".join(f"Alpha{i} beta{i} gamma{i} ends{i}." for i in range(30))
    names = ["findings", "_found", "_blob", "blob", "found", "_gone", "row", "_findings", "quality"]
    rows = [(1, good, "en", "s", 0), (None, good + " One more.", None, None, None), (3, None, "en", None, 4), (3, "", None, "s", None), (5, "token = abcdefgh12 " + good[::-1], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)
    empty = docs.limit(0)
    left = {"quality_rules": {1, None, 5}, "near_duplicates": {1, 3, 5}, "decontamination": {1, None, 3, 5}, "secret_scans": {1, None, 3, 5}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, source)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r["doc_id"] for r in got} == left[name] and all(r[n] == "x" for r in got for n in names), name
        none = stage(spark, empty, source)
        assert none.columns == docs.columns and none.count() == 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, source).collect()
    assert {r["doc_id"] for r in pieces} == {1, None, 3, 5} and len(pieces) == 5
    assert corpus_pipeline.STAGES[-1][1](spark, empty, source).count() == 0


def test_registered_queries_run(spark):
    import duckdb

    from corpusloom.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.sql(sql)
        order = [want.columns.index(c) for c in got.columns]
        key = lambda r: str(r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
