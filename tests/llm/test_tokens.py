"""Encoder, packing, bit packing, token counts."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bitpack, counts, packing, shared
from corpusloom.llm.encoder import Encoder, public_path

TEXTS = [None, "", " ", "a", "It's 12 words.\nand  two   spaces ", "ΣΑΣ σ İstanbul", "日本 語", "x<|endoftext|>y", "word " * 3000, "same text", "same text", "\x1c \x85 z"]
DOCS = "doc_id long, text string, ids string, copy int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(7 * i % 12, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "repeated row", "x", 1)] * 2, DOCS).repartition(3)


def plain_ids(name, text, end):
    from tokenizers import Tokenizer

    tok = plain_ids.cache.setdefault(name, Tokenizer.from_file(public_path(name)))
    return tok.encode(text or "", add_special_tokens=False).ids + [end]


plain_ids.cache = {}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_exact(name):
    enc, rng = Encoder(public_path(name), most_words=50), random.Random(1)
    odd = ["".join(rng.choices(list(" \n\tab'sé1.Σ! |<>é\u0301 日"), k=rng.randint(0, 14))) for _ in range(2000)]
    for text in [t for t in TEXTS if t is not None] + odd:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_unknown_layout_is_encoded_whole(tmp_path):
    import json

    spec = json.load(open(public_path("byte_bpe_50k.json")))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    enc = Encoder(str(tmp_path / "t.json"))
    assert enc.layout == "whole" and np.frombuffer(enc.encode("a b"), "<u4").tolist() == enc.tok.encode("a b", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        shard = bitpack.pack(ids, bits, 128)
        assert (bitpack.unpack(shard) == ids).all()
        for a, b in ((0, 1), (100, 300), (n - 1, n + 5), (5, 5)):
            assert (bitpack.unpack(shard, a, b) == ids[max(0, a) : b]).all()
        assert len(shard) <= bitpack.HEADER.size + 8 * (n // 128 + 1) + bits * (n + 64) / 8
        reader = bitpack.Reader(io.BytesIO(bitpack.pack(ids, bits, 128, [5, -7], [n // 3, n - n // 3])))
        doc_ids, ends = reader.documents()
        assert doc_ids.tolist() == [5, -7] and ends.tolist() == [n // 3, n] and (reader.ids(n // 3, n) == ids[n // 3 :]).all()
    with pytest.raises(ValueError):
        bitpack.pack(np.array([1 << bits], np.uint64), bits)


def test_random_access_reads_only_the_blocks_asked_for():
    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            self.total += len(out)
            return out

    ids = np.arange(1 << 20) % 50_000
    file = Counted(bitpack.pack(ids.astype(np.uint64), 16, 4096))
    assert (bitpack.Reader(file).ids(700_000, 700_010) == ids[700_000:700_010]).all() and file.total < 3 * 4096 * 2


def test_files_round_trip(spark, docs):
    path = shared.new_path(spark, "t")
    manifest = bitpack.write_ids(docs, path, public_path("byte_bpe_50k.json"), 0, file_ids=500, partition_bytes=300)
    place, folder = bitpack.store(path)
    with place.open_output_stream(f"{folder}/00000000-000000-left-by-a-lost-attempt.clbp") as out:
        out.write(b"half")
    got = sorted(map(tuple, bitpack.read_documents(manifest, path).collect()), key=lambda r: r[1])
    want, start = [], 0
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])
    for doc_id, text in rows:
        ids = plain_ids("byte_bpe_50k.json", text, 0)
        want.append((doc_id, len(ids), crc(ids)))
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted(want) and [r[0] for r in got] == [r[0] for r in rows]
    for r in got:
        assert r[1] == start
        start += r[2]
    again = shared.new_path(spark, "t")
    once_more = bitpack.read_documents(bitpack.write_ids(docs.repartition(2), again, public_path("byte_bpe_50k.json"), 0, partition_bytes=300), again)
    assert sorted(map(tuple, once_more.collect()), key=lambda r: r[1]) == got


def test_null_ids_and_empty_table(spark):
    one = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")

    def through(df):
        path = shared.new_path(spark, "t")
        return bitpack.read_documents(bitpack.write_ids(df, path, public_path("byte_bpe_50k.json")), path)

    assert sorted((r["doc_id"] is None, r["start"]) for r in through(one).collect()) == [(False, 2), (True, 0)]
    assert through(one.limit(0)).count() == 0
    assert packing.pack_documents(one.limit(0), public_path("word_bpe_49k.json")).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, at = [], {}
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        at[i] = (k, 100 - room[k])
        room[k] -= lengths[i]
    assert [(b, o) for b, o in zip(bins, offsets)] == [at[i] for i in range(500)]


def test_packing_covers_every_id_once(spark, docs):
    rows = packing.pack_documents(docs, public_path("word_bpe_49k.json"), group_rows=5).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["copy"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for (doc_id, _), parts in pieces.items():
        parts.sort(key=lambda r: r["start"])
        ends = np.cumsum([0] + [p["length"] for p in parts]).tolist()
        assert [p["start"] for p in parts] == ends[:-1] and parts[0]["doc_tokens"] == ends[-1]
        assert any(all(crc(ids[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for p in parts) and len(ids) == ends[-1] for ids in (plain_ids("word_bpe_49k.json", t, 1) for t in texts[doc_id]))
    assert len(pieces) == docs.count()
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0] + [p["length"] for p in parts]).tolist()
        assert [p["offset"] for p in parts] == ends[:-1] and ends[-1] <= 2048


def test_padding_is_little_and_ids_come_out(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 3000)) for i in range(400)], "doc_id long, text string")
    out = packing.packed_sequences(docs, public_path("word_bpe_49k.json"), group_rows=300).collect()
    total, pad = sum(r["n_tokens"] for r in out), sum(r["n_padding"] for r in out)
    assert pad < 0.03 * total
    assert total == sum(r["length"] for r in packing.pack_documents(docs, public_path("word_bpe_49k.json")).collect())
    assert all(len(r["ids"]) == r["n_tokens"] + r["n_padding"] for r in out)


def test_rollup(spark, docs):
    names = {"b": public_path("byte_bpe_50k.json")}
    rollup = counts.Rollup(spark, shared.new_path(spark, "r"), names)
    assert rollup.totals().count() == 0
    rows = docs.select(F.lit("s").alias("source"), F.when(F.col("doc_id") % 2 == 0, "en").alias("lang"), "text", F.lit(1).alias("sign"))
    assert rollup.commit("b1", rows) and not rollup.commit("b1", rows)
    want = {}
    for r in docs.collect():
        k = "en" if r["doc_id"] % 2 == 0 else None
        n, t, c = want.get(k, (0, 0, 0))
        want[k] = (n + 1, t + len(plain_ids("byte_bpe_50k.json", r["text"], 0)) - 1, c + len(r["text"] or ""))

    def totals():
        return {r["lang"]: (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in rollup.totals().collect()}

    assert totals() == want
    revision = spark.createDataFrame([("s", "en", "same text", -1), ("s", "en", "same text, revised", 1)], "source string, lang string, text string, sign int")
    rollup.commit("2024-01-01T00:00:00 /*?", revision)
    more = len(plain_ids("byte_bpe_50k.json", "same text, revised", 0)) - len(plain_ids("byte_bpe_50k.json", "same text", 0))
    assert totals()["en"] == (want["en"][0], want["en"][1] + more, want["en"][2] + 9)
    rollup.commit("b3", rows.withColumn("sign", F.lit(-1)))
    assert [r["n_docs"] for r in rollup.totals().collect()] == [0]


def test_batches_without_a_marker_and_folds(spark, docs):
    rollup = counts.Rollup(spark, shared.new_path(spark, "r"), {"b": public_path("byte_bpe_50k.json"), "w": public_path("word_bpe_49k.json")})
    rows = docs.select(F.lit("s").alias("source"), F.lit("en").alias("lang"), "text", F.lit(1).alias("sign"), F.lit("x").alias("counts"))
    rollup.commit("a", rows)
    before = sorted(map(tuple, rollup.totals().collect()))
    assert {r[2] for r in before} == {"b", "w"} and all(r[3] == docs.count() for r in before)
    rollup.commit("half", rows)
    fs, marker = shared._store(spark, f"{rollup.root}/batches/{rollup._name('half')}/_SUCCESS")
    fs.delete(marker, True)
    assert not rollup.committed("half") and sorted(map(tuple, rollup.totals().collect())) == before
    rollup.compact()
    fs, folder = shared._store(spark, f"{rollup.root}/batches")
    fs.delete(folder, True)
    assert sorted(map(tuple, rollup.totals().collect())) == before and rollup.committed("a") and not rollup.commit("a", rows)
    assert rollup.commit("half", rows) and rollup.commit("gone", rows.withColumn("sign", F.lit(-1)))
    rollup.compact()
    rollup.compact()
    assert sorted(map(tuple, rollup.totals().collect())) == before and not rollup.commit("gone", rows)


def test_token_totals_of_the_query(spark):
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in counts.op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        for name in ("byte_bpe_50k", "word_bpe_49k"):
            k = (r["source"], r["lang"], name)
            n, t, c = want.get(k, (0, 0, 0))
            want[k] = (n + 1, t + len(plain_ids(f"{name}.json", r["text"], 0)) - 1, c + len(r["text"] or ""))
    assert got == want
