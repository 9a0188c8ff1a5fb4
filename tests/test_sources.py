"""Files: shards, sinks, manifests, vectors, small tables."""

import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import tables


def test_missing_files_and_fallbacks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.parquet_files(spark, str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "a"))
    assert tables.parquet_files(spark, str(tmp_path / "a")).count() == 3
    read = spark.read.parquet
    assert tables.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a")], read).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [str(tmp_path / "no")], read)


def test_shards_are_listed_fetched_once_and_errors_kept(spark, tmp_path):
    for n in range(2):
        spark.range(n + 1).coalesce(1).write.parquet(str(tmp_path / f"far{n}"))
    files = {n: [str(next((tmp_path / f"far{n}").glob("*.parquet")))] for n in range(2)}
    (tmp_path / "shards.json").write_text(json.dumps({**files, 2: [str(tmp_path / "gone.parquet")]}))
    shards = tables.listed_shards(spark, str(tmp_path / "shards.json"))
    assert [n for n, _ in shards] == [0, 1, 2] and len(tables.listed_shards(spark, str(tmp_path / "shards.json"), "1")) == 1
    with pytest.raises(ValueError):
        tables.listed_shards(spark, str(tmp_path / "shards.json"), "7")
    paths, errors = tables.fetched(spark, shards, str(tmp_path / "cache"))
    assert len(paths) == 2 and [e[0] for e in errors] == [str(tmp_path / "gone.parquet")]
    stamp = [(tmp_path / "cache" / f"part={n}").stat().st_mtime_ns for n in range(2)]
    assert tables.fetched(spark, shards[:2], str(tmp_path / "cache")) == (paths, []) and stamp == [(tmp_path / "cache" / f"part={n}").stat().st_mtime_ns for n in range(2)]
    got = tables.with_file(spark.read.option("basePath", str(tmp_path / "cache")).parquet(*paths)).select("id", "part", "input_part")
    assert sorted(map(tuple, got.collect())) == [(0, 0, "0"), (0, 1, "1"), (1, 1, "1")]
    (tmp_path / "uids.txt").write_text("a\n\n b \n")
    assert [r["uid"] for r in tables.text_list(spark, str(tmp_path / "uids.txt")).collect()] == ["a", "b"]


def test_sqlite_by_ranges(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "s.db")
    con.execute("create table t (uid text, n integer, x real)")
    con.executemany("insert into t values (?, ?, ?)", [(f"u{i}", i if i % 3 else None, i / 2) for i in range(25)])
    con.execute("create table e (uid text)")
    con.commit()
    con.close()
    got = tables.sqlite(spark, str(tmp_path / "s.db"), "t", "uid string, n long, x double", 7)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(f"u{i}", i if i % 3 else None, i / 2) for i in range(25)]
    assert tables.sqlite(spark, str(tmp_path / "s.db"), "e", "uid string").count() == 0


def test_small_files_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "x.txt")
    for text in ("one", "two é"):
        tables.write_text(spark, path, text)
        assert tables.read_text(spark, path) == text
    assert not (tmp_path / "x.txt.part").exists()
    (tmp_path / "step1.md").write_text("Say yes.")
    prompts = tables.Prompts(spark, str(tmp_path))
    assert prompts["step1"] == "Say yes."
    (tmp_path / "step1.md").unlink()
    assert prompts["step1"] == "Say yes."
    fields = tables.codebook("gates:\n - field: i2\n   label: Is it?\n   values: [yes_, no_]\n - id: m1\n   values:\n    - value: classed\n")
    assert [f["field"] for f in fields] == ["i2", "m1"] and fields[1]["values"] == ["classed"]


def test_sinks(spark, tmp_path):
    df = spark.range(25).select(F.concat(F.lit("u"), "id").alias("uid"), F.col("id").alias("n"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    at = lambda n: str(tmp_path / n)
    tables.write_batches(df.coalesce(1), at("small"), 10)
    tables.write_batches(df.limit(0), at("small"), 10)
    assert len(list((tmp_path / "small").glob("*.gz.parquet"))) >= 3
    tables.compact(spark, at("small"), at("big"))
    assert len(list((tmp_path / "big").glob("*.parquet"))) == 1 and spark.read.parquet(at("big")).count() == 25
    tables.copy_without(spark, at("big"), at("thin"), ["v"])
    assert spark.read.parquet(at("thin")).columns == ["uid", "n"]
    tables.write_csv(df.select("uid", "n"), at("csv"))
    assert tables.csv(spark, at("csv"), "uid string, n long").count() == 25 and len(list((tmp_path / "csv").glob("*.csv"))) == 1
    tables.write_json(spark, at("r.json"), df.select("uid").limit(1))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"uid": "u0"}]
    tables.write_uids(df, at("ids"))
    assert sorted(r["uid"] for r in tables.text_list(spark, at("ids")).collect()) == sorted(f"u{i}" for i in range(25))
    tables.write_vectors(df, at("npz"), vector="v", rows_per_file=10)
    got = tables.read_vectors(spark.read.parquet(at("npz")))
    assert {r["uid"]: list(r["embedding"]) for r in got.collect()} == {f"u{i}": [1.0, float(i)] for i in range(25)}


def test_release_constants_manifest_and_verification(spark, tmp_path):
    df = spark.range(5).select(F.concat(F.lit("u"), "id").alias("uid"), F.col("id").alias("n"))
    path, listed = str(tmp_path / "r"), str(tmp_path / "schema.json")
    tables.write_release(df.coalesce(1), path, {"language": "en"})
    assert tables.constants_of(spark.read.parquet(path)) == {"language": "en"} and tables.constants_of(df) == {}
    entries = tables.manifest(spark, path, "a table")
    file = next((tmp_path / "r").glob("*.parquet"))
    assert len(entries) == 1 and entries[0]["bytes"] == file.stat().st_size and entries[0]["sha256"] == hashlib.sha256(file.read_bytes()).hexdigest()
    assert entries[0]["rows"] == 5 and [c["name"] for c in entries[0]["columns"]] == ["uid", "n"]
    assert tables.write_manifest(spark, listed, entries, "p") == [(file.name, False)]
    assert tables.write_manifest(spark, listed, [{**entries[0], "note": "", "sha256": "0"}], "p") == [(file.name, True)]
    kept = tables.read_manifest(spark, listed)
    assert kept["files"][0]["note"] == "a table" and tables.verify_files(spark, path, kept) == [(file.name, "checksum differs")]
    assert tables.verify_files(spark, path, {"files": entries}) == [] and tables.verify_files(spark, path, {"files": []}) == [(file.name, "not listed")]
    assert tables.verify_files(spark, path, {"files": [*entries, {"file": "x", "sha256": ""}]}) == [("x", "missing")]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "b.tif").write_bytes(b"II*\x00zzzzzzzz")
    (tmp_path / "c.html").write_bytes(b"<html>")
    images = tables.images(spark, str(tmp_path))

    def decode(content):
        if content.startswith(b"<"):
            raise ValueError("no picture")
        return {"width": len(content), "height": 2}

    got = {r["path"].rpartition("/")[2]: r for r in tables.decoded(images, decode, "width int, height int").collect()}
    assert [got[n]["format"] for n in ("a.png", "b.tif", "c.html")] == ["PNG", "TIFF", None]
    assert (got["a.png"]["width"], got["a.png"]["decoded"], got["c.html"]["decoded"], got["c.html"]["width"]) == (12, True, False, None)
    types = spark.createDataFrame([(bytearray(b"\xff\xd8\xff0"), "image/jpeg"), (bytearray(b"\xff\xd8\xff0"), "Text/html; x"), (bytearray(b"<h"), None), (bytearray(b"GIF89a"), None)], "c binary, t string")
    assert [r[0] for r in types.select(tables.looks_like_image(F.col("c"), F.col("t"))).collect()] == [True, False, False, True]


def test_payloads(spark, tmp_path):
    def resize(content, longest):
        if not content.startswith(b"ok"):
            raise ValueError("no picture")
        return content[:longest], "image/png"

    pictures = spark.createDataFrame([("a", bytearray(b"ok-and-long")), ("b", bytearray(b"bad")), ("c", None)], "uid string, content binary")
    got = {r["uid"]: (r["media_type"], r["base64"], r["decoded"]) for r in tables.image_payload(pictures, resize, 5).collect()}
    assert got == {"a": ("image/png", "b2stYW4=", True), "b": (None, None, False), "c": (None, None, False)}
    shown = spark.createDataFrame([(2, "u1", "u1.png"), (1, "u2", "ü2.png")], "position int, uid string, file string")
    tables.write_payload(spark, str(tmp_path / "maps"), shown, "SAMPLE", order_seed=43)
    body = json.loads((tmp_path / "maps.json").read_text())
    assert body == {"order_seed": 43, "n": 2, "items": [{"uid": "u2", "file": "ü2.png"}, {"uid": "u1", "file": "u1.png"}]}
    script = (tmp_path / "maps.js").read_text()
    assert script.startswith("window.SAMPLE = {") and json.loads(script[len("window.SAMPLE = "):].rstrip(";\n")) == body
