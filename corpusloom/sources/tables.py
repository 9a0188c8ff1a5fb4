"""Reading and writing tables: Parquet, CSV, JSON, text, images as bytes, parts, manifests, recorded responses."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shards(spark: SparkSession, root: str, parts: Iterable[int] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet shards below ``part=N`` folders, pruned to ``parts``, with only ``columns`` read."""
    df = spark.read.option("basePath", root).parquet(f"{root}/part=*")
    if parts is not None:
        df = df.filter(F.col("part").isin(*parts))
    return df.select(*columns) if columns is not None else df


def with_file(df: DataFrame) -> DataFrame:
    """The file and the part that each row came from."""
    return df.withColumn("input_file", F.col("_metadata.file_path")).withColumn("input_part", F.nullif(F.regexp_extract("input_file", r"part[_=](\d+)", 1), F.lit("")))


def write_parts(df: DataFrame, root: str, rows_per_file: int = 1_000_000) -> None:
    """zstd Parquet below ``part=N``; the row limit keeps a large part from becoming one file."""
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("part").parquet(root)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a schema typed, else all strings, where an empty field is an empty string."""
    reader = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\0")
    return reader.schema(schema).csv(path) if schema else reader.csv(path).na.fill("")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{phrase: weight}`` as rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))).alias("phrase", "weight"))


def first_existing(spark: SparkSession, paths: Iterable[str], read: Callable[[str], DataFrame]) -> DataFrame:
    """The first of ``paths`` that is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tried = list(paths)
    for path in tried:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return read(path)
    raise FileNotFoundError(f"none of {tried} exists")


def text_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("uid")).filter("uid <> ''")


def key_values(lines: Iterable[str]) -> dict[str, str]:
    """``NAME=value`` lines; blank lines and comments are skipped, quotes around a value dropped."""
    pairs = (line.split("=", 1) for line in map(str.strip, lines) if line and not line.startswith("#") and "=" in line)
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content and what the first bytes say about the format."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", "content", image_format(F.col("content")).alias("format"))


def image_format(content: Column) -> Column:
    """Format by magic bytes; null if none fits."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("474946383"), "GIF").when(head.startswith("52494646") & head.endswith("57454250"), "WEBP").when(head.startswith("424D"), "BMP").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")


def looks_like_image(content: Column, content_type: Column) -> Column:
    """Known first bytes, and no text type: servers send error pages with code 200."""
    text = F.startswith(F.lower(F.trim(F.coalesce(content_type, F.lit("")))), F.lit("text/"))
    return ~text & image_format(content).isNotNull()


def recorded(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """A connector without network: each request gets its recorded response, or nulls."""
    return requests.join(responses, keys, "left")


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _store(spark, path)
    return bool(fs.exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any store, written under another name and then put in its place at once."""
    fs, p = _store(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, p, options)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder; an error that names the folder if there is none."""
    fs, p = _store(spark, folder)
    found = fs.exists(p) and any(str(s.getPath().getName()).endswith(".parquet") for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*")) or [])
    if not found:
        raise FileNotFoundError(f"no Parquet file in {folder}")
    return spark.read.parquet(folder)


def listed_shards(spark: SparkSession, manifest_path: str, parts: str = "all") -> list[tuple[int, str]]:
    """(part, path) of the shards that a JSON manifest ``{part: [paths]}`` lists, of all parts or of ``"0,2"``."""
    listed = {int(k): v for k, v in json.loads(read_text(spark, manifest_path)).items()}
    wanted = sorted(listed) if parts == "all" else [int(x) for x in parts.split(",")]
    missing = [n for n in wanted if n not in listed]
    if missing:
        raise ValueError(f"parts {missing} are not in the manifest")
    return [(n, path) for n in wanted for path in listed[n]]


def fetched(spark: SparkSession, shards_: list[tuple[int, str]], cache: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Copies of remote shards in a cache folder, by part: (paths, errors).  What is there already isn't fetched again; a
    copy gets its name when it is whole, so a broken one is never read.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths, errors = [], []
    for part, source in shards_:
        target = f"{cache}/part={part}/{source.rpartition('/')[2]}"
        try:
            if not exists(spark, target):
                (a, p), (b, q) = _store(spark, source), _store(spark, f"{target}.part")
                jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, conf)
                b.rename(q, jvm.org.apache.hadoop.fs.Path(target))
            paths.append(target)
        except Exception as e:  # reported with its shard, the others go on
            errors.append((source, str(e).splitlines()[0]))
    return paths, errors


def sqlite(spark: SparkSession, path: str, table_name: str, schema: str, rows_per_task: int = 100_000) -> DataFrame:
    """A table of an SQLite file on a folder that all tasks see, read only, by ranges of row ids."""
    import sqlite3

    names = [f.name for f in T._parse_datatype_string(schema)]
    connect = lambda: sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    with connect() as con:
        lo, hi = con.execute(f'select min(rowid), max(rowid) from "{table_name}"').fetchone()
    if lo is None:
        return spark.createDataFrame([], schema)
    tasks = -(-(hi - lo + 1) // rows_per_task)

    def run(batches):
        import pandas as pd

        with connect() as con:
            for pdf in batches:
                for i in pdf["id"]:
                    first = lo + int(i) * rows_per_task
                    got = con.execute(f"""select {", ".join(f'"{n}"' for n in names)} from "{table_name}" where rowid >= ? and rowid < ?""", (first, first + rows_per_task)).fetchall()
                    yield pd.DataFrame(got, columns=names, dtype=object)

    return spark.range(0, tasks, 1, min(tasks, 10_000)).mapInPandas(run, schema)


def codebook(text: str) -> list[dict]:
    """Fields of a YAML codebook, in order: every mapping that has a ``field`` or ``id``, with its label and values."""
    import yaml

    out = []

    def walk(node):
        if isinstance(node, dict):
            name = node.get("field") or node.get("id")
            if isinstance(name, str):
                out.append({"field": name, "label": node.get("label"), "values": [v.get("value", v) if isinstance(v, dict) else v for v in node.get("values") or []]})
            for v in node.values():
                walk(v)
        elif isinstance(node, list):
            for v in node:
                walk(v)

    walk(yaml.safe_load(text))
    return out


class Prompts:
    """Texts of steps, ``<folder>/<step>.md``, each read once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.read = spark, folder, {}

    def __getitem__(self, step: str) -> str:
        if step not in self.read:
            self.read[step] = read_text(self.spark, f"{self.folder}/{step}.md")
        return self.read[step]


def write_batches(df: DataFrame, path: str, rows_per_file: int = 1000) -> None:
    """Gzip Parquet in small files, as a producer writes them; ``compact`` merges them."""
    df.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).parquet(path)


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = 256 << 20, compression: str = "zstd") -> None:
    """All files of ``source`` as few files of about ``file_bytes`` in ``target``; no shuffle, readers just take more files."""
    fs, p = _store(spark, source)
    files = max(1, -(-fs.getContentSummary(p).getLength() // file_bytes))
    spark.read.parquet(source).coalesce(int(files)).write.mode("overwrite").option("compression", compression).parquet(target)


def copy_without(spark: SparkSession, source: str, target: str, dropped: list[str]) -> None:
    """A table without some columns; these aren't read."""
    spark.read.parquet(source).drop(*dropped).write.mode("overwrite").parquet(target)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header; a result for people is one file."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(spark: SparkSession, path: str, result) -> None:
    """A result of few rows (a table's rows or plain values) as one JSON file."""
    rows = [r.asDict(recursive=True) for r in result.collect()] if isinstance(result, DataFrame) else result
    write_text(spark, path, json.dumps(rows, indent=2, ensure_ascii=False, default=str) + "\n")


def write_uids(df: DataFrame, path: str, key: str = "uid") -> None:
    """One id a line, in order."""
    df.select(F.col(key).cast("string")).orderBy(key).write.mode("overwrite").text(path)


def write_release(df: DataFrame, path: str, constants: dict[str, str]) -> None:
    """zstd Parquet that carries ``constants``, what is true of every row, in its files' schema."""
    first = df.columns[0]
    marked = df.select(F.col(f"`{first}`").alias(first, metadata={"constants": json.dumps(constants)}), *(F.col(f"`{c}`") for c in df.columns[1:]))
    marked.write.mode("overwrite").option("compression", "zstd").parquet(path)


def constants_of(df: DataFrame) -> dict[str, str]:
    """What ``write_release`` stored with a table; nothing for other tables."""
    return json.loads(df.schema[0].metadata.get("constants", "{}"))


def write_vectors(df: DataFrame, path: str, key: str = "uid", vector: str = "embedding", rows_per_file: int = 100_000) -> DataFrame:
    """Compressed NPZ files (``uids``, ``emb`` as float32) as rows ``file, content`` of a table, one for many vectors."""

    def run(batches):
        import io
        import uuid

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), rows_per_file):
                part, out = pdf.iloc[at : at + rows_per_file], io.BytesIO()
                np.savez_compressed(out, uids=part["k"].to_numpy().astype(str), emb=np.stack(part["v"]).astype("<f4"))
                yield pd.DataFrame({"file": [f"{uuid.uuid4().hex}.npz"], "content": [out.getvalue()]})

    df.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v")).filter("v is not null").mapInPandas(run, "file string, content binary").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_vectors(files: DataFrame) -> DataFrame:
    """uid and embedding of NPZ files, given as rows with ``content`` (of ``write_vectors``, or read as binary files)."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"uid": z["uids"].astype(str), "embedding": list(z["emb"].astype("f4"))})

    return files.select("content").mapInPandas(run, "uid string, embedding array<float>")


def decoded(images_: DataFrame, decode: Callable[[bytes], object], answer: str) -> DataFrame:
    """``images_`` with the columns that ``decode`` (bytes -> dict, or an error) gives, and ``decoded``: whether it could."""
    names = [f.name for f in T._parse_datatype_string(answer)]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    got = decode(bytes(content))
                    rows.append([*(got.get(n) for n in names), True])
                except Exception:  # a picture that can't be read is a result
                    rows.append([*(None for _ in names), False])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "decoded"])], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images_.schema)
    return images_.mapInPandas(run, f"{kept}, {answer}, decoded boolean")


def image_payload(images_: DataFrame, resize: Callable[[bytes, int], tuple[bytes, str]], longest: int = 1024) -> DataFrame:
    """``images_`` with ``media_type``, ``base64`` and ``decoded``; ``resize`` gives (bytes, media type) of a picture whose
    longer side is at most ``longest``.  Pictures it can't read, and nulls, keep their row with nulls.
    """
    def run(content: bytes) -> dict:
        small, kind = resize(content, longest)
        return {"media_type": kind, "base64": small}

    return decoded(images_, run, "media_type string, base64 binary").withColumn("base64", F.base64("base64"))


def write_payload(spark: SparkSession, path: str, shown: DataFrame, variable: str, **constants) -> None:
    """``path``.json and ``path``.js (an assignment to ``window.variable``) of a blinded sample in its order, with its size
    and the given constants.  Every column of ``shown`` but ``position`` is seen by the people who code: strata stay out.
    """
    rows = [{k: v for k, v in r.asDict().items() if k != "position"} for r in shown.orderBy("position").toLocalIterator()]  # a sample for people
    body = json.dumps({**constants, "n": len(rows), "items": rows}, ensure_ascii=False, indent=1, default=str)
    write_text(spark, f"{path}.json", body)
    write_text(spark, f"{path}.js", f"window.{variable} = {body};\n")


def manifest(spark: SparkSession, path: str, note: str = "") -> list[dict]:
    """One entry for each file below ``path``: bytes, sha256 of the bytes, note, and for Parquet rows and columns.

    Files are hashed where they are read, one a row; only the entries reach the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!._]*").load(path)
    rows = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path").collect()
    tables_ = [r["path"] for r in rows if r["path"].endswith(".parquet")]
    counted, columns = {}, None
    if tables_:
        df = spark.read.parquet(*tables_)
        columns = [{"name": f.name, "dtype": f.dataType.simpleString()} for f in df.schema]
        counted = {r["f"].rpartition("/")[2]: r["count"] for r in df.groupBy(F.col("_metadata.file_path").alias("f")).count().collect()}
    out = []
    for r in rows:
        entry = {"file": r["path"].rpartition("/")[2], "bytes": r["bytes"], "sha256": r["sha256"], "note": note}
        if r["path"].endswith(".parquet"):
            entry |= {"rows": counted.get(entry["file"], 0), "columns": columns}
        out.append(entry)
    return out


def write_manifest(spark: SparkSession, path: str, entries: list[dict], package: str) -> list[tuple[str, bool]]:
    """Write the manifest; (file, changed) of each entry against the one that was there, whose notes are kept."""
    old = read_manifest(spark, path) if exists(spark, path) else {"files": []}
    before = {e["file"]: e for e in old["files"]}
    files = [{**e, "note": before.get(e["file"], {}).get("note") or e["note"]} for e in entries]
    write_json(spark, path, {"package": package, "files": files})
    return [(e["file"], before.get(e["file"], e)["sha256"] != e["sha256"]) for e in files]


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def verify_files(spark: SparkSession, path: str, listed: dict) -> list[tuple[str, str]]:
    """(file, fault) of files whose bytes differ from a manifest, that are missing or that it doesn't list."""
    have, want = {e["file"]: e["sha256"] for e in manifest(spark, path)}, {e["file"]: e["sha256"] for e in listed["files"]}
    faults = [(f, "missing") for f in want.keys() - have.keys()] + [(f, "not listed") for f in have.keys() - want.keys()]
    return sorted(faults + [(f, "checksum differs") for f in have.keys() & want.keys() if have[f] != want[f]])


def markdown(rows: list, columns: list[str]) -> str:
    """A table of few collected rows."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows])
