"""Secret scans over a ledger of content-addressed blobs, by SQL functions only.

Every version of every path is a blob named by its sha256.  The ledger holds what each rule version found in each blob;
a scan reads only pairs of blob and rule version that it lacks, and findings are joined back to all paths and versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .spans import digest, find_spans, let, tagged

RULE_VERSION = "2"
# Kinds in order, the base ones first.
KINDS = ("assign", "access", "hex", "pem", "forge", "chat", "jwt")
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
EXTRA = {
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "forge": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
FINDING = "array<struct<start:bigint,rank:int,end:bigint,kind:string,text:string>>"


def base_spans(text: Column) -> Column:
    lower = F.lower(text)
    names = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    assign = F.filter(find_spans(text, ASSIGN + VALUE, names), lambda s: F.length(F.regexp_replace(s["text"], "^" + ASSIGN, "")) >= 8)
    # A maximal run is a match from its first character, so a run's least length can be part of the pattern.
    access = find_spans(text, "AKIA[A-Z0-9]{12,}", text.contains("AKIA"))
    hexes = find_spans(text, "(?<![0-9a-f])[0-9a-f]{32,}")
    return F.concat(tagged(assign, "assign", 0), tagged(access, "access", 1), tagged(hexes, "hex", 2))


def extra_spans(text: Column) -> Column:
    marks = {"pem": "-----BEGIN ", "forge": "gh", "chat": "xox", "jwt": "eyJ"}
    return F.concat(*(tagged(find_spans(text, pattern, text.contains(marks[kind])), kind, KINDS.index(kind)) for kind, pattern in EXTRA.items()))


def findings(text: Column) -> Column:
    """All spans in order of start, then kind."""
    return F.sort_array(F.concat(base_spans(text), extra_spans(text))).cast(FINDING)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """``<root>/rules=<version>/scan-<n>/``: one folder for each scan, blob and its findings in rows.

    A scan counts once Spark has marked its folder, so one that died half-way is scanned again.
    """

    def __init__(self, spark, root: str, version: str = RULE_VERSION):
        self.spark, self.root = spark, f"{root.rstrip('/')}/rules={version}"
        self.schema = f"blob string, findings {FINDING}"

    def known(self) -> DataFrame:
        scans = shared.committed(self.spark, self.root)
        return self.spark.read.schema(self.schema).parquet(*scans) if scans else self.spark.createDataFrame([], self.schema)

    def scan(self, versions: DataFrame) -> None:
        """Scan the blobs of ``versions`` (column ``text``) that the ledger lacks under this rule version.

        Copies meet before the shuffle, so a text with very many copies is one row of each task.
        """
        blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        if shared.committed(self.spark, self.root):
            unseen = unseen.join(self.known().select("blob"), "blob", "left_anti")
        path = shared.new_path(self.spark, "scan").rpartition("-")[2]
        unseen.select("blob", findings(F.col("text")).alias("findings")).write.parquet(f"{self.root}/scan-{path}")


def found_in(versions: DataFrame, ledger: Ledger) -> DataFrame:
    """``versions`` with a column ``findings`` (replaced if there) from the ledger as it is.

    Only blobs with findings are joined, under names that ``versions`` doesn't use.
    """
    blob, found = shared.fresh("blob", versions.columns), shared.fresh("found", versions.columns)
    hits = ledger.known().filter(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(found))
    keyed = versions.drop("findings").withColumn(blob, blob_id(F.col("text").cast("string")))
    return keyed.join(hits, blob, "left").withColumn("findings", F.coalesce(found, F.array().cast(FINDING))).drop(blob, found)


def scan_secrets(versions: DataFrame, ledger: Ledger) -> DataFrame:
    """``versions`` with a column ``findings`` (replaced if there), after scanning what the ledger lacks.

    Null text is an empty blob; without findings the array is empty.  Rows with equal texts get equal findings, whatever
    their ids, and an empty table gives an empty result.
    """
    ledger.scan(versions.select(F.col("text").cast("string").alias("text")))
    return found_in(versions, ledger)


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each group of overlapping spans replaced by ``[SECRET]``."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("[SECRET]")).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, done)).otherwise(text)


def redact_documents(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """``docs`` in their own columns, secrets replaced; ``n_chars``, if there, follows the text.

    Null texts stay null; repeated rows and ids are redacted alike; an empty table stays empty.
    """
    names = docs.columns
    mine = shared.fresh("own_findings", names)
    out = scan_secrets(docs.select(*(F.col(f"`{n}`").alias(mine if n.lower() == "findings" else n) for n in names)), ledger)
    out = out.withColumn("text", redact(F.col("text"), F.col("findings")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{mine}`").alias(n) if n.lower() == "findings" else F.col(f"`{n}`") for n in names))


def summary(found: DataFrame) -> DataFrame:
    base = F.filter("findings", lambda s: s["rank"] < 3)
    n = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("findings")).alias("spans"))


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    """All documents, in two arrivals: the second scan is given every document and finds what the first has seen."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, shared.new_path(spark, "ledger"))
    ledger.scan(docs.filter(F.isnotnull("doc_id") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) < 1 << 31)).select("text"))
    return summary(scan_secrets(docs, ledger))
