"""Token counts as delta-maintained rollups.

A batch of changes carries a sign: an insert adds a document's counts, a delete subtracts them, a revision does both.
Each batch is reduced to additive deltas by (source, lang, tokenizer) and committed under its batch id; committing an id
again changes nothing.  Totals are the sum of committed deltas.  Compaction folds all committed batches into one table
that also remembers their ids; batches that a fold holds are not read again and can be deleted.
"""

from __future__ import annotations

import hashlib

import pandas as pd  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .encoder import encoder, public_path

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], carry: list[str], memo: int = 50_000) -> DataFrame:
    """One row per document and tokenizer version: ``carry`` columns, tokenizer, n_tokens, n_chars.  Null text has no tokens.

    Repeated rows count each.  Counts of up to ``memo`` texts, by their 128-bit hash, spare copies the encoder.
    """
    kept = [docs.schema[c] for c in carry]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "counts array<long>", "n_chars long"])
    names = list(tokenizers)

    def run(batches):
        import xxhash

        encoders, seen = [encoder(tokenizers[n]) for n in names], {}
        for pdf in batches:
            counts, chars = [], []
            for text in pdf.pop("_text"):
                text = text or ""
                key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                got = seen.get(key)
                if got is None:
                    got = [len(enc.encode(text)) // 4 for enc in encoders]
                    if len(seen) < memo:
                        seen[key] = got
                counts.append(got)
                chars.append(len(text))
            yield pdf.assign(counts=counts, n_chars=chars)

    each = docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInPandas(run, schema)
    rows = F.array(*(F.struct(F.lit(n).alias("tokenizer"), F.get("counts", F.lit(i)).alias("n_tokens")) for i, n in enumerate(names)))
    return each.select(*(f"`{c}`" for c in carry), F.inline(rows), "n_chars")


class Rollup:
    """Totals in a folder of the shared store.

    ``<root>/batches/<digest of the id>/`` holds the deltas of one batch, ``<root>/folds/<n>/`` those of all batches up
    to a compaction, a row for each batch among them.  A folder counts once Spark has marked its job as finished.
    """

    FOLD = f"batch string, {DELTA}"

    def __init__(self, spark, root: str, tokenizers: dict[str, str]):
        self.spark, self.root, self.tokenizers = spark, root.rstrip("/"), tokenizers

    @staticmethod
    def _name(batch_id: str) -> str:
        """Any string may be an id, so folders are named by its digest."""
        return hashlib.sha256(str(batch_id).encode("utf-8", "surrogatepass")).hexdigest()

    def _fold(self) -> str | None:
        folds = shared.committed(self.spark, f"{self.root}/folds")
        return folds[-1] if folds else None

    def _folded(self) -> DataFrame:
        fold = self._fold()
        return self.spark.read.schema(self.FOLD).parquet(fold) if fold else self.spark.createDataFrame([], self.FOLD)

    def _open(self) -> list[str]:
        """Folders of committed batches that the last fold doesn't hold."""
        held = {r["batch"] for r in self._folded().filter("batch is not null").select("batch").collect()}
        return [f for f in shared.committed(self.spark, f"{self.root}/batches") if f.rpartition("/")[2] not in held]

    def committed(self, batch_id: str) -> bool:
        """A batch counts once its marker is there or a fold holds it, so a job that died half-way is not read."""
        name = self._name(batch_id)
        return shared.exists(self.spark, f"{self.root}/batches/{name}/_SUCCESS") or not self._folded().filter(F.col("batch") == name).isEmpty()

    def deltas(self, changes: DataFrame) -> DataFrame:
        """``changes``: sign (+1 or -1; null counts as +1), source, lang, and text or the counts of ``count_tokens``.

        A revision is a -1 row and a +1 row.  Counts that were recorded when a document came are subtracted without
        encoding it again.
        """
        signed = changes.withColumn("sign", F.coalesce(F.col("sign").cast("long"), F.lit(1).cast("long")))
        counted = signed if "n_tokens" in changes.columns else count_tokens(signed, self.tokenizers, ["sign", "source", "lang"])
        return counted.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """False, without reading ``changes``, if the batch is committed already."""
        if self.committed(batch_id):
            return False
        self.deltas(changes).write.mode("overwrite").parquet(f"{self.root}/batches/{self._name(batch_id)}")
        return True

    def _all(self) -> DataFrame:
        fold, batches = self._folded().filter("tokenizer is not null").drop("batch"), self._open()
        return fold.unionByName(self.spark.read.schema(DELTA).parquet(*batches)) if batches else fold

    def _sums(self) -> DataFrame:
        return self._all().groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).filter("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys whose documents are all gone drop out.  No batch: an empty result."""
        return self._sums()

    def compact(self) -> None:
        """Fold all committed batches; totals and the answers of ``commit`` stay the same."""
        names = [f.rpartition("/")[2] for f in self._open()]
        last = self._fold()
        if not names:
            return
        batches = self._folded().filter("batch is not null").unionByName(self.spark.createDataFrame([(n,) for n in names], "batch string"), allowMissingColumns=True)
        at = int(last.rpartition("/")[2]) + 1 if last else 0
        batches.unionByName(self._sums(), allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.root}/folds/{at:012d}")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents arrive without a language, then a revision gives each its own; every batch is committed twice.

    Texts are encoded once: the revision subtracts and adds the counts recorded on arrival.
    """
    docs = shared.read(spark, sf_dir, "documents").select("source", "lang", "text")
    names = {"byte_bpe_50k": public_path("byte_bpe_50k.json"), "word_bpe_49k": public_path("word_bpe_49k.json")}
    counted = shared.materialise(count_tokens(docs, names, ["source", "lang"]), "document-counts")
    rollup = Rollup(spark, shared.new_path(spark, "token-counts"), names)
    signed = lambda n, lang: counted.select(F.lit(n).alias("sign"), "source", lang.alias("lang"), "tokenizer", "n_tokens", "n_chars")
    unknown = F.lit(None).cast("string")
    for _ in range(2):
        rollup.commit("arrivals", signed(1, unknown))
        rollup.commit("languages", signed(-1, unknown).unionByName(signed(1, F.col("lang"))))
    rollup.compact()
    return rollup.totals()
