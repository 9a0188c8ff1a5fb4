"""Token-ID output: fixed-width bit packing with block offsets, in files of their own.

A file holds the ids of a run of documents: a header (magic ``CLBP``, version, bits per id, ids per block, number of ids,
blocks and documents, all little-endian), a table of block offsets in bytes from the start of the payload, the documents'
ids and ends (signed 64-bit; an end counts ids from the file's first), then the payload.  Every block holds ``block`` ids
(the last one fewer), each in ``bits`` bits, lowest bit first, padded to whole 64-bit words.  ``block`` is a multiple of
64, so 64 ids fill exactly ``bits`` words and both directions are 64 numpy operations over whole blocks.  Any id range
is read by seeking to the blocks that it touches, and nothing else of the payload.

Tasks write files under names of their own in the shared folder and return them as rows of a manifest, which Spark
commits: files of lost or repeated attempts aren't in it and are never read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .encoder import encoder, public_path

MAGIC, VERSION, HEADER = b"CLBP", 2, struct.Struct("<4sHHIQII")
MANIFEST = "pid int, seq int, base long, n_ids long, n_docs long, file string"
OUT_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def min_bits(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary of this size."""
    return max(1, int(vocabulary - 1).bit_length())


def _pack_words(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids: (groups, 64) uint64 -> (groups, bits) uint64."""
    out = np.zeros((len(ids), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= ids[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= ids[:, j] >> np.uint64(64 - shift)
    return out


def _unpack_words(words: np.ndarray, bits: int) -> np.ndarray:
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out


def pack(ids: np.ndarray, bits: int, block: int = 4096, doc_ids=(), counts=()) -> bytes:
    """One file of ``ids``; an id that needs more than ``bits`` bits is a ValueError.  No ids: a file of no blocks.

    ``counts`` are the numbers of ids of the documents ``doc_ids``, in order.
    """
    if block % 64 or not 0 < bits <= 32:
        raise ValueError("block must be a multiple of 64 and bits between 1 and 32")
    n = len(ids)
    if n and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = ids
    payload = _pack_words(padded.reshape(-1, 64), bits).astype("<u8").tobytes()
    blocks = -(-n // block)
    offsets = np.arange(blocks, dtype="<u8") * (block // 64 * bits * 8)
    index = np.array(doc_ids, "<i8").tobytes() + np.cumsum(np.array(counts, "<i8")).astype("<i8").tobytes()
    return HEADER.pack(MAGIC, VERSION, bits, block, n, blocks, len(doc_ids)) + offsets.tobytes() + index + payload


class Reader:
    """Random access to one packed file, given as a seekable binary file; only what is asked for is read."""

    def __init__(self, file):
        self.file = file
        magic, version, self.bits, self.block, self.n_ids, self.blocks, self.n_docs = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a bit-packed file of this version")
        self.head = HEADER.size + 8 * self.blocks + 16 * self.n_docs

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, ends): document k has the ids from the end before it, or 0, to its own."""
        index = np.frombuffer(self._at(HEADER.size + 8 * self.blocks, 16 * self.n_docs), "<i8")
        return index[: self.n_docs], index[self.n_docs :]

    def _offset(self, k: int) -> int:
        return int.from_bytes(self._at(HEADER.size + 8 * k, 8), "little")

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop`` as uint32."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        start = max(0, start)
        if start >= stop:
            return np.empty(0, np.uint32)
        lo, hi = start // self.block, (stop - 1) // self.block
        first = self._offset(lo)
        last = self._offset(hi + 1) if hi + 1 < self.blocks else first + (-(-(self.n_ids - lo * self.block) // 64)) * self.bits * 8
        words = np.frombuffer(self._at(self.head + first, last - first), "<u8").reshape(-1, self.bits)
        return _unpack_words(words, self.bits).ravel()[start - lo * self.block : stop - lo * self.block].astype(np.uint32)


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    return Reader(io.BytesIO(data)).ids(start, stop)


def store(uri: str):
    """(file system, path) of a folder that Python workers reach: local and mounted folders, HDFS, S3, GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, *, bits: int | None = None, block: int = 4096, file_ids: int = 1 << 21, partition_bytes: int = 16 << 20) -> DataFrame:
    """Encode ``doc_id, text`` and write files in ascending doc_id order below ``path``; returns their manifest.

    Null text counts as empty, so every row has at least the end id.  Columns other than the two are ignored; repeated
    doc_ids stay separate rows, in the order of their texts, and a null doc_id comes first.  An empty table writes no
    file.  A range partition holds about ``partition_bytes`` of text, and rows of one id are split by their texts' hash
    and place, so a task's input doesn't grow with the table.
    """
    spark = docs.sparkSession
    keyed = docs.select(shared.whole_id(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = keyed.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // partition_bytes))

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        width = bits or min_bits(enc.vocabulary)
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        pid, seq, base = TaskContext.get().partitionId(), 0, 0
        ids, held, doc_ids, counts = [], 0, [], []
        place, folder = store(path)

        def flush():
            nonlocal seq, base, ids, held, doc_ids, counts
            name = f"{pid:08d}-{seq:06d}-{uuid.uuid4().hex}.clbp"
            place.create_dir(folder, recursive=True)
            with place.open_output_stream(f"{folder}/{name}") as out:
                out.write(pack(np.frombuffer(b"".join(ids), "<u4"), width, block, doc_ids, counts))
            row = (pid, seq, base, held, len(doc_ids), f"{folder}/{name}")
            seq, base, ids, held, doc_ids, counts = seq + 1, base + held, [], 0, [], []
            return pd.DataFrame([row], columns=["pid", "seq", "base", "n_ids", "n_docs", "file"])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                x = enc.encode(text or "") + tail
                ids.append(x)
                doc_ids.append(doc_id)
                counts.append(len(x) // 4)
                held += len(x) // 4
                if held >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    hashed = keyed.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "hash", "text", "place"]
    (hashed.repartitionByRange(parts, "doc_id", "hash", "place").sortWithinPartitions(*order).select("doc_id", "text").mapInPandas(run, MANIFEST).write.parquet(f"{path}/manifest"))
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_documents(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document from written files: place in the whole output, number of ids and their crc32.

    A partition's first id follows from the totals of the partitions before it: one number for each written partition
    reaches the driver, none for a document.
    """
    spark = manifest.sparkSession
    offset, at = {}, 0
    for row in manifest.groupBy("pid").agg(F.sum("n_ids").alias("n")).orderBy("pid").collect():
        offset[row["pid"]] = at
        at += row["n"]
    offsets = spark.sparkContext.broadcast(offset)

    def run(batches):
        place, _ = store(path)
        for pdf in batches:
            for pid, base, file in zip(pdf["pid"], pdf["base"], pdf["file"]):
                with place.open_input_file(file) as opened:
                    reader = Reader(opened)
                    doc_ids, ends = reader.documents()
                    ids = reader.ids().astype("<u4")
                starts = np.concatenate([np.zeros(1, "i8"), ends[:-1]])
                yield pd.DataFrame({"doc_id": doc_ids, "start": starts + (offsets.value[pid] + base), "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]})

    files = min(max(1, manifest.count()), 10_000)
    found = manifest.select("pid", "base", "file").repartition(files).mapInPandas(run, OUT_SCHEMA)
    return shared.null_again(found)


def op9_bit_packed_ids(spark, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-ids")
    manifest = write_ids(shared.read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_path("byte_bpe_50k.json"), 0)
    return read_documents(manifest, path)
