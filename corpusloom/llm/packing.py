"""Packing documents into training sequences: first-fit decreasing on a tournament tree, in randomised groups.

Every document becomes its ids and an end id.  Whole sequences are cut off a long document; what is left of each
document is placed by first-fit decreasing within its group.  Groups are drawn by a hash of the doc_id, so they have like
sizes and mixtures, whatever the source; a group's bins live in a tournament tree whose nodes hold the largest free
room below them, so the leftmost bin with room is found in log time.  Only piece sizes travel to the groups, never ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .encoder import encoder, public_path

PIECES = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BinTree:
    """Bins of equal capacity, opened as needed; ``place`` uses the leftmost bin with room."""

    def __init__(self, capacity: int, most: int):
        self.size = 1 << max(0, (max(1, most) - 1).bit_length())
        self.capacity = capacity
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """-> (bin, offset in the bin)."""
        if not 0 < length <= self.room[1]:
            raise ValueError("no bin has room for this piece")
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        found, offset = node - self.size, self.capacity - room[node]
        room[node] -= length
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found, offset


def first_fit_decreasing(lengths, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; equal lengths are placed in the order given."""
    tree = BinTree(capacity, len(lengths))
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins[i], offsets[i] = tree.place(lengths[i])
    return bins, offsets


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, with_ids: bool = False, memo_words: int = 600_000) -> DataFrame:
    """Pieces of at most ``capacity`` ids.  Null text counts as empty: its one id is the end id.

    Repeated doc_ids stay separate documents: ``copy`` tells them apart (it is unique for each row of the input).
    """

    def run(batches):
        enc, tail = encoder(tokenizer, memo_words), struct.pack("<I", end_id)
        for pdf in batches:
            rows = []
            for doc_id, copy, text in zip(pdf["doc_id"], pdf["copy"], pdf["text"]):
                ids = enc.encode(text or "") + tail
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, copy, at, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
            yield pd.DataFrame(rows, columns=["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    keyed = docs.select(shared.whole_id(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("copy", F.monotonically_increasing_id())
    return keyed.mapInPandas(run, PIECES)


def place(pieces: DataFrame, capacity: int = 2048, group_rows: int = 1024, seed: int = 0) -> DataFrame:
    """Sequence and offset of each piece: ``sequence_id`` is unique over all groups, offsets in a sequence are gapless.

    The pieces' number fixes the number of groups, so a group holds about ``group_rows`` pieces at every input size.
    """
    groups = max(1, round(pieces.count() / group_rows))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "copy", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), capacity)
        return pdf.assign(sequence_id=np.array(bins, "i8") + (int(key[0]) << 32), offset=offsets)[["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    meta = pieces.drop("ids")
    drawn = meta.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy", "start"), F.lit(groups)))
    return shared.null_again(drawn.groupBy("group").applyInPandas(run, PLACED))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_rows: int = 1024, seed: int = 0, memo_words: int = 600_000) -> DataFrame:
    """Placed pieces of all documents, without ids.  An empty table gives an empty result.

    ``memo_words`` bounds the memory that a worker holds for words seen before; ids don't depend on it.
    """
    return place(shared.materialise(cut(docs, tokenizer, end_id, capacity, memo_words=memo_words), "pieces"), capacity, group_rows, seed)


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_rows: int = 1024, seed: int = 0, pad_id: int = 0) -> DataFrame:
    """The training sequences themselves: ``sequence_id, ids array<int>, n_tokens, n_padding``.

    A sequence is padded to ``capacity`` unless its length is a power of two already.
    """
    pieces = shared.materialise(cut(docs, tokenizer, end_id, capacity, with_ids=True), "pieces")
    placed = place(pieces, capacity, group_rows, seed).select("copy", "start", "sequence_id", "offset")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.frombuffer(b"".join(pdf.sort_values("offset")["ids"]), "<u4").astype("i4")
        n = len(flat)
        pad = 0 if n & (n - 1) == 0 else capacity - n
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [np.concatenate([flat, np.full(pad, pad_id, "i4")])], "n_tokens": [n], "n_padding": [pad]})

    return pieces.select("copy", "start", "ids").join(placed, ["copy", "start"]).groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<int>, n_tokens long, n_padding long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_path("word_bpe_49k.json"), 1).drop("copy")
