"""Near-duplicate groups by ProbMinHash, banding and exact verification.

1. Each text becomes weighted shingles of five words (weight: how often it holds the shingle) and a ProbMinHash
   signature: every shingle is a Poisson process of its weight, each arrival claims a random register if it is the
   earliest there, and a process ends once it is later than every register.  Registers agree with the probability
   Jaccard similarity of the weighted sets.  A text that repeats shingles has a second signature, of weights of one,
   whose registers agree with the plain Jaccard similarity; for other texts the two are equal.
2. Equal texts are one node from here on.
3. Bands of registers of both signatures give buckets.  Every node is compared with its buckets' hubs (a bucket's least
   node) by signature; nodes that look like at least ``LIKELY`` similar by either are linked.  Buckets whose nodes are
   then still in several components are compared in full, but only across components.  Components of all these links are
   canopies.
4. Similarities are computed exactly from the shingles: each node with the hub that it looks most like, then what is
   left of a canopy with one of its nodes, then the rest in full, again only across components.  Links of at least the
   threshold are unions, and components of those are the groups.

Hubs are copied to every part of their spokes, so stars write a row for each spoke and task at most.  Comparisons in
full are split into pairs of blocks; a large component's blocks meet those of others, never each other.  So a group of m
near copies of one text writes rows in proportion to m.  Only where m different texts resemble each other by
``LIKELY`` or more and yet not by the threshold does work grow as their square, spread over blocks.

A link counts if probability Jaccard or plain Jaccard of the shingle sets reaches the threshold; where no shingle repeats
the two are equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components

WORDS, THRESHOLD = 5, 0.8
REGISTERS, BAND = 224, 7
LIKELY = 0.7
SIGNED = "doc_id long, key binary, sig binary, plain binary"

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs give equal outputs, others look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Hashes of words; it starts anew once it holds 200,000, some 40 MB."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, words: int = WORDS, memo: WordHash | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts.  A text of fewer words, but not none, is one shingle."""
    memo = WordHash() if memo is None else memo
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        out = mix(out * _STEP + h[i : len(h) - n + 1 + i])
    return np.unique(out, return_counts=True)


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Signatures (sets, registers) of one byte each; sets must not be empty."""
    sizes = np.array([len(h) for h, _ in sets], np.int64)
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    earliest = np.full(len(sets) * registers, np.inf)
    winner = np.zeros(len(sets) * registers, np.uint8)
    time, state = np.zeros(len(element)), mix(element + _STEP)
    while len(element):
        state = mix(state + _STEP)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        at = owner * registers + (mix(state ^ _MIX1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        winner[at[won]] = (element[won] & np.uint64(255)).astype(np.uint8)
        left, place = np.unique(owner, return_inverse=True)
        on = time < earliest.reshape(-1, registers)[left].max(1)[place]
        element, weight, owner, time, state = element[on], weight[on], owner[on], time[on], state[on]
    return winner.reshape(-1, registers)


def estimate(matches: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Similarity from agreeing registers; one-byte registers agree by chance once in 256."""
    return (matches / registers - 1 / 256) / (1 - 1 / 256)


def probability_jaccard(ha, wa, hb, wb) -> float:
    """Exact: sum over common elements of 1 / sum over all elements of the larger ratio of weights."""
    both = np.union1d(ha, hb)
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, ha)], y[np.searchsorted(both, hb)] = wa, wb
    pairs, n = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    k = (pairs[:, 0] > 0) & (pairs[:, 1] > 0)
    if not k.any():
        return 0.0
    ratio = np.maximum(pairs[None, :, 0] / pairs[k][:, None, 0], pairs[None, :, 1] / pairs[k][:, None, 1])
    return float((n[k] / (ratio * n).sum(1)).sum())


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def _sides(n: int, classes, sides) -> tuple[Union, np.ndarray, np.ndarray]:
    """Unions of what is in one class already, and the rows to compare: one side with the other, or all with later ones."""
    u = Union(n)
    if classes is not None:
        first: dict = {}
        for i, c in enumerate(classes.tolist()):
            u.join(first.setdefault(c, i), i)
    every = np.arange(n)
    return (u, every, every) if sides is None else (u, every[sides == 0], every[sides == 1])


def likely_links(sigs: np.ndarray, plains: np.ndarray | None = None, least: float = LIKELY, classes: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of rows whose signatures, or whose plain ones, look similar, as many as unite what belongs together.

    ``classes``: rows that are united already.  ``sides``: compare rows of side 0 with rows of side 1 only.
    """
    u, left, right = _sides(len(sigs), classes, sides)
    out = []
    for i in left.tolist():
        others = right if sides is not None else right[i + 1 :]
        if classes is not None:
            others = others[classes[others] != classes[i]]
        if not len(others):
            continue
        same = (sigs[others] == sigs[i]).sum(1)
        if plains is not None:
            same = np.maximum(same, (plains[others] == plains[i]).sum(1))
        for j in others[estimate(same, sigs.shape[1]) >= least].tolist():
            if u.find(i) != u.find(j):
                u.join(i, j)
                out.append((i, j))
    return out


def verified_links(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD, classes: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets of exact similarity of ``threshold`` or more, as many as unite what belongs together.

    ``classes`` and ``sides`` as in ``likely_links``.  The common part of two distributions, the sum of the lesser shares,
    bounds probability Jaccard from above, so the exact value is computed only where that sum reaches the threshold and
    the sets aren't united yet.
    """
    n = len(sets)
    u, left, right = _sides(n, classes, sides)
    sizes = np.array([len(h) for h, _ in sets], np.int64)
    ends = np.cumsum(sizes)
    values, code = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    shares = np.concatenate([w / w.sum() for _, w in sets])
    posts = np.isin(np.repeat(np.arange(n), sizes), right)
    order = np.flatnonzero(posts)[np.argsort(code[posts], kind="stable")]
    posting, posted = np.repeat(np.arange(n), sizes)[order], shares[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(code[posts], minlength=len(values)))])
    uneven = np.array([bool((w > 1).any()) for _, w in sets])
    out = []
    for i in left.tolist():
        wanted = np.zeros(n, bool)
        wanted[right if sides is not None else right[i + 1 :]] = True
        if classes is not None:
            wanted &= classes != classes[i]
        if not wanted.any():
            continue
        span = slice(ends[i] - sizes[i], ends[i])
        own = code[span]
        lo, k = first[own], first[own + 1] - first[own]
        at = np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())
        hits = posting[at]
        common = np.bincount(hits, minlength=n)
        plain = common / np.maximum(sizes[i] + sizes - common, 1)
        good = wanted & (plain >= threshold)
        if uneven[i] or (wanted & uneven).any():
            least = np.minimum(np.repeat(shares[span], k), posted[at])
            open_ = wanted & ~good & (np.bincount(hits, least, minlength=n) >= threshold - 1e-9) & (uneven[i] | uneven)
        else:
            open_ = np.zeros(n, bool)
        for j in np.flatnonzero(good | open_).tolist():
            if u.find(i) != u.find(j) and (good[j] or probability_jaccard(*sets[i], *sets[j]) >= threshold):
                u.join(i, j)
                out.append((i, j))
    return out


def sign(docs: DataFrame, words: int = WORDS, registers: int = REGISTERS) -> DataFrame:
    """doc_id, key (equal for equal word sequences), signature; both null for a text without words.

    ``plain`` is the signature of the distinct shingles where some repeat, else null: it would equal ``sig``.
    """

    def run(batches):
        import xxhash

        memo = shared.held("near-duplicates", "words", WordHash)
        for pdf in batches:
            at, texts = 0, pdf["text"].tolist()
            while at < len(texts):
                ids, keys, sets, size = [], [], [], 0
                while at < len(texts) and size < 500_000:
                    s = shingles(texts[at], words, memo)
                    ids.append(at)
                    keys.append(xxhash.xxh3_128_digest(" ".join(texts[at].lower().split())) if len(s[0]) else None)
                    sets.append(s)
                    size += len(s[0]) + 200
                    at += 1
                full = [s for s in sets if len(s[0])]
                sigs = iter(prob_minhash(full, registers)) if full else iter(())
                uneven = [(h, np.ones_like(w)) for h, w in full if (w > 1).any()]
                plains = iter(prob_minhash(uneven, registers)) if uneven else iter(())
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[ids].to_numpy(), "key": keys,
                    "sig": [next(sigs).tobytes() if len(h) else None for h, _ in sets],
                    "plain": [next(plains).tobytes() if (w > 1).any() else None for _, w in sets],
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").mapInPandas(run, SIGNED)


def _grouped(batches, keys: list[str]):
    """Frames of whole groups from a partition sorted by ``keys``: what may go on in the next batch waits for it."""
    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or (held and (held[-1][keys].to_numpy()[-1] != k[0]).any()):
            done = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
            if len(done):
                yield done
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _runs(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    k = pdf[keys].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1])
    return starts, np.append(starts[1:], len(pdf))


def _salted(rows: DataFrame, few: DataFrame, on: list[str], how: str, salts: int = 16) -> DataFrame:
    """``rows`` (with ``node``) joined with ``few`` on ``on``: rows of one key go to ``salts`` tasks, ``few`` to each."""
    wide = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "node"), F.lit(salts)).cast("int")).join(wide, [*on, "salt"], how).drop("salt")


def _stars(pairs: DataFrame, most: int) -> DataFrame:
    """``pairs``: ``hub``, ``node``.  -> ``hub``, ``part``, ``node``, ``side``: spokes (1) in parts of about ``most``, and
    the hub (0) in each part.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    spokes = _salted(pairs, sizes.filter("parts > 1"), ["hub"], "left").select("hub", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", F.lit(1).alias("side"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(0).alias("side"))
    return spokes.unionByName(hubs)


def _across(rows: DataFrame, key: str, block: int) -> DataFrame:
    """``rows``: ``key``, ``node``, ``class``.  -> those with ``i``, ``j``, ``own``: a row for each pair of blocks in which
    a node of block ``own`` meets nodes of other classes.

    A class of more than ``block`` nodes of a key has blocks of its own, which need not meet each other; smaller ones
    share blocks.
    """
    sizes = rows.groupBy(key, "class").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    before = Window.partitionBy(key).orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    large = large.select(key, "class", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first"))
    ceiling = F.ceil(F.coalesce(F.sum(F.when(F.col("n") <= block, F.col("n"))), F.lit(0)) / block).cast("long")
    of_large = F.coalesce(F.sum(F.when(F.col("n") > block, F.ceil(F.col("n") / block))), F.lit(0)).cast("long")
    keys = sizes.groupBy(key).agg(ceiling.alias("mixed"), (ceiling + of_large).alias("all"))
    placed = _salted(_salted(rows, keys.filter(F.col("all") > 1), [key], "left"), large, [key, "class"], "left")
    placed = placed.withColumn("mixed", F.coalesce("mixed", F.lit(1).cast("long"))).withColumn("all", F.coalesce("all", F.lit(1).cast("long")))
    mine = F.col("mixed") + F.col("first")
    own = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("node"), "mixed")).otherwise(mine + F.pmod(F.xxhash64("node"), "blocks"))
    meets = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda o: F.col("blocks").isNull() | (o < mine) | (o >= mine + F.col("blocks")))
    out = placed.select(key, "node", "class", own.alias("own"), meets.alias("meets")).select(key, "node", "class", "own", F.explode("meets").alias("o"))
    return out.select(key, "node", "class", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))


def _compare(rows: DataFrame, keys: list[str], links) -> DataFrame:
    """``a``, ``b`` of what ``links(group)`` (pairs of positions in a frame of one group) finds in groups of ``keys``."""

    def run(batches):
        for pdf in _grouped(batches, keys):
            a, b = [], []
            for s, e in zip(*_runs(pdf, keys)):
                part = pdf.iloc[s:e]
                nodes = part["node"].to_numpy()
                for i, j in links(part):
                    a.append(nodes[i])
                    b.append(nodes[j])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInPandas(run, "a long, b long")


def _options(part: pd.DataFrame) -> dict:
    """Classes and sides of a group for the comparing functions; a block meets itself without sides."""
    if "side" in part:
        return {"sides": part["side"].to_numpy()}
    i, j = part["i"].iloc[0], part["j"].iloc[0]
    return {"classes": part["class"].to_numpy(), "sides": None if i == j else (part["own"] == j).to_numpy().astype(np.int8)}


def _signatures(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures, and plain ones (the same where no shingle repeats) if any differ."""
    sigs = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1)
    uneven = part["plain"].notna().to_numpy()
    if not uneven.any():
        return sigs, None
    plains = sigs.copy()
    plains[uneven] = np.frombuffer(b"".join(part["plain"][uneven]), np.uint8).reshape(-1, sigs.shape[1])
    return sigs, plains


def _by_signature(least: float):
    return lambda part: likely_links(*_signatures(part), least, **_options(part))


def _likely_stars(rows: DataFrame, least: float) -> DataFrame:
    """``a`` (a hub) and ``b`` (a spoke of it) whose signatures look similar."""

    def run(batches):
        for pdf in _grouped(batches, ["hub", "part"]):
            starts, ends = _runs(pdf, ["hub", "part"])
            nodes, (sigs, plains) = pdf["node"].to_numpy(), _signatures(pdf)
            spoke = np.flatnonzero(pdf["side"].to_numpy() == 1)
            hub = np.repeat(starts, ends - starts)[spoke]
            same = (sigs[spoke] == sigs[hub]).sum(1)
            if plains is not None:
                same = np.maximum(same, (plains[spoke] == plains[hub]).sum(1))
            alike = estimate(same, sigs.shape[1]) >= least
            yield pd.DataFrame({"a": nodes[hub[alike]], "b": nodes[spoke[alike]]})

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "side").mapInPandas(run, "a long, b long")


def _by_shingles(threshold: float):
    def links(part: pd.DataFrame) -> list[tuple[int, int]]:
        sets = [(np.frombuffer(h, np.uint64), np.frombuffer(w, "<u4").astype(np.int64)) for h, w in zip(part["hashes"], part["counts"])]
        return verified_links(sets, threshold, **_options(part))

    return links


def _classed(rows: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """``rows`` (``key``, ``node``) with ``class``, the root of the node or itself, of keys with several classes."""
    classed = rows.join(roots, "node", "left").select(key, "node", F.coalesce("root", "node").alias("class"))
    mixed = classed.groupBy(key).agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select(key)
    return _salted(classed, mixed, [key], "left_semi")


def _united(roots: DataFrame, links: DataFrame, scratch) -> DataFrame:
    """Components ``roots`` with further ``links``."""
    return roots if links.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links), scratch)


def _canopies(nodes: DataFrame, scratch, band: int, registers: int, least: float, spokes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``root``) of nodes that look like another one, and the likely stars (``node``, ``hub``, ``buckets``)."""
    bands = registers // band
    keys = lambda sig: F.array(*(F.xxhash64(F.lit(b), F.substring(sig, b * band + 1, band)) for b in range(bands)))
    every = F.when(F.col("plain").isNull(), keys("sig")).otherwise(F.array_union(keys("sig"), keys("plain")))
    rows = nodes.select(F.explode(every).alias("bucket"), F.col("rep").alias("node"))
    hubs = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1").select("bucket", "hub")
    members = scratch.put(rows.join(hubs, "bucket"), "buckets")
    signatures = nodes.select(F.col("rep").alias("node"), "sig", "plain")
    pairs = scratch.put(members.filter("node <> hub").groupBy("hub", "node").agg(F.count("*").alias("buckets")), "stars")
    stars = _stars(pairs.select("hub", "node"), spokes).join(signatures, "node")
    likely = scratch.put(_likely_stars(stars, least), "likely-stars")
    first = components(likely, scratch)
    open_ = scratch.put(_classed(members.select("bucket", "node"), "bucket", first), "open-buckets")
    more = scratch.put(_compare(_across(open_, "bucket", block).join(signatures, "node"), ["bucket", "i", "j"], _by_signature(least)), "likely-links")
    return _united(first, more, scratch), likely.join(pairs, (F.col("a") == F.col("hub")) & (F.col("b") == F.col("node"))).select("node", "hub", "buckets")


def _verify(docs: DataFrame, canopies: DataFrame, stars: DataFrame, scratch, words: int, threshold: float, spokes: int, block: int, rounds: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))

    def cut(batches):
        memo = shared.held("near-duplicates", "words", WordHash)
        for pdf in batches:
            sets = [shingles(t, words, memo) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "hashes": [h.tobytes() for h, _ in sets], "counts": [w.astype("<u4").tobytes() for _, w in sets]})

    sets = scratch.put(canopies.select("node").join(texts, "node").mapInPandas(cut, "node long, hashes binary, counts binary"), "shingles")
    compare = lambda rows, keys: scratch.put(_compare(rows.join(sets, "node"), keys, _by_shingles(threshold)), "links")
    best = stars.groupBy("node").agg(F.max_by("hub", F.struct("buckets", -F.col("hub"))).alias("hub"))
    roots = components(compare(_stars(best, spokes), ["hub", "part"]), scratch)
    inside = canopies.select("node", F.col("root").alias("canopy"))
    for n in range(rounds):
        open_ = scratch.put(_classed(inside, "canopy", roots), "open-canopies")
        if open_.isEmpty():
            return roots
        if n < rounds - 1:
            hubs = open_.groupBy("canopy").agg(F.min_by(F.struct(F.col("node").alias("hub"), F.col("class").alias("own")), F.xxhash64(F.lit(n), "node")).alias("h")).select("canopy", "h.*")
            links = compare(_stars(open_.join(hubs, "canopy").filter("class <> own").select("hub", "node"), spokes), ["hub", "part"])
        else:
            links = compare(_across(open_, "canopy", block), ["canopy", "i", "j"])
        roots = _united(roots, links, scratch)
    return roots


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, registers: int = REGISTERS, band: int = BAND, likely: float = LIKELY, block: int = 512, canopy_block: int = 128, spokes: int = 256, rounds: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``group_id`` (the group's least doc_id), ``kept``.

    Texts without words (null, empty, blank) have no shingles: each is its own group.  Ties: the least doc_id is kept.
    Rows with equal doc_id count as one document and get a row each; rows with null doc_id are left out.  An empty
    table gives an empty result.
    """
    scratch = shared.Scratch(docs.sparkSession, "near-duplicates")
    signed = shared.materialise(sign(docs, words, registers), "signed")
    some = signed.filter("key is not null")
    nodes = scratch.put(some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("plain").alias("plain")), "nodes")
    canopies, stars = _canopies(nodes, scratch, band, registers, likely, spokes, block)
    groups = _verify(docs, canopies, stars, scratch, words, threshold, spokes, canopy_block, rounds)
    roots = nodes.select("key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("group_id"))
    roots = shared.materialise(roots, "roots")
    scratch.drop()
    with_words = some.select("doc_id", "key").join(roots, "key").select("doc_id", "group_id")
    out = with_words.unionByName(signed.filter("key is null").select("doc_id", F.col("doc_id").alias("group_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("group_id"))


def _rows(docs: DataFrame, row: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows with an id of their own, with it as ``row``, and the others (null and repeated ids) with fresh numbers, if any."""
    own, mark = F.col("doc_id").cast("long"), shared.fresh("id", [*docs.columns, row])
    ids = docs.select(own.alias(mark)).groupBy(mark).agg(F.count("*").alias("n"))
    shared_ids = shared.materialise(ids.filter(F.col(mark).isNull() | (F.col("n") > 1)).select(mark), "shared-ids")
    if shared_ids.isEmpty():
        return docs.withColumn(row, own), None
    lo, hi = docs.agg(F.coalesce(F.min(own), F.lit(0)), F.coalesce(F.max(own), F.lit(0))).first()
    number = F.monotonically_increasing_id()
    new = F.lit(hi + 1) + number if hi < 1 << 62 else F.lit(lo - 1) - number
    if hi >= 1 << 62 and lo < -(1 << 62):
        raise ValueError(f"ids from {lo} to {hi} leave no numbers for rows whose ids are null or repeated")
    same = own.eqNullSafe(F.col(mark))
    others = shared.materialise(docs.join(shared_ids, same, "left_semi").withColumn(row, new), "shared-id-rows")
    return docs.join(shared_ids, same, "left_anti").withColumn(row, own), others


def _row_groups(own: DataFrame, others: DataFrame, row: str, **options) -> DataFrame:
    """``row``, ``doc_id``, ``group_id``, ``kept`` of every row; in each group one row is kept, null ids last."""
    rows = own.unionByName(others).select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("row"), F.col("group_id").alias("group"))
    out = shared.materialise(groups.join(rows.select("row", "doc_id"), "row"), "row-groups")
    first = out.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return out.join(first, "group").select(F.col("row").alias(row), "doc_id", F.col("first.doc_id").alias("group_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def near_duplicate_rows(docs: DataFrame, **options) -> DataFrame:
    """As ``near_duplicates``, but each row counts as a document, also where ids are null or repeated.

    A group's ``group_id`` is null only if all its ids are.  Only ``doc_id`` and ``text`` are read.
    """
    docs = docs.select("doc_id", "text")
    own, others = _rows(docs, "row")
    return near_duplicates(docs, **options) if others is None else _row_groups(own, others, "row", **options).drop("row")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group, in their own columns, whatever these are called.

    Texts without words all stay, as do rows with null or repeated ids unless an earlier row is near them; an empty table
    stays empty.
    """
    row = shared.fresh("row", docs.columns)
    own, others = _rows(docs, row)
    if others is None:
        groups, rows = near_duplicates(docs.select("doc_id", "text"), **options).withColumnRenamed("doc_id", row), own
    else:
        groups, rows = _row_groups(own.select(row, "doc_id", "text"), others.select(row, "doc_id", "text"), row, **options), own.unionByName(others)
    mark = shared.fresh("gone", rows.columns)
    gone = shared.materialise(groups.filter("not kept").select(F.col(row).alias(mark)), "duplicates")
    return rows.join(gone, F.col(row) == F.col(mark), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_rows(shared.read(spark, sf_dir, "documents"))
