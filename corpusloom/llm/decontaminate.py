"""Benchmark decontamination with suffix arrays over training shards.

A training shard is a run of documents that holds about ``shard_words`` words; equal texts in it are one.  Words are
numbered by the benchmark's vocabulary (0: not in it), and only runs of known words that are long enough for a match go
into the shard's suffix array, which sorts whole suffixes by prefix doubling.  Every benchmark suffix is binary-searched
in it: its neighbours give its longest match, and the range of suffixes that share its window gives all locations.
Locations that can't be extended to the left are the starts of longest verbatim matches.  Hit words, items and the
longest match of each document follow, and contaminated documents are removed.  Documents are never shuffled.

The benchmark is cut into shards of whole items with about ``bench_words`` words, written to the shared folder; a task
holds one of them at a time, so a benchmark of any size fits.
"""

from __future__ import annotations

import hashlib
import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 13
VERDICT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_start long, longest_item string"
MATCH = "item_id string, item_start long, doc_id long, doc_start long, n_words long"

# Words are runs of digits, lower-case letters (A-Z lower-cased first) and anything beyond ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _starts(lengths: np.ndarray) -> np.ndarray:
    """First places of sequences that follow each other with one separator after each."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths + 1)])[:-1] if len(lengths) else np.empty(0, np.int64)


class Benchmark:
    """Items as word numbers with a 0 after each; every place but the zeros starts a suffix."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number, parts, self.names = self.vocabulary.setdefault, [], []
        for item_id, text in items:
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if len(ids):
                self.names.append(item_id)
                parts += [ids, np.zeros(1, np.int64)]
        self.ids = np.concatenate([*parts, np.zeros(1, np.int64)])
        lengths = np.array([len(x) for x in parts[::2]], np.int64)
        self.starts = _starts(lengths)
        places = np.arange(lengths.sum())
        self.item = np.repeat(np.arange(len(lengths)), lengths)
        self.suffixes = places + self.item
        left = self.starts[self.item] + lengths[self.item] - self.suffixes
        need = np.minimum(window, lengths)[self.item]
        self.windows = np.flatnonzero(left >= need)
        self.need = need
        self.least = int(need.min()) if len(need) else window


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of ``ids`` but the zeros, sorted by the numbers from there up to the next zero; ``ids`` ends with one.

    Prefix doubling: places that share their first k numbers are one group, named by its first slot; each step sorts the
    groups of more than one by the groups that follow k places later.
    """
    n = len(ids)
    stops = np.flatnonzero(ids == 0)
    end = stops[np.searchsorted(stops, np.arange(n))]
    bits = int(ids.max()).bit_length() if n else 1
    k = max(1, 62 // max(1, bits))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = (key << bits) | ids[np.minimum(np.arange(n) + j, end)]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    longest = int((end - np.arange(n)).max()) if n else 0
    while k < longest:
        same = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = same[1:] == same[:-1]
        tied[:-1] |= tied[1:]
        tied &= same >= len(stops)
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        group = order[slots]
        first, then = rank[group], rank[np.minimum(group + k, end[group])]
        by = np.lexsort((then, first))
        group, first, then = group[by], first[by], then[by]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (then[1:] != then[:-1])])
        order[slots] = group
        rank[group] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        k *= 2
    return order[len(stops) :]


def common(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the common prefixes of ``a[at:]`` and ``b[bt:]`` up to a zero, ``most`` at most."""
    n = np.zeros(len(at), np.int64)
    on = np.arange(len(at))
    while len(on):
        x = a[at[on] + n[on]]
        same = (x > 0) & (x == b[bt[on] + n[on]])
        if most is not None:
            same &= n[on] < most[on]
        on = on[same]
        n[on] += 1
    return n


class Shard:
    """Word numbers of some documents, and the suffix array of their runs of known words."""

    def __init__(self, texts: list, bench: Benchmark):
        get, known, parts, counts, which = bench.vocabulary.get, {}, [], [], []
        for text in texts:
            at = known.setdefault(text, len(counts))
            which.append(at)
            if at == len(counts):
                words = words_of(text)
                counts.append(len(words))
                parts += [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), np.zeros(1, np.int64)]
        self.which, self.counts = np.array(which, np.int64), np.array(counts, np.int64)
        self.starts = _starts(self.counts)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.size = len(ids)
        stops = np.concatenate([[-1], np.flatnonzero(ids == 0)])
        length = np.diff(stops) - 1
        long = length >= max(1, bench.least)
        self.place = np.arange(self.size)[np.repeat(long, length + 1)] if self.size else np.empty(0, np.int64)
        self.ids = np.concatenate([ids[self.place], np.zeros(1, np.int64)])
        self.suffixes = suffix_array(self.ids)

    def _search(self, bench: Benchmark, at: np.ndarray, most: np.ndarray | None, after: bool) -> np.ndarray:
        """Slots of the first suffix that isn't less than (``after``: is greater than) each benchmark suffix, of which
        only the first ``most`` words count, if given.
        """
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64)
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                return lo
            mid = (lo[on] + hi[on]) // 2
            q, p, cut = at[on], self.suffixes[mid], None if most is None else most[on]
            n = common(bench.ids, q, self.ids, p, cut)
            right = self.ids[p + n] < bench.ids[q + n]
            if cut is not None:
                right = np.where(n == cut, after, right)
            lo[on], hi[on] = np.where(right, mid + 1, lo[on]), np.where(right, hi[on], mid)

    def longest(self, bench: Benchmark) -> np.ndarray:
        """The longest match of each benchmark suffix anywhere in the shard, in words: that of a neighbour of its slot."""
        out = np.zeros(len(bench.suffixes), np.int64)
        if len(self.suffixes):
            slot = self._search(bench, bench.suffixes, None, False)
            for s in (slot - 1, slot):
                ok = (s >= 0) & (s < len(self.suffixes))
                out[ok] = np.maximum(out[ok], common(bench.ids, bench.suffixes[ok], self.ids, self.suffixes[s[ok]]))
        return out

    def occurrences(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, slot's place) for every place that shares a benchmark suffix's whole window."""
        able = bench.windows[self.longest(bench)[bench.windows] >= bench.need[bench.windows]]
        at, need = bench.suffixes[able], bench.need[able]
        lo = self._search(bench, at, need, False)
        n = self._search(bench, at, need, True) - lo
        slots = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(able, n), self.suffixes[slots]

    def matches(self, bench: Benchmark, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Longest verbatim matches: (item, start in it, text, start in it, words), not to be extended either way."""
        suffix, at = found
        q = bench.suffixes[suffix]
        before = np.where(at > 0, self.ids[at - 1], 0)
        first = (q == bench.starts[bench.item[suffix]]) | (before == 0) | (before != bench.ids[q - 1])
        suffix, q, at = suffix[first], q[first], at[first]
        place = self.place[at]
        text = np.searchsorted(self.starts, place, "right") - 1
        item = bench.item[suffix]
        return item, q - bench.starts[item], text, place - self.starts[text], common(bench.ids, q, self.ids, at)


class Verdicts:
    """What is known of a shard's texts after some benchmark shards: hit words, items and the longest match."""

    def __init__(self):
        self.shard, self.hit, self.items, self.best = None, None, {}, {}

    def add(self, shard: Shard, bench: Benchmark) -> None:
        if self.shard is None:
            self.shard, self.hit = shard, np.zeros(shard.size + 1, bool)
        found = shard.occurrences(bench)
        suffix, at = found
        place, edge = shard.place[at], np.zeros(shard.size + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + bench.need[suffix], -1)
        self.hit |= np.cumsum(edge) > 0
        text = np.searchsorted(shard.starts, place, "right") - 1
        for pair in np.unique(text * (len(bench.names) + 1) + bench.item[suffix]).tolist():
            t, k = divmod(pair, len(bench.names) + 1)
            self.items.setdefault(t, set()).add(bench.names[k])
        for k, _, t, start, n in zip(*(x.tolist() for x in shard.matches(bench, found))):
            name = bench.names[k]
            mine = (-n, start, name is None, name or "")
            if t not in self.best or mine < self.best[t]:
                self.best[t] = mine

    def table(self, share: int) -> pa.Table:
        """One row for each document of the shard, copies included, without its id."""
        s = self.shard
        covered = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.hit)])
        n_hit = covered[s.starts + s.counts] - covered[s.starts]
        none = hashlib.sha256(b"").hexdigest()
        n_items, digest = np.zeros(len(s.counts), np.int64), [none] * len(s.counts)
        words, start, item = np.zeros(len(s.counts), np.int64), [None] * len(s.counts), [None] * len(s.counts)
        for t, names in self.items.items():
            n_items[t] = len(names)
            digest[t] = hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest()
        for t, (n, at, unnamed, name) in self.best.items():
            words[t], start[t], item[t] = -n, at, None if unnamed else name
        each = {
            "n_words": s.counts, "n_hit": n_hit, "n_items": n_items, "items_sha256": pa.array(digest, pa.string()), "contaminated": (n_hit > 0) & (share * n_hit >= s.counts),
            "longest_words": words, "longest_start": pa.array(start, pa.int64()), "longest_item": pa.array(item, pa.string()),
        }
        return pa.table(each).take(pa.array(s.which))


def write_benchmark(benchmark: DataFrame, window: int = WINDOW, bench_words: int = 1 << 18) -> list[str]:
    """Files of benchmark shards in the shared folder: whole items of about ``bench_words`` words together.

    Items come to the driver one shard at a time.  Null item_ids count as one item, without a name in the digest; null
    and word-less texts have no windows.  Repeated item_ids count once.  No item: one empty shard.
    """
    from .bitpack import store

    place, folder = store(shared.new_path(benchmark.sparkSession, "benchmark"))
    place.create_dir(folder, recursive=True)
    files, held, size = [], [], 0

    def flush():
        files.append(f"{folder}/{len(files):06d}.pickle")
        with place.open_output_stream(files[-1]) as out:
            out.write(pickle.dumps(Benchmark(held, window)))

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in items.filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        held.append(tuple(row))
        size += len(row["text"]) // 6 + 1
        if size >= bench_words:
            flush()
            held, size = [], 0
    if held or not files:
        flush()
    return files


def _benchmark(folder: str, file: str) -> Benchmark:
    """One shard at a time is held: each is a group of its own."""
    from .bitpack import store

    def load() -> Benchmark:
        with store(folder)[0].open_input_stream(file) as opened:
            return pickle.loads(opened.read())

    return shared.held(f"benchmark {folder} {file}", file, load)


def _shards(batches, shard_words: int):
    """Arrow tables of whole documents with about ``shard_words`` words together (6 characters a word)."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff((size + np.cumsum(sizes)) // (6 * shard_words))) + 1 if len(sizes) else []
        edges = [0, *map(int, cuts), len(sizes)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if i and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
        if size >= 6 * shard_words:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _over_shards(docs: DataFrame, benchmark: DataFrame, schema, window: int, shard_words: int, bench_words: int, rows) -> DataFrame:
    """``rows(part, shards)`` for each training shard: ``part`` its documents, ``shards`` gives (Shard, Benchmark) pairs."""
    root, files = shared.shared_dir(docs.sparkSession), write_benchmark(benchmark, window, bench_words)

    def run(batches):
        for part in _shards(batches, shard_words):
            texts = part["text"].to_pylist()
            yield from rows(part, ((Shard(texts, bench), bench) for bench in (_benchmark(root, f) for f in files)))

    return docs.mapInArrow(run, schema)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _judged(shards, share: int) -> pa.Table:
    verdicts = Verdicts()
    for shard, bench in shards:
        verdicts.add(shard, bench)
    return verdicts.table(share)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, shard_words: int = 1_000_000, bench_words: int = 1 << 18) -> DataFrame:
    """One verdict for each row of ``docs``; contaminated: hit words are 1/``share`` of its words or more, and not none.

    With each its longest verbatim match: words, first word in the document, item; of equally long ones the first in the
    document, then of the least item_id, nulls last.  Null and empty texts have no words and are never contaminated.
    Repeated rows get a verdict each, and an empty table or benchmark gives none or clean ones.
    """

    def rows(part, shards):
        yield from _judged(shards, share).add_column(0, "doc_id", part["doc_id"]).combine_chunks().to_batches()

    return _over_shards(_slim(docs), benchmark, VERDICT, window, shard_words, bench_words, rows)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = 1_000_000, bench_words: int = 1 << 18) -> DataFrame:
    """All longest verbatim matches and their locations, in words, of benchmark items in documents."""
    names, types = ["item_id", "item_start", "doc_id", "doc_start", "n_words"], [pa.string(), *[pa.int64()] * 4]

    def rows(part, shards):
        ids, found = part["doc_id"].to_pylist(), []
        for shard, bench in shards:
            copies: dict[int, list] = {}
            for doc, t in zip(ids, shard.which.tolist()):
                copies.setdefault(t, []).append(doc)
            for k, a, t, b, n in zip(*(x.tolist() for x in shard.matches(bench, shard.occurrences(bench)))):
                found += [(bench.names[k], a, doc, b, n) for doc in copies[t]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    return _over_shards(_slim(docs), benchmark, MATCH, window, shard_words, bench_words, rows)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, shard_words: int = 1_000_000, bench_words: int = 1 << 18) -> DataFrame:
    """``docs`` without contaminated rows, all columns as they are; ``text`` must be a string column."""

    def rows(part, shards):
        gone = _judged(shards, share)["contaminated"].to_numpy()
        yield from part.filter(pa.array(~gone)).to_batches()

    return _over_shards(docs, benchmark, docs.schema, window, shard_words, bench_words, rows)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(shared.read(spark, sf_dir, "documents").select("doc_id", "text"), shared.read(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT k, item_id, n, i AS j, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
        FROM (SELECT k, item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
occ AS (SELECT doc_id, i, dg.n, k, item_id, j FROM dg JOIN win USING (n, w)),
run AS (SELECT doc_id, k, item_id, n, i, i - j AS d, i - row_number() OVER (PARTITION BY doc_id, k, i - j ORDER BY i) AS g FROM occ),
isl AS (SELECT doc_id, item_id::VARCHAR AS item, min(i) - 1 AS start, max(i) - min(i) + any_value(n) AS words FROM run GROUP BY doc_id, k, item_id, d, g),
best AS (SELECT doc_id, words, start, item FROM isl QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, start, item NULLS LAST) = 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
  coalesce(words, 0)::BIGINT AS longest_words, start::BIGINT AS longest_start, item AS longest_item
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN best USING (doc_id)
"""
