"""Operators on whole tables: running totals, ranking, samples, state, duplicates, phrases."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in ``order``, which should be total.  Ranks are cut before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def cap_per_key(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def running(df: DataFrame, order: str, sums: dict[str, str], buckets: int = 200, descending: bool = False, tie: str | None = None, group: str | None = None) -> DataFrame:
    """Running totals over a whole table, in the order of a numeric column and then ``tie``, without one task for all rows.

    Cut points split the order into buckets; totals run within each bucket, and the few bucket totals run over
    all.  Rows of equal order and tie share their total.  Nulls in ``order`` are left out.  ``group``: totals start anew
    for each of its values.
    """
    rows, own = df.filter(F.col(order).isNotNull()), [group] if group else []
    cuts = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    edges = sorted(set(map(float, cuts)))
    edge = F.array(*(F.lit(e) for e in edges)) if edges else F.array().cast("array<double>")
    bucket = F.size(F.filter(edge, lambda e: e < F.col(order)))
    placed = rows.withColumn("_bucket", -bucket if descending else bucket)
    totals = placed.groupBy(*own, "_bucket").agg(*(F.sum(c).alias(f"_all_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*own).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*own, "_bucket", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    by = [F.col(c).desc() if descending and c == order else F.col(c) for c in ([order] if tie is None else [order, tie])]
    inside = Window.partitionBy(*own, "_bucket").orderBy(*by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Without groups there are at most ``buckets`` offsets.
    out = placed.join(F.broadcast(offsets), "_bucket") if group is None else placed.join(offsets.withColumnRenamed(group, "_group"), (placed[group].eqNullSafe(F.col("_group"))) & (placed["_bucket"] == offsets["_bucket"])).drop(offsets["_bucket"], "_group")
    return out.select(*df.columns, *((F.sum(c).over(inside) + F.col(f"_before_{n}")).alias(n) for n, c in sums.items()))


def exact_quantiles(df: DataFrame, value: str, levels: list[float], group: str | None = None) -> DataFrame:
    """``group`` (if given), ``n`` and ``q0``, ``q1``, ... of the levels, by linear interpolation between neighbours.

    Rows become counts of distinct values, and these running totals over buckets; no task holds all values.  Nulls are
    left out; without a value the result is null, or has no row for the group.
    """
    own = [group] if group else []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*own, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    upto = running(counts, "_v", {"_upto": "_n"}, group=group)
    sizes = counts.groupBy(*own).agg(F.sum("_n").alias("n")).filter("n > 0")
    placed = upto.join(F.broadcast(sizes.withColumnRenamed(group, "_g")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g") if group else upto.crossJoin(sizes)  # one row, or one for each group
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    reach = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    picked = placed.groupBy(*own, "n").agg(*(reach(F.floor(at(q))).alias(f"_a{i}") for i, q in enumerate(levels)), *(reach(F.ceil(at(q))).alias(f"_b{i}") for i, q in enumerate(levels)))
    return picked.select(*own, "n", *((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (at(q) - F.floor(at(q)))).alias(f"q{i}") for i, q in enumerate(levels)))


def insert_ignore(state: DataFrame, rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` whose key is neither in ``state`` nor earlier, in ``order``, among themselves.  Null keys are left out."""
    return keep_first(rows.filter(F.col(key).isNotNull()), [key], order).join(state.select(key), key, "left_anti").select(*rows.columns)


def insert_counts(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row: ``inserted`` keys that ``state`` lacks, ``skipped`` rows."""
    new = rows.filter(F.col(key).isNotNull()).select(key).distinct().join(state.select(key), key, "left_anti").agg(F.count("*").alias("inserted"))
    return rows.agg(F.count("*").alias("_all")).crossJoin(new).select("inserted", (F.col("_all") - F.col("inserted")).alias("skipped"))  # one row each


def latest(attempts: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key, by one aggregation."""
    rest = [c for c in attempts.columns if c not in keys]
    top = attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_top"))
    return top.select(*keys, *(F.col(f"_top.{c}") for c in rest))


def first_writer(attempts: DataFrame, keys: list[str], value: str, version: str) -> DataFrame:
    """The earliest value of each key that is not null."""
    return attempts.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, version).alias(value))


def duplicate_groups(df: DataFrame, content: Column, key: str) -> DataFrame:
    """key, sha256, group id (16 hex digits; null for a text that occurs once), n in group.

    Counts are aggregated before they are joined back, so a text with very many copies is spread by the join's skew
    handling rather than gathered by a window.
    """
    hashed = df.select(F.col(key), F.sha2(content.cast("binary"), 256).alias("sha256"))
    counts = hashed.groupBy("sha256").agg(F.count("*").alias("n_copies")).filter("n_copies > 1")
    return hashed.join(counts, "sha256", "left").select(key, "sha256", F.when(F.col("n_copies").isNotNull(), F.substring("sha256", 1, 16)).alias("group_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keepers(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with ``is_duplicate``: true for all but the first row in ``order`` of each group, false without group.

    Rows without group don't enter the window, where they would be one partition.
    """
    w = Window.partitionBy(group).orderBy(*order)
    grouped = df.filter(F.col(group).isNotNull()).withColumn("is_duplicate", F.row_number().over(w) > 1)
    return grouped.unionByName(df.filter(F.col(group).isNull()).withColumn("is_duplicate", F.lit(False)))


def match_phrases(docs: DataFrame, key: str, text: str, dictionary: DataFrame, most_inline: int = 64, most_broadcast: int = 200_000) -> DataFrame:
    """(key, phrase, weight, end) for every phrase of ``dictionary`` that stands whole in a text, once each.

    ``end``: the place after its first whole occurrence.  Up to ``most_inline`` phrases are fixed patterns tested in the
    row.  Beyond, a phrase's first run of letters and digits must be a word of the text, so the join is on that word, with
    the dictionary sent to all tasks if it has at most ``most_broadcast`` phrases; a larger one is joined with words and
    keys alone, and each text is fetched once for its candidates.  Phrases without letter or digit are left out.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("None")))
    phrases = dictionary.select(F.lower("phrase").alias("phrase"), "weight").withColumn("_word", F.regexp_extract("phrase", r"([\p{L}\p{N}]+)", 1)).filter("_word <> ''")
    few = phrases.limit(most_broadcast + 1).count()
    place = lambda t, p: S.phrase_place(t, p)
    if few <= most_inline:
        given = [(r["phrase"], r["weight"]) for r in phrases.orderBy("phrase").collect()]
        seen = docs.select(key, low.alias("_low"))
        kind = phrases.schema["weight"].dataType
        each = [F.struct(F.lit(p).alias("phrase"), F.lit(w).cast(kind).alias("weight"), F.when(F.col("_low").contains(p), place(F.col("_low"), F.lit(p))).otherwise(0).alias("at")) for p, w in given]
        none = F.array().cast(f"array<struct<phrase:string,weight:{kind.simpleString()},at:int>>")
        found = seen.select(key, F.inline(F.filter(F.array(*each) if each else none, lambda x: x["at"] > 0)))
        return found.select(key, "phrase", "weight", (F.col("at") - 1 + F.length("phrase")).alias("end"))
    words = F.array_distinct(F.split(low, r"[^\p{L}\p{N}]+"))
    if few <= most_broadcast:
        firsts = sorted(r[0] for r in phrases.select("_word").distinct().collect())
        words = F.array_intersect(words, F.split(F.lit("\n".join(firsts)), "\n"))
        found = docs.select(key, low.alias("_low"), F.explode(words).alias("_word")).join(F.broadcast(phrases), "_word")
    else:
        named = docs.select(key, F.explode(words).alias("_word")).join(phrases, "_word").groupBy(key).agg(F.collect_list(F.struct("phrase", "weight")).alias("_all"))
        found = docs.select(key, low.alias("_low")).join(named, key).select(key, "_low", F.inline("_all"))
    placed = found.filter(F.contains("_low", "phrase")).withColumn("_at", place(F.col("_low"), F.col("phrase"))).filter("_at > 0")
    return placed.select(key, "phrase", "weight", (F.col("_at") - 1 + F.length("phrase")).alias("end"))


def merge_dictionaries(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """One weight for each phrase; a phrase in both has the negative one."""
    return positive.join(negative.select("phrase"), "phrase", "left_anti").unionByName(negative).select(F.lower("phrase").alias("phrase"), "weight")


def with_translations(phrases: DataFrame, translations: list[DataFrame], key: str = "key") -> DataFrame:
    """``phrases`` with the columns of each table of translations, null where a key has none."""
    return reduce(lambda out, t: out.join(t, key, "left"), translations, phrases)


def flatten_translations(wide: DataFrame, key: str, weight: str, order: str) -> DataFrame:
    """phrase, weight from one row a key and one column a language; of equal phrases the last by ``order`` and then by
    column has its weight.  Null translations are left out.
    """
    languages = [c for c in wide.columns if c not in (key, weight, order)]
    each = F.array(*(F.struct(F.lit(i).alias("at"), F.col(c).alias("phrase")) for i, c in enumerate(languages)))
    rows = wide.select(order, weight, F.inline(each)).filter("phrase is not null")
    return rows.groupBy("phrase").agg(F.max_by(weight, F.struct(order, "at")).alias("weight"))


def allocate(df: DataFrame, key: str, p: str, target: int, strata: list[tuple[float, float, float]], seed: int) -> DataFrame:
    """``int(target * fraction)`` rows of each stratum [lo, hi), in seeded order; shortfalls stay.

    Each stratum is a top-k of its own: tasks keep its first rows only, and no stratum meets in one task.
    """
    parts = []
    for lo, hi, fraction in strata:
        inside = df.filter((F.col(p) >= lo) & (F.col(p) < hi)).withColumn("stratum", F.lit(f"{lo:.2f}-{hi:.2f}"))
        parts.append(inside.orderBy(S.seeded(seed, F.col(key)), key).limit(int(target * fraction)))
    return reduce(DataFrame.unionByName, parts)


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """``is_test`` by a threshold on a hash within each label: no sort, no shuffle, stable as rows are added.

    The share is met in expectation; a row never changes sides.
    """
    draw = F.conv(F.substring(S.seeded(seed, F.concat_ws("|", F.col(label).cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("is_test", draw < share)


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``hash``, the 64-bit SimHash of the whole text as 16 hex digits; null for a text without words.

    Each occurrence of a lower-cased word votes by the first 64 bits of its md5; a bit is set if most votes are.
    """

    def run(batches):
        memo: dict[str, bytes] = {}
        for pdf in batches:
            out = []
            for t in pdf["_text"]:
                words = re.findall(r"[^ \n\t\r]+", t) if t else []
                if len(memo) > 500_000:
                    memo.clear()
                for w in set(words).difference(memo):
                    memo[w] = hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:8]
                votes = np.unpackbits(np.frombuffer(b"".join(map(memo.__getitem__, words)), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                out.append(np.packbits(2 * votes > len(words)).tobytes().hex() if words else None)
            yield pd.DataFrame({"_key": pdf["_key"], "hash": out})

    rows = df.select(F.col(key).cast("string").alias("_key"), F.lower(text).alias("_text"))
    return rows.mapInPandas(run, "_key string, hash string").select(F.col("_key").cast(df.schema[key].dataType).alias(key), "hash")


def near_hash_links(df: DataFrame, key: str, hash_col: str, most_bits: int = 2) -> DataFrame:
    """Links ``a``, ``b``, ``bits`` from which all pairs within ``most_bits`` bits (at most 2) follow.

    Equal hashes are one node, named by its least key, and linked to it with 0 bits: their pairs are not written out.
    Nodes are compared if two of four 16-bit pieces are equal.  Null keys and hashes are near nothing.
    """
    if not 0 <= most_bits <= 2:
        raise ValueError("two equal pieces of four find at most 2 differing bits")
    rows = df.filter(F.col(key).isNotNull() & (F.length(hash_col) == 16)).select(F.col(key).alias("b"), F.col(hash_col).alias("_h")).distinct()
    nodes = rows.groupBy("_h").agg(F.min("b").alias("a"))
    copies = rows.join(nodes, "_h").filter("a <> b").select("a", "b", F.lit(0).alias("bits"))
    piece = lambda i: F.substring("_h", 1 + 4 * i, 4)
    pairs = F.posexplode(F.array(*(F.concat(piece(i), piece(j)) for i in range(4) for j in range(i + 1, 4)))).alias("_at", "_piece")
    cut = nodes.select("a", "_h", pairs)
    x, y = cut.select(F.col("a").alias("x"), F.col("_h").alias("_hx"), "_at", "_piece"), cut.select(F.col("a").alias("y"), F.col("_h").alias("_hy"), "_at", "_piece")
    bits = S.hex_distance(F.col("_hx"), F.col("_hy")).cast("int")
    near = x.join(y, ["_at", "_piece"]).filter("_hx < _hy").select("_hx", "_hy", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), bits.alias("bits")).filter(F.col("bits") <= most_bits)
    return copies.unionByName(near.distinct().select("a", "b", "bits"))


def draw_strata(frame: DataFrame, key: str, alike: str, strata: dict[str, Column], need: int, seed: int, vetoed: tuple = ()) -> DataFrame:
    """``need`` units of each stratum in turn, in seeded order, none like one drawn before (equal ``alike``).

    A stratum's pool is cut to one unit of each look before it is ranked; only the few drawn units are carried on.
    Nulls in ``alike`` are like nothing and may all be drawn.
    """
    drawn: list[tuple] = []
    for name, inside in strata.items():
        looks = [r[1] for r in drawn if r[1] is not None]
        pool = frame.filter(inside & ~F.col(key).isin(*[r[0] for r in drawn], *vetoed) & (~F.col(alike).isin(*looks) | F.col(alike).isNull() if looks else F.lit(True)))
        order = [S.seeded(seed, F.col(key)), F.col(key)]
        one = keep_first(pool.withColumn("_look", F.coalesce(F.col(alike).cast("string"), F.concat(F.lit("\0"), F.col(key).cast("string")))), ["_look"], order)
        drawn += [(r[key], r[alike], name) for r in one.select(key, alike).orderBy(*order).limit(need).collect()]
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    return frame.sparkSession.createDataFrame(drawn, f"`{key}` {kinds[key]}, `{alike}` {kinds[alike]}, stratum string")
