"""I-Match fingerprints from DataFrame functions only.

The lexicon keeps the terms whose share of documents lies in a band of inverse document frequency, counted over all
documents; terms are 64-bit hashes. As every document has its distinct terms once, no more than (mean distinct terms)
/ ``LEAST_SHARE`` terms can be in the band, however large the corpus. Up to ``BROADCAST_TERMS`` of them, the lexicon is
broadcast; beyond, it is joined by a shuffle.

A document's distinct terms in the lexicon are sorted and hashed under randomised lexicon subsets: each of ``SEEDS``
seeds draws nested subsets, the one of level l holding a 2**-l share of the lexicon. A document uses the level at which
two to four of its terms are left and the next two, so that documents of like size meet at a level, the larger subsets
tell documents apart, and the smaller ones stand an edit that leaves their terms alone. The fingerprint is the level and
the hashes; likeness is the share of equal hashes among the subsets in which either document has a term. Texts without
lexicon terms stand for themselves.

The next document in ascending doc_id order is found by a window within ranges of about ``RANGE`` documents, and by the
first document of the next range. Ranges lie between quantiles of doc_id, so a far doc_id changes none; a doc_id that
fills several ranges, or rows without one, are parted by a hash of the text. Cases: null or empty text has no terms; null
doc_ids come first; rows of one doc_id are ordered by that hash, then by text; the only document's next is itself; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SEEDS, LEVELS, RANGE, RANGES, TOP = 16, 3, 512, 65_536, 14
BROADCAST_TERMS = 500_000
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.0005, 0.05, 2
SEPARATORS = r"[\s.,;:!?()\"]+"


def terms_of(text: Column) -> Column:
    """Distinct lower-case terms and the empty one, which every document has."""
    return F.array_union(F.split(F.lower(text), SEPARATORS), F.array(F.lit("")))


def lexicon(docs: DataFrame, n: int) -> DataFrame:
    """(term, draws, deepest): hashes of the terms in the band; ``draws`` has for each seed, in 4 bits, the deepest level that draws the term."""
    counts = docs.select(F.explode(terms_of(F.col("text"))).alias("t")).groupBy(F.xxhash64("t").alias("term")).count()
    low, high = max(LEAST_DOCS, math.ceil(LEAST_SHARE * n)), max(LEAST_DOCS, math.floor(MOST_SHARE * n))
    kept = counts.where(F.col("count").between(low, high) & (F.col("term") != F.xxhash64(F.lit(""))))
    depth = lambda s: f"least({TOP + 1}, bit_count((xxhash64(term, {s}) & -xxhash64(term, {s})) - 1))"
    draws = F.expr(" | ".join(f"shiftleft(cast({depth(s)} as bigint), {4 * s})" for s in range(SEEDS)))
    deepest = F.expr(f"greatest({', '.join(map(depth, range(SEEDS)))})")
    return kept.select("term", draws.alias("draws"), deepest.alias("deepest"))


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: expressions would be copied into every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fingerprint(terms: Column, text_hash: Column) -> Column:
    """struct(level, hashes): an array of hashes for the level and for each of the next; 0 where no term is left.

    ``terms`` are (term, draws, deepest); those that no seed draws at a level go first.
    """
    alone = F.array(F.struct(text_hash.alias("term"), F.lit(-1).cast("bigint").alias("draws"), F.lit(TOP + 1).alias("deepest")))
    drawn = lambda s, at: lambda x: F.shiftrightunsigned(x["draws"], 4 * s).bitwiseAND(F.lit(15)) >= at
    hashes = lambda left, at: F.array(*(_let(F.filter(left, drawn(s, at)), _hash) for s in range(SEEDS)))
    deep = lambda own, at: F.filter(own, lambda x: x["deepest"] >= at)

    def at_level(own: Column, level: Column) -> Column:
        at = lambda k: _let(deep(own, level + k), lambda x: hashes(x, level + k))
        lists = [at(k) for k in range(LEVELS)]
        return F.struct(level.alias("level"), F.array(*lists).alias("hashes"))

    level = lambda own: F.greatest(F.lit(0), F.least(F.lit(TOP - LEVELS + 1), F.ceil(F.log2(F.size(own).cast("double"))).cast("int") - LEVELS + 1))
    return _let(F.array_sort(F.when(F.size(terms) > 0, terms).otherwise(alone)), lambda own: _let(level(own), lambda at: at_level(own, at)))


def _hash(members: Column) -> Column:
    return F.when(F.size(members) > 0, F.xxhash64(F.transform(members, lambda x: x["term"]))).otherwise(F.lit(0).cast("bigint"))


def _share(pairs: Column) -> Column:
    equal = lambda either: F.size(F.filter(either, lambda p: p["x"] == p["y"]))
    share = lambda either: F.when(F.size(either) > 0, equal(either) / F.size(either)).otherwise(F.lit(0.0))
    return _let(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)), share)


def likeness(p: Column, q: Column) -> Column:
    """Share of equal hashes at the levels that both have; 0 where they have none in common."""
    gap = p["level"] - q["level"]
    zipped = lambda x, y: F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))
    # after the gap, the lists of the lower one belong to the levels of the higher one
    met = lambda x, y, n: F.flatten(F.zip_with(F.slice(x, 1, F.lit(LEVELS) - n), F.slice(y, n + 1, F.lit(LEVELS)), zipped))
    ahead, behind = met(p["hashes"], q["hashes"], gap), met(q["hashes"], p["hashes"], -gap)
    return F.when(F.abs(gap) >= LEVELS, F.lit(0.0)).when(gap >= 0, _share(ahead)).otherwise(_share(behind))


def told(p: Column) -> Column:
    """The fingerprint as text, 32 bits of each hash."""
    low = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    one = lambda xs: F.array_join(F.transform(xs, lambda x: F.when(x == 0, F.lit("-")).otherwise(low(x))), ".")
    return F.concat(p["level"].cast("string"), F.lit(":"), F.array_join(F.transform(p["hashes"], one), ":"))


def ranged(docs: DataFrame, n: int, nulls: int) -> DataFrame:
    """``docs`` with the number of each row's range, ascending with (doc_id, hash of the text).

    A row's place among the quantiles is found by binary search, folded over the steps, so that the expression stays small
    however many there are. The number is never null, or Spark would filter it in one of its uses and shuffle all texts
    for each.
    """
    count = min(RANGES, math.ceil(max(n - nulls, 1) / RANGE))
    at = [k / count for k in range(1, count)]
    bounds = sorted(int(x) for x in docs.approxQuantile("doc_id", at, 0.2 / count)) if at and n > nulls else []
    several = sorted(Counter(bounds).items())  # a bound stands there once for each range that its id fills
    ids, widths = [i for i, _ in several], [w for _, w in several]
    before = [0, *itertools.accumulate(widths)]  # bounds below each of the ids, and all
    own = F.col("doc_id").cast("bigint")

    def constant(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")

    steps = constant([1 << k for k in reversed(range(len(ids).bit_length()))])
    up = lambda at, step: at + F.when(F.coalesce(F.get(constant(ids), (at + step - 1).cast("int")) < own, F.lit(False)), step).otherwise(F.lit(0))
    place = F.aggregate(steps, F.lit(0).cast("bigint"), up).cast("int")  # how many ids are less than the row's
    width = lambda at: F.coalesce(F.when(F.get(constant(ids), at) == own, F.get(constant(widths), at)), F.lit(0))
    share = F.xxhash64("text") / F.lit(2.0**64) + 0.5
    of = lambda width: F.least(width - 1, F.floor(share * width))
    inside = lambda at: _let(width(at), lambda w: F.get(constant(before), at) + F.when(w > 0, 1 + of(w)).otherwise(F.lit(0)))
    free = F.lit(min(RANGES, math.ceil(max(nulls, 1) / RANGE)))
    number = F.when(own.isNull(), of(free) - free).otherwise(_let(place, inside)).cast("bigint")
    return docs.withColumn("range", F.coalesce(number, F.lit(0).cast("bigint")))


def _next_range(ranges: DataFrame) -> DataFrame:
    """(range, next): the following one of those that exist; the last is followed by the first. Two steps, so that no
    window holds more than the ranges of a group of 4096, or the groups."""
    grouped = ranges.withColumn("g", F.floor(F.col("range") / 4096))
    near = grouped.withColumn("near", F.lead("range").over(Window.partitionBy("g").orderBy("range")))
    order = Window.orderBy("g")
    tops = grouped.groupBy("g").agg(F.min("range").alias("top"))
    tops = tops.select("g", F.coalesce(F.lead("top").over(order), F.first("top").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("far"))
    return near.join(tops, "g").select("range", F.coalesce("near", "far").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, known_ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    words = written(lexicon(docs, n).unionByName(docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(None).cast("bigint").alias("draws"), F.lit(0).alias("deepest"))), "lexicon")
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)

    placed = ranged(docs, n, n - known_ids)
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    rows = placed.select("range", "doc_id", "text", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("near"))
    following = _next_range(placed.select("range").distinct())
    edge = lambda frame, value: following.join(frame.where("row = 1").select(F.col("range").alias("next"), F.col(value).alias("far")), "next").drop("next")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    whole = rows.join(edge(rows, "text"), "range", "left").withColumn("following", F.coalesce("near", "far"))
    whole = whole.select("range", "row", "doc_id", size.cast("bigint").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), size - half), F.substring("following", F.lit(1), half)).alias("edited"))
    both = whole.select(
        "range",
        "row",
        F.struct("doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), F.xxhash64("text").alias("h"), F.xxhash64("edited").alias("eh")).alias("own"),
        F.array(F.struct(F.lit(False).alias("e"), terms_of(F.col("text")).alias("ts")), F.struct(F.lit(True).alias("e"), terms_of(F.col("edited")).alias("ts"))).alias("sides"),
    )
    exploded = both.select("range", "row", "own", F.explode("sides").alias("side")).select("range", "row", "own", "side.e", F.explode("side.ts").alias("t"))
    # what is the document's own goes with its empty term alone
    own = F.when((F.col("t") == "") & ~F.col("e"), F.col("own")).alias("own")
    known = exploded.select("range", "row", "e", own, F.xxhash64("t").alias("term")).join(words, "term")
    pair = lambda e: F.collect_list(F.when((F.col("e") == e) & F.col("draws").isNotNull(), F.struct("term", "draws", "deepest")))
    grouped = known.groupBy("range", "row").agg(F.first("own", ignorenulls=True).alias("own"), pair(False).alias("ts"), pair(True).alias("es"))
    printed = grouped.select("range", "row", "own", fingerprint(F.col("ts"), F.col("own.h")).alias("p"), fingerprint(F.col("es"), F.col("own.eh")).alias("q"))
    ahead = printed.withColumn("near", F.lead("p").over(Window.partitionBy("range").orderBy("row")))
    out = ahead.join(edge(printed, "p"), "range", "left").withColumn("following", F.coalesce("near", "far"))
    return out.select(
        F.col("own.doc_id").alias("doc_id"),
        F.col("own.n_chars").alias("n_chars"),
        F.col("own.sha").alias("edited_sha256"),
        told(F.col("p")).alias("fingerprint"),
        told(F.col("q")).alias("edited_fingerprint"),
        likeness(F.col("p"), F.col("q")).alias("near_edited"),
        likeness(F.col("p"), F.col("following")).alias("near_next"),
    )


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and its likeness to an edited text's and to the next document's."""
    return fingerprints(table(spark, sf_dir, "documents"))
