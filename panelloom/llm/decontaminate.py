"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters and digits, lower-cased; a shingle is five words (a shorter text is one
shingle). A window of an item's size is worth a fingerprint only where it shares shingles with that
item: less than ``2 t / (1 + t)`` of the item's shingles in common can't reach similarity t; where the
whole document has m shingles and the item n > m, less than ``t (n + m) / (1 + t)`` can't. Of those
windows, the 64-bit SimHash, in which each shingle weighs as often as it occurs, is cut into
``BLOCKS`` blocks. Items are listed under every block value within ``FLIPS`` bits of theirs, so by
the pigeonhole principle every pair within ``BLOCKS * (FLIPS + 1) - 1`` bits meets. Pairs that meet
within that radius are verified: the weighted Jaccard similarity (sums of least and of largest counts)
of the shingles themselves must be ``least_similarity`` or more.

An item of fewer than five words is looked for as one shingle of its own length. A null or empty text, or item, matches nothing. A document is
its doc_id, which may be null, and a digest of its text: rows that repeat both are one document, rows with one doc_id, or none, and
different texts are documents of their own, and the fate of one doesn't touch the other. Very long texts are searched whole; the windows tried for
an item are at most as many as the words of text and item together. Other columns may have any name.
All by DataFrame functions. Items' shingles are broadcast up to ``BROADCAST`` of them, candidate
documents up to ``BROADCAST`` ids; beyond that the joins shuffle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import durable

SHINGLE, BLOCKS, FLIPS, BROADCAST = 5, 4, 4, 200_000
RADIUS = BLOCKS * (FLIPS + 1) - 1
_BITS = 64 // BLOCKS


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def _hash(parts: list[Column]) -> Column:
    """Of words' hashes; absent ones don't count."""
    return F.xxhash64(*parts)


def _worded(df: DataFrame, keep: list, short: tuple[int, ...] = ()) -> DataFrame:
    """``keep``, words, the hash of the shingle at each place, and in ``brief`` those of the ``short`` lengths; rows without words are left out."""
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    marks = F.transform("words", lambda w: F.xxhash64(w))
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)))
    at = lambda n: lambda i: _hash([F.get("marks", i + k) for k in range(n)])
    placed = lambda n: lambda i: F.struct(i.alias("place"), at(n)(i).alias("shingle"))
    brief = [F.transform(F.sequence(F.lit(0), F.size("words") - n), placed(n)) for n in short]
    brief = [F.when(F.size("words") >= n, b).otherwise(F.array().cast("array<struct<place:int,shingle:bigint>>")) for n, b in zip(short, brief, strict=True)]
    return (
        df.select(*keep, plain.alias("plain"))
        .filter(F.length("plain") > 0)
        .select(*keep, F.split("plain", " ").alias("words"))
        .withColumn("marks", marks)
        .withColumn("shingles", F.transform(places, at(SHINGLE)))
        .withColumn("brief", F.concat(*brief) if brief else F.lit(None).cast("array<struct<place:int,shingle:bigint>>"))
        .drop("marks")
    )


def simhash(shingles: str | Column) -> Column:
    """64 bits: each is set where more occurrences of shingles have it set than not."""
    bit = lambda b: F.aggregate(shingles, F.lit(0), lambda a, h: a + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")).cast("int") * 2 - 1)
    votes = F.array(*[F.when(bit(b) > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)])
    return F.aggregate(votes, F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))


def _block(fingerprint: str, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, b * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))


def _texts(words: str) -> Column:
    """The shingles themselves."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, SHINGLE)))


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two arrays: how often a value occurs is its weight."""
    times = lambda x, array: F.size(F.filter(array, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(x, a), times(x, b)))
    return common / (F.size(a) + F.size(b) - common)


def leaks(docs: DataFrame, benchmark: DataFrame, least_similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: for each document and item in it, the best window."""
    return _found(docs, benchmark, least_similarity).drop("mark")


def _found(docs: DataFrame, benchmark: DataFrame, least_similarity: float) -> DataFrame:
    """As ``leaks``, with ``mark``, a digest of the text."""
    spark, of = docs.sparkSession, ["doc_id", "mark"]
    docs = docs.select("doc_id", _digest("text").alias("mark"), "text")
    items = durable(_worded(benchmark, ["item_id"]).withColumn("fingerprint", simhash("shingles")).withColumn("size", F.size("words")))
    item_shingles = items.select("item_id", "size", F.size("shingles").alias("of"), F.posexplode_outer("shingles").alias("item_place", "shingle"))
    n_shingles = item_shingles.count()
    share = least_similarity / (1 + least_similarity)

    short = tuple(sorted(r["size"] for r in items.filter(F.col("size") < SHINGLE).select("size").distinct().collect()))  # four at most
    # The outer form: the inner one pushes a filter on the array's size below, where the hashes would be computed anew for each place.
    worded = _worded(docs, of, short)
    places = worded.select(*of, F.size("shingles").alias("own"), F.posexplode_outer("shingles").alias("place", "shingle"))
    if short:
        places = places.union(worded.select(*of, F.size("shingles").alias("own"), F.explode_outer("brief").alias("b")).select(*of, "own", "b.place", "b.shingle")).filter("shingle IS NOT NULL")
    hits = places.join(F.broadcast(item_shingles) if n_shingles <= BROADCAST else item_shingles, "shingle")
    starts = (
        hits.groupBy(*of, "item_id", "size", "of")
        .agg(F.min("own").alias("own"), F.countDistinct("item_place").alias("met"), F.collect_set(F.col("place") - F.col("item_place")).alias("starts"))
        .filter(F.col("met") >= F.ceil((F.col("of") + F.least("own", "of")) * share - 1e-9))
        .groupBy(*of)
        .agg(F.collect_list(F.struct("item_id", "size", "starts")).alias("wanted"))
    )
    starts = durable(starts)  # a row for each document that holds most of an item
    wanted = starts.withColumnsRenamed({"doc_id": "wanted_id", "mark": "wanted_mark"})
    few = starts.count() <= BROADCAST
    held = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("mark") == F.col("wanted_mark")))

    # Windows are built in the row and only they are exploded: all words beside each window would be quadratic.
    first = lambda want, s: F.greatest(F.least(s, F.size("words") - want["size"]), F.lit(0))
    window = lambda want: lambda s: F.struct(
        want["size"].alias("size"),
        first(want, s).alias("start"),
        F.slice("words", first(want, s) + 1, want["size"]).alias("window"),
        F.slice("shingles", F.least(first(want, s), F.size("shingles") - 1) + 1, F.greatest(want["size"] - SHINGLE + 1, F.lit(1))).alias("shingles"),
    )
    word = lambda k: F.get("window", F.lit(k))
    whole = F.array(_hash([F.when(word(k).isNotNull(), F.xxhash64(word(k))) for k in range(SHINGLE)]))
    windows = (
        _worded(held, [*of, "wanted"])
        .select(*of, F.explode_outer(F.flatten(F.transform("wanted", lambda want: F.transform(want["starts"], window(want))))).alias("w"))
        .select(*of, "w.*")
        .dropDuplicates([*of, "size", "start", "window"])
        .withColumn("shingles", F.when(F.size("window") < SHINGLE, whole).otherwise(F.col("shingles")))
        .withColumn("fingerprint", simhash("shingles"))
    )

    flips = [0] + [sum(1 << i for i in c) for n in range(1, FLIPS + 1) for c in combinations(range(_BITS), n)]
    flip = spark.createDataFrame([(f,) for f in flips], "flip long")
    listed = None
    for b in range(BLOCKS):
        part = items.select("item_id", "size", F.lit(b).alias("block"), _block("fingerprint", b).alias("value"), F.col("fingerprint").alias("item_fingerprint"))
        listed = part if listed is None else listed.union(part)
    index = listed.crossJoin(F.broadcast(flip)).withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")  # a fixed number of rows for each item
    cut = windows.select(*of, "size", "start", "window", "fingerprint", F.posexplode(F.array(*[_block("fingerprint", b) for b in range(BLOCKS)])).alias("block", "value"))
    met = (
        cut.join(index, ["size", "block", "value"])
        .withColumn("hamming", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))))
        .filter(F.col("hamming") <= RADIUS)
        .dropDuplicates([*of, "item_id", "start", "window"])
    )
    verified = (
        met.join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
        .withColumn("similarity", similarity(_texts("window"), _texts("item_words")))
        .filter(F.col("similarity") >= least_similarity)
    )
    best = F.max(F.struct("similarity", -F.col("start"), F.size("window").alias("n"), "hamming"))
    return verified.groupBy(*of, "item_id").agg(best.alias("b")).select(*of, "item_id", (-F.col("b.col2")).alias("start_word"), F.col("b.n").alias("n_words"), "b.hamming", "b.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, least_similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = _found(docs, benchmark, least_similarity).select(F.col("doc_id").alias("leak_id"), F.col("mark").alias("leak_mark")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), _digest("text").alias("mark"))
    same = F.col("key").eqNullSafe(F.col("leak_id")) & (F.col("mark") == F.col("leak_mark"))
    return held.join(found, same, "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
