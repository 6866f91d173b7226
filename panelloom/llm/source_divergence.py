"""How far the sources of a language use its words apart: exact integer divergences of every pair, and each source's own words.

A term is a run of letters of A-Z, a-z and of characters beyond ASCII; only A-Z is lower-cased. Each part (language) keeps the terms that
at least ``least`` of its documents hold. With V kept terms and N of their occurrences in a group, a term met
``count`` times has the price ``1 + floor(10^9 (count + 1) / (N + V))``; prices of one group differ from those of another by
``floor((p - q)^2 / q)`` a term.

1. Tasks count terms and documents of their texts by group; one exchange by part and term adds them up.
2. Kept terms of a part are dealt into blocks of about ``TERMS`` by hash, numbered in order within each, and every group gets
   one sorted array of term numbers and counts for each block, maybe an empty one.
3. Two groups' arrays of a block meet for each unordered pair: the shorter array gallops through the longer one, and terms of both, of
   one only and of neither are priced both ways. Sums of blocks make the pair. So a task holds two arrays of a block at a time, however
   many terms a group has.

The arithmetic is in 64-bit integers: prices sum to 10^9 + V at most, so no sum of squares passes 2.1 * 10^18 while V
is under 10^7, and quotients are taken by long division, so that no product overflows while N + V is under 9 * 10^15.

Null texts, parts and groups are empty strings. A group without kept terms has the same price for each; a part without them gives
pairs of value 0 and no terms. Repeated rows are documents of their own. Other columns aren't read. An empty table gives an empty result.
Very long texts are counted whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import durable, slices

#: Kept terms in a block, about; entries that a counting task holds; groups whose totals are sent to every task, beyond which they are joined.
TERMS, HELD, BROADCAST = 2048, 300_000, 20_000
#: Prices are shares of this, in three steps of long division.
UNIT, STEP, STEPS = 10**9, 1000, 3
#: Lower case for A-Z, a space for the rest of ASCII but a-z.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame, part: str = "lang", group: str = "source") -> DataFrame:
    """(part, source, term, n, docs): occurrences and documents as tasks have counted them; a row with a null term for each group of a task."""
    names = ["part", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def sent(times: dict, within: dict) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (p, g), counted in times.items():
            k, held = len(counted) + 1, within[p, g]
            columns[0] += [p] * k
            columns[1] += [g] * k
            columns[2] += [None, *counted]
            columns[3] += [0, *counted.values()]
            columns[4] += [0, *map(held.__getitem__, counted)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, within = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            text = batch.column(2).cast(pa.binary())
            sizes = pa.compute.binary_length(text).to_pylist()
            for a, b in slices(sizes, 2_000_000):
                for p, g, t in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1)), text.slice(a, b - a).to_pylist(), strict=True):
                    found = terms(t)
                    times[p, g].update(found)
                    within[p, g].update(set(found))
                if sum(map(len, times.values())) > HELD:
                    yield sent(times, within)
                    times.clear()
                    within.clear()
        yield sent(times, within)

    held = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((part, "part"), (group, "source"), ("text", "text"))])
    return held.mapInArrow(run, "part string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def kept_counts(docs: DataFrame, least: int = 3, part: str = "lang", group: str = "source") -> DataFrame:
    """(part, source, term, n, of_part, first) of the kept terms of each group: occurrences there, and in the whole part; one row of a
    term is its first. Each group also has a row with a null term."""
    counted = term_counts(docs, part, group)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by part and term once: neither the sums by group nor the window over the term's groups need another exchange.
    summed = counted.repartition(parts, "part", "term").groupBy("part", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("part", "term")
    over = summed.withColumns({"of_part": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "at": F.row_number().over(term.orderBy("source"))})
    return over.filter(F.col("term").isNull() | (F.col("in_docs") >= least)).select("part", "source", "term", "n", "of_part", (F.col("term").isNotNull() & (F.col("at") == 1)).alias("first"))


def price(count: str, total: str) -> Column:
    """``1 + floor(UNIT (count + 1) / total)`` by long division."""
    whole, rest = F.expr(f"({count} + 1) div ({total})"), F.expr(f"({count} + 1) % ({total})")
    for _ in range(STEPS):
        rest = rest * STEP
        whole, rest = whole * STEP + F.call_function("div", rest, F.expr(total)), rest % F.expr(total)
    return whole + 1


def prices(count: np.ndarray, total: int) -> np.ndarray:
    """As ``price``, for an array of counts."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(STEPS):
        step, rest = np.divmod(rest * STEP, total)
        whole = whole * STEP + step
    return whole + 1


def apart(p, q):
    """What a term of price p says against one of price q."""
    return (p - q) * (p - q) // q


def gallop(long: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place of ``long`` that isn't less, for each of ``wanted``; both sorted. From a guess by proportion each
    search doubles its step until it has passed the place, then halves what is left, all of them at once."""
    n = len(long)
    if not n or not len(wanted):
        return np.zeros(len(wanted), np.int64)
    span = max(1, int(long[-1]) - int(long[0]))
    guess = np.clip((wanted.astype(np.int64) - int(long[0])) * (n - 1) // span, 0, n - 1)
    up = long[guess] < wanted
    low, high = np.where(up, guess + 1, 0), np.where(up, n, guess)  # the place lies in low .. high
    step, open_ = 1, np.arange(len(wanted))
    while len(open_):
        g, w, u = guess[open_], wanted[open_], up[open_]
        probe = np.where(u, g + step, g - step)
        inside = (probe >= 0) & (probe < n)
        open_, probe, w, u = open_[inside], probe[inside], w[inside], u[inside]
        less = long[probe] < w
        low[open_[less]] = probe[less] + 1
        high[open_[~less]] = probe[~less]
        open_ = open_[less == u]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < wanted[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def merged(ids_a: np.ndarray, n_a: np.ndarray, total_a: int, ids_b: np.ndarray, n_b: np.ndarray, total_b: int) -> tuple[int, int, int]:
    """Of two groups' sorted terms of a block: what a says against b and b against a over terms that either has, and how many those are."""
    if len(ids_a) > len(ids_b):
        back, forth, n = merged(ids_b, n_b, total_b, ids_a, n_a, total_a)
        return forth, back, n
    at = gallop(ids_b, ids_a)
    both = np.zeros(len(ids_a), bool)
    inside = at < len(ids_b)
    both[inside] = ids_b[at[inside]] == ids_a[inside]
    p, q = prices(n_a, total_a), prices(n_b, total_b)
    zero = np.zeros(1, np.int64)
    p0, q0 = prices(zero, total_a)[0], prices(zero, total_b)[0]
    alone = np.ones(len(ids_b), bool)
    alone[at[both]] = False
    x, y, one, other = p[both], q[at[both]], p[~both], q[alone]
    forth = apart(x, y).sum() + apart(one, q0).sum() + apart(p0, other).sum()
    back = apart(y, x).sum() + apart(q0, one).sum() + apart(other, p0).sum()
    return int(forth), int(back), len(ids_a) + len(other)


def _blocks(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(part, block, source, total, ids, counts): each group's sorted arrays, one for every block of its part."""
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("int")
    sized = totals.select("part", many.alias("blocks")).distinct()
    sized = F.broadcast(sized) if totals.count() <= BROADCAST else sized
    held = kept.filter("term IS NOT NULL").join(sized, "part").select("part", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n")
    empty = totals.select("part", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    number = F.dense_rank().over(Window.partitionBy("part", "block").orderBy("term"))
    both = held.unionByName(empty).repartition(parts, "part", "block").withColumn("id", number)
    pairs = F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("id", "n"))))
    return both.groupBy("part", "block", "source").agg(pairs.alias("t")).select("part", "block", "source", F.col("t.id").alias("ids"), F.col("t.n").alias("counts"))


def pair_divergences(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(part, source, item, value) for every ordered pair of a part's groups: ``apart`` summed over all kept terms, absent ones too."""
    few = totals.count() <= BROADCAST
    sized = totals.select("part", "source", "total", "v")
    blocks = durable(_blocks(kept, totals).join(F.broadcast(sized) if few else sized, ["part", "source"]))
    a, b = (blocks.select("part", "block", "v", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "total", "ids", "counts")]) for x in "ab")
    met = a.join(b.drop("v"), ["part", "block"]).filter("source_a < source_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            arrays = []
            for n in ("ids_a", "counts_a", "ids_b", "counts_b"):
                offsets = column[n].offsets.to_numpy()
                arrays.append((column[n].values.to_numpy(zero_copy_only=False), offsets))
            totals_a, totals_b = (column[n].to_numpy() for n in ("total_a", "total_b"))
            found = []
            for i in range(batch.num_rows):
                ids_a, n_a, ids_b, n_b = (values[o[i] : o[i + 1]] for values, o in arrays)
                found.append(merged(ids_a, n_a, int(totals_a[i]), ids_b, n_b, int(totals_b[i])) if len(ids_a) or len(ids_b) else (0, 0, 0))
            sums = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(column[n] for n in ("part", "source_a", "source_b")), *sums], ["part", "source_a", "source_b", "forth", "back", "met"])

    summed = met.select("part", "source_a", "source_b", "total_a", "total_b", "ids_a", "counts_a", "ids_b", "counts_b").mapInArrow(run, "part string, source_a string, source_b string, forth long, back long, met long")
    summed = summed.groupBy("part", "source_a", "source_b").agg(*[F.sum(c).alias(c) for c in ("forth", "back", "met")])
    of = lambda x: sized.select("part", F.col("source").alias(f"source_{x}"), F.col("total").alias(f"total_{x}"), *["v"] * (x == "a"))
    for x in "ab":
        summed = summed.join(F.broadcast(of(x)) if few else of(x), ["part", f"source_{x}"])
    none = lambda x: F.when(F.col("v") > 0, price("0", f"nullif(total_{x}, 0)")).otherwise(F.lit(1))
    summed = summed.withColumns({"p0": none("a"), "q0": none("b"), "absent": F.col("v") - F.col("met")})
    value = lambda known, p, q: F.expr(f"{known} + absent * (({p} - {q}) * ({p} - {q}) div {q})")
    ways = F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), value("forth", "p0", "q0").alias("value")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), value("back", "q0", "p0").alias("value")),
    )
    return summed.select("part", F.explode(ways).alias("w")).select("part", "w.source", "w.item", "w.value")


def own_terms(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(part, source, item, value) of each kept term that a group has at a higher price than its part."""
    few = totals.count() <= BROADCAST
    sized = totals.select("part", "source", "total", "part_total")
    held = kept.filter("term IS NOT NULL AND n > 0").join(F.broadcast(sized) if few else sized, ["part", "source"])
    held = held.withColumns({"p": price("n", "total"), "q": price("of_part", "part_total")}).filter("p > q")
    return held.select("part", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))


def divergences(docs: DataFrame, least: int = 3, ranks: int = 200, part: str = "lang", group: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows rank the other groups of a part, ``term`` rows the first ``ranks`` of a
    group's own terms; by falling value, then by item."""
    kept = durable(kept_counts(docs, least, part, group))
    groups = kept.groupBy("part", "source").agg(F.sum("n").alias("n"))
    of_part = kept.groupBy("part").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("part_n"))
    totals = durable(groups.join(of_part, "part").select("part", "source", "v", (F.col("n") + F.col("v")).alias("total"), (F.col("part_n") + F.col("v")).alias("part_total")))
    rank = F.row_number().over(Window.partitionBy("part", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_divergences(kept, totals).withColumn("rank", rank).withColumn("kind", F.lit("pair"))
    own = own_terms(kept, totals).withColumn("rank", rank).filter(F.col("rank") <= ranks).withColumn("kind", F.lit("term"))
    return pairs.unionByName(own).select(F.col("part").alias("lang"), "source", F.col("kind").alias("part"), "item", "value", "rank")


#: ``divergences`` for DuckDB.
SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
t AS (
  SELECT lang, source, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS of_part FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(of_part)::HUGEINT AS total FROM kept GROUP BY lang),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (g.total + l.v) AS p, 1 + (1000000000::HUGEINT * (of_part + 1)) // (l.total + l.v) AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
