"""N-gram Jaccard join by groups of equal prefixes, and the components of its links.

A document's set holds its distinct shingles of ``n`` words as 64-bit hashes; words are runs without
ASCII white space, A-Z lower-cased; fewer words make one shingle. Two documents link if
``100 * intersection >= percent * union``.

1. Documents with equal sets form a class; one text, known by its digest, stands for all.
2. Shingles are ordered by how often their hash's first ``SLOT_BITS`` bits are met in the whole corpus,
   rare ones first, then by hash. Sets that link share a shingle among the first
   ``size - ceil(t * size) + 1``, and for a partner of known size among the first ``size - needed + 1``.
3. Classes with the same size and the same prefix form a group. Groups meet on a shingle of both
   prefixes, but only where the partner's size lies in a band that the shingle's place still allows.
4. First each group is compared with ``LEADERS`` others, those it shares most shingles with among the holders
   in whose order each shingle comes first. That links a large group of near copies to its centre, in a star.
5. Then groups of different components that still meet are expanded to members. Pairs inside a component could add no document to it; a
   shingle held by one component makes no pair. Each text has a sketch, one bit of parity for each slot that its shingles' hashes fall into,
   about as many as it has shingles: where two sketches differ in more bits than sets that link can differ in shingles, the pair can't link,
   whatever shingles it shares. What templates make of frequent shingles ends here, without loss; all the rest is verified.

A null or empty text, or one without words, has an empty set, stands alone and links with nothing.
Rows with one doc_id and different texts are documents of their own that share that id; repeated rows
are one class. A null doc_id gets a null component unless it links. Very long texts are handled whole.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import durable, slices
from panelloom.llm.components import components

BLOCK, REMEMBERED = 4_000_000, 400_000
#: Bits of the table of counts (two bytes for each slot, whatever the corpus holds), and slots that travel in one row.
SLOT_BITS, CHUNK_BITS = 23, 13
#: Texts that are fetched by a broadcast of their digests; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Leaders that each group is compared with before components are compared; ratio of sizes in one band.
LEADERS, BAND = 3, 1.1
_WORDS: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of n words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    get = _WORDS.get
    h = np.array([get(w) or _WORDS.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in words], np.uint64)
    k = min(n, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = (total ^ (total >> np.uint64(29))) * _M1 + h[i : len(h) - k + 1 + i]
    total = (total ^ (total >> np.uint64(32))) * _M2
    return np.unique(total ^ (total >> np.uint64(31)))


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each slot of the hashes' last bits: whether an odd number of them falls into it. As many slots as hashes, or more, by powers of two."""
    slots = max(64, 1 << int(len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For pairs of sketches: in how many shingles the sets differ at least. A larger sketch is folded; parities of folded slots add up."""
    found, by = np.zeros(len(a), np.int64), {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        by.setdefault((len(x), len(y)), []).append(i)
    for sizes, at in by.items():
        x, y = (np.frombuffer(b"".join(z[i] for i in at), np.uint64).reshape(len(at), -1) for z in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        found[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return found


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b with sizes and sketches, those that may link: sets whose sketches don't differ in more than they may themselves."""

    def run(batches):
        for batch in batches:
            a, b, sx, sy, x, y = batch.columns
            for i, j in slices([2 * len(z) for z in x.to_pylist()], BLOCK):
                both = (sx.slice(i, j - i).to_numpy() + sy.slice(i, j - i).to_numpy()).astype(np.int64)
                most = both - 2 * -(-both * percent // (100 + percent))
                keep = pa.array(least_difference(x.slice(i, j - i).to_pylist(), y.slice(i, j - i).to_pylist()) <= most)
                yield pa.RecordBatch.from_arrays([a.slice(i, j - i).filter(keep), b.slice(i, j - i).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "sx", "sy", "sketch_x", "sketch_y").mapInArrow(run, "a binary, b binary")


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _texts(batches: Iterator[pa.RecordBatch]):
    """Pieces of a batch: its columns but the last, and the texts in that."""
    for batch in batches:
        *others, text = batch.columns
        text = text.cast(pa.binary())
        sizes = [0 if x is None else x for x in pa.compute.binary_length(text).to_pylist()]
        for a, b in slices(sizes, BLOCK):
            yield [c.slice(a, b - a) for c in others], text.slice(a, b - a).to_pylist()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a digest of the text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("mark"), "text")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """In one pass: rows with doc_id, mark, n_shingles and ``digest``, a hash of the set (16 bytes), and rows
    with ``chunk``, ``at`` and ``times``: places and counts of the slots that a task's sets meet."""
    kinds = {"doc_id": pa.int64(), "mark": pa.binary(), "n_shingles": pa.int64(), "digest": pa.binary(), "chunk": pa.int32(), "at": pa.binary(), "times": pa.binary()}

    def table(k, **columns):
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(k, t) for c, t in kinds.items()], list(kinds))

    def run(batches):
        held, rows, seen, counts = [], 0, set(), np.zeros(1 << SLOT_BITS, np.uint32)

        def count():
            if held:
                slots, times = np.unique((np.concatenate(held) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32), return_counts=True)
                counts[slots] += times.astype(np.uint32)

        for (doc_id, mark), texts in _texts(batches):
            sets = [shingle_hashes(t, n) for t in texts]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield table(doc_id=doc_id, mark=mark, n_shingles=pa.array([len(s) for s in sets], pa.int64()), digest=pa.array(digest, pa.binary()), k=len(sets))
            for s, d in zip(sets, digest, strict=True):
                if len(s) and d not in seen:
                    seen.add(d)
                    held.append(s)
                    rows += len(s)
            if rows > 4_000_000:
                count()
                held, rows, seen = [], 0, set()
        count()
        for chunk, part in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
            at = np.flatnonzero(part)
            if len(at):
                # gaps and counts are mostly small, so they pack well
                gaps, times = np.diff(at, prepend=0).astype("<u2"), np.minimum(part[at], 65535).astype("<u2")
                yield table(chunk=pa.array([chunk], pa.int32()), at=pa.array([zlib.compress(gaps.tobytes(), 1)], pa.binary()), times=pa.array([zlib.compress(times.tobytes(), 1)], pa.binary()), k=1)

    return docs.mapInArrow(run, "doc_id long, mark binary, n_shingles long, digest binary, chunk int, at binary, times binary")


def commonness(counted: DataFrame) -> np.ndarray:
    """How often each slot is met in all tasks, 65535 at most. Its size doesn't depend on the corpus."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk not in sums:
                    sums[chunk] = np.zeros(1 << CHUNK_BITS, np.int64)
                sums[chunk][np.cumsum(np.frombuffer(zlib.decompress(at), "<u2"))] += np.frombuffer(zlib.decompress(times), "<u2")
        data = [np.minimum(x, 65535).astype("<u2").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["chunk", "times"])

    parts = min(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << (SLOT_BITS - CHUNK_BITS))
    found = np.zeros((1 << (SLOT_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint16)
    for r in counted.select("chunk", "at", "times").repartition(parts, "chunk").mapInArrow(run, "chunk int, times binary").collect():
        found[r.chunk] = np.frombuffer(r.times, "<u2")
    return found.ravel()


def _prefixes(docs: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """For each text: rep, size, prefix (array of long, in the global order), ``group``, a digest of size and prefix, and ``sketch``."""
    sent = docs.sparkSession.sparkContext.broadcast(common)  # two bytes for each slot

    def run(batches):
        common = sent.value
        for (rep,), texts in _texts(batches):
            prefixes, sizes, sketches = [], [], []
            for t in texts:
                s = shingle_hashes(t, n)
                sketches.append(parities(s))
                p = prefix_length(len(s), percent) if len(s) else 0
                # sets are sorted by hash, so a stable sort by count leaves equal counts in that order
                prefixes.append(s[np.argsort(common[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], kind="stable")[:p]])
                sizes.append(len(s))
            offsets = np.append(0, np.cumsum([len(x) for x in prefixes])).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            group = [xxhash.xxh3_128_digest(x.tobytes(), seed=z) for x, z in zip(prefixes, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rep, pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))), pa.array(group, pa.binary()), pa.array(sketches, pa.binary())],
                ["rep", "size", "prefix", "group", "sketch"],
            )

    return docs.select("mark", "text").mapInArrow(run, "rep binary, size int, prefix array<long>, group binary, sketch binary")


def _sets_of(texts: DataFrame, n: int, kind: str) -> DataFrame:
    """rep and set of each text, as long or int, once for each task that holds copies of it."""
    of = np.int64 if kind == "long" else np.int32

    def run(batches):
        seen: set[bytes] = set()
        for (rep,), block in _texts(batches):
            names, sets = [], []
            for mark, text in zip(rep.to_pylist(), block, strict=True):
                if mark not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(mark)
                    names.append(mark)
                    sets.append(shingle_hashes(text, n).view(np.int64).astype(of))
            if names:
                offsets = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["rep", "set"])

    return texts.mapInArrow(run, f"rep binary, set array<{kind}>")


def _needed(x: str, y: str, percent: int):
    """Least intersection of sets of these sizes that link."""
    return F.ceil((F.col(x) + F.col(y)) * percent / (100 + percent) - 1e-9)


def _met(x: str, y: str, percent: int):
    """Least number of shared prefix shingles of sets that link.

    Of the two prefixes one ends first in the order. What both sets share up to there is in both
    prefixes, and beyond it that set has ``ceil(t * size) - 1`` shingles.
    """
    rest = lambda c: F.ceil(F.col(c) * percent / 100 - 1e-9) - 1
    return _needed(x, y, percent) - F.greatest(rest(x), rest(y))


def _band(size):
    return F.floor(F.log(size) / math.log(BAND)).cast("int")


def _verified(pairs: DataFrame, keyed: DataFrame, n: int, percent: int, kind: str = "long") -> DataFrame:
    """The pairs (a, b) of texts that link, by their whole sets.

    With ``kind`` int only the last half of each hash moves. Then pairs are left out that can't link even if each
    value that a set holds twice were common; the others are to be verified by their whole hashes.
    """
    pairs = durable(pairs)
    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    few = wanted.count() <= BROADCAST
    texts = keyed.join(F.broadcast(wanted) if few else wanted, F.col("mark") == F.col("rep"), "left_semi").select(F.col("mark").alias("rep"), "text")
    sets = _sets_of(texts, n, kind).dropDuplicates(["rep"])  # the exchange for this serves the join, too
    left, right = (sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    if kind == "int":
        common += F.size("set_a") - F.size(F.array_distinct("set_a"))
    linked = 100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)
    return durable(pairs.join(left, "a").join(right, "b").filter(linked).select("a", "b"))


def _stars(held: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts: each member of a group with the first of the groups that lead it, and with the first of its own group."""
    one = lambda *first: F.min(F.struct(*first, "size", "g"))
    leaders = held.groupBy("token").agg(one("place").alias("p"), one(F.xxhash64("g")).alias("q")).select("token", F.array_distinct(F.array(F.struct("p.g", "p.size"), F.struct("q.g", "q.size"))).alias("leads"))
    led = held.join(leaders, "token").select("g", "size", F.explode("leads").alias("lead")).select("g", "size", F.col("lead.g").alias("b"), F.col("lead.size").alias("b_size")).filter("g <> b")
    led = led.groupBy("g", "b").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("b_size").alias("b_size"))
    # Groups that share too few of the shingles that the other leads can't follow it.
    led = led.filter((F.least("size", "b_size") * 100 >= F.greatest("size", "b_size") * percent) & (2 * F.col("n") >= _met("size", "b_size", percent)))
    best = led.groupBy("g").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", F.col("b"))), asc=False), 1, LEADERS).alias("m")).select("g", F.explode("m.b").alias("b"))
    first = members.groupBy("g").agg(F.min("rep").alias("lead"))
    led = members.join(best, "g").select("rep", F.col("b").alias("g")).union(members.select("rep", "g"))
    return led.join(first, "g").select(F.col("rep").alias("a"), F.col("lead").alias("b")).filter("a <> b").distinct()


def _between(held: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts of different components that may link: all whose groups meet at places that allow it."""
    spread = held.join(label.select("g", "component").distinct(), "g")
    # Shingles of one component, as large groups of copies make them, end here.
    several = spread.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("token")
    spread = durable(spread.join(several, "token", "left_semi"))
    # The smaller of two sets needs the shingle as early as for a partner of its own size.
    own = spread.filter(F.col("size") - F.col("place") >= _needed("size", "size", percent)).withColumn("band", _band(F.col("size")))
    # The larger of two sets looks for sizes from t * size to its own, if the shingle is early enough: size - place >= needed(size, other).
    most = F.floor((F.col("size") - F.col("place")) * (100 + percent) / percent - F.col("size") + 1e-9)
    least = F.ceil(F.col("size") * percent / 100 - 1e-9)
    seeking = spread.withColumn("most", F.least("size", most)).filter(F.col("most") >= least).withColumn("band", F.explode(F.sequence(_band(least), _band(F.col("most")))))
    y = own.select("token", "band", F.col("component").alias("cy")).distinct()
    left = seeking.select("token", "band", F.col("component").alias("cx"), F.col("g").alias("gx"), F.col("size").alias("sx"), F.col("place").alias("px"))
    right = own.select("token", "band", F.col("component").alias("cy"), F.col("g").alias("gy"), F.col("size").alias("sy"), F.col("place").alias("py"))
    left = durable(left.join(y.groupBy("token", "band").agg(F.min("cy").alias("c1"), F.max("cy").alias("c2")), ["token", "band"]).filter("cx <> c1 OR cx <> c2").drop("c1", "c2"))
    crossed = left.select("token", "band", "cx").distinct().join(y, ["token", "band"]).filter("cx <> cy")
    may = ((F.col("sy") < F.col("sx")) | (F.col("sy") == F.col("sx")) & (F.col("gy") <= F.col("gx"))) & (F.col("sy") * 100 >= F.col("sx") * percent) & (F.col("sx") - F.col("px") >= _needed("sx", "sy", percent)) & (F.col("sy") - F.col("py") >= _needed("sx", "sy", percent))
    met = crossed.join(left, ["token", "band", "cx"]).join(right, ["token", "band", "cy"]).filter(may)
    # What both share besides the shingles met so far comes after the last of those in both.
    bound = F.count("*") + F.least(F.first("sx") - F.max("px"), F.first("sy") - F.max("py")) - 1
    pairs = met.groupBy("gx", "gy", "cx", "cy").agg(bound.alias("bound"), F.first("sx").alias("sx"), F.first("sy").alias("sy")).filter(F.col("bound") >= _needed("sx", "sy", percent))
    a, b = (label.select(F.col("g").alias(f"g{k}"), F.col("component").alias(f"c{k}"), F.col("rep").alias(r), F.col("sketch").alias(f"sketch_{k}")) for k, r in (("x", "a"), ("y", "b")))
    found = _alike(pairs.join(a, ["gx", "cx"]).join(b, ["gy", "cy"]), percent)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, class_id and component_id for each document, and ``component``, a digest that names it."""
    keyed = _keyed(docs)
    read = durable(shingle_sets(keyed, n))
    marked = read.filter("digest IS NOT NULL").select("doc_id", "mark", "n_shingles", "digest")
    classes = durable(marked.filter("n_shingles > 0").groupBy("digest").agg(F.min("mark").alias("rep"), F.min("doc_id").alias("class_id")))

    prefixes = _prefixes(keyed.filter("text IS NOT NULL"), n, percent, commonness(read.filter("chunk IS NOT NULL")))
    prefixes = durable(prefixes.join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]))
    # A group is known by 64 bits of its digest further on; should two share them, both are expanded and verified.
    members = prefixes.select("rep", F.xxhash64("group").alias("g"), "size")
    sketches = prefixes.select(F.col("rep").alias("node"), "sketch")
    groups = prefixes.groupBy("group").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.count("*").alias("reps"))
    # Dealt by shingle once; what follows by shingle needs no other exchange.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    holders = groups.select(F.xxhash64("group").alias("g"), "size", (F.col("reps") > 1).alias("several"), F.posexplode("prefix").alias("place", "token")).repartition(parts, "token")
    same = Window.partitionBy("token")  # over the one exchange; rows of a frequent shingle spill
    over = {"n": F.count("*"), "any": F.max("several"), "s1": F.min("size"), "s2": F.max("size"), "room": F.min(F.col("size") - F.col("place"))}
    met = holders.withColumns({c: x.over(same) for c, x in over.items()})
    # Of two groups alone with a shingle it's known at once whether it can be the first that they share.
    early = (F.col("n") > 2) | F.col("any") | (F.col("s1") * 100 >= F.col("s2") * percent) & (F.col("room") >= _needed("s1", "s2", percent))
    held = durable(met.filter("n > 1 OR any").select("token", "g", "size", "place", early.alias("early")))

    found = components(_verified(_stars(held, members, percent), keyed, n, percent))
    label = durable(members.join(found, F.col("rep") == F.col("node"), "left").select("rep", "g", "size", F.coalesce("component", "rep").alias("component")))
    sketched = label.join(sketches, F.col("rep") == F.col("node")).drop("node")
    more = _verified(_verified(_between(held.filter("early"), sketched, percent), keyed, n, percent, "int"), keyed, n, percent)
    of = lambda c: label.select(F.col("rep").alias(c), F.col("component").alias(f"c{c}"))
    joined = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    # Equal sets need no link: their class stands for them.
    final = label.select("rep", "component").join(joined.withColumnRenamed("component", "whole"), F.col("component") == F.col("node"), "left").select(F.col("rep").alias("node"), F.coalesce("whole", "component").alias("component"))
    of = durable(classes.join(final, F.col("rep") == F.col("node")).select(F.col("digest").alias("d"), "class_id", "component"))
    least = of.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of = of.join(least, "component")
    whole = marked.join(of, (F.col("digest") == F.col("d")) & (F.col("n_shingles") > 0), "left")
    alone = lambda c: F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return whole.select("doc_id", "mark", "n_shingles", alone("class_id"), alone("component_id"), "component")


def linked(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id (the smallest doc_id with the same set) and component_id for each document."""
    return _linked(docs, n, percent).select("doc_id", "n_shingles", "class_id", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, null after all others; of rows with one doc_id, the
    smallest digest of the text; of equal rows any. Empty texts all stay."""
    found = durable(_linked(docs, n, percent).filter(F.col("component").isNotNull()).select("component", "doc_id", "mark"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    kept = found.groupBy("component").agg(F.min(place).alias("p"), F.count("*").alias("n")).filter("n > 1").select("component", "p")
    met = found.join(kept, "component").withColumn("stays", place.eqNullSafe(F.col("p")))
    counted = durable(met.groupBy("doc_id", "mark", "stays").count().select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "stays", (F.col("count") > 1).alias("several")).filter("NOT stays OR several"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"), F.unhex(F.md5("text")).alias("mark"))
    few = counted.count() <= BROADCAST
    same = F.col("key").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))
    rest = held.join(F.broadcast(counted) if few else counted, same, "left_anti")
    again = counted.filter("stays")
    once = held.join(F.broadcast(again) if few else again, same, "left_semi").dropDuplicates(["key", "mark"])
    return rest.union(once).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
