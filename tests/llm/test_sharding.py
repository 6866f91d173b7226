import zlib
from collections import defaultdict

from panelloom.llm.sharding import sharded


def test_equal_bytes_and_gapless_slots(spark):
    texts = [("hot " * 5 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(3000)]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(7)
    got = sharded(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    sizes, slots, shards = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shards[texts[r.doc_id]].add(r.shard)
    assert set(sizes) == set(range(16))
    mean = sum(sizes.values()) / 16
    assert max(abs(s - mean) for s in sizes.values()) <= 2 * max(len(t) + 1 for t in texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in shards.items() if not t.startswith("hot"))


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a"), (3, "é" * 100000)]
    got = sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 2, 200001]
    assert len({(r.shard, r.slot) for r in got}) == 5
    assert sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain(rows, keys, shards, snap=0.01):
    """The law in plain Python: rows in the order of their text's hash, the middle of a row decides, and a small group that a cut would
    split moves to its first row's shard. Gives the shard of each row of the order."""
    laid = sorted(rows, key=lambda r: (keys[r[1]], r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1))
    size = [len((t or "").encode()) + 1 for _, t in laid]
    target, start, shard = max(1.0, sum(size) / shards), 0, []
    for s in size:
        shard.append(min(int((start + s / 2) / target), shards - 1))
        start += s
    of = defaultdict(list)
    for i, (_, t) in enumerate(laid):
        of[keys[t]].append(i)
    for held in of.values():
        if len({shard[i] for i in held}) > 1 and sum(size[i] for i in held) <= snap * target:
            first = min(shard[i] for i in held)
            for i in held:
                shard[i] = first
    return laid, shard


def test_against_the_law_in_plain_python(spark):
    from pyspark.sql import functions as F

    texts = [None, "", "é" * 700, *(("hot text " * 30 if i % 3 == 0 else f"text {i % 400} " * (1 + i % 17)) for i in range(1500))]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keys = {r.text: r.k for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("k")).distinct().collect()}
    for shards, snap in ((16, 0.01), (5, 0.2)):
        got = sharded(docs, shards, snap).collect()
        laid, shard = plain(rows, keys, shards, snap)
        row = lambda d, t, s: (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s)
        assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in got) == sorted(row(d, t, s) for (d, t), s in zip(laid, shard, strict=True))
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
