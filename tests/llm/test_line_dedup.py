import random

import duckdb
import pytest

from panelloom.llm import line_dedup


def table(seed=7):
    pick = random.Random(seed)
    lines = [f"line {i} of some length" for i in range(60)] + ["", "  "]
    passage = [f"shared {i}" for i in range(14)]
    rows = []
    for i in range(200):
        text = [pick.choice(lines) for _ in range(pick.randint(1, 30))]
        if i % 3 == 0:
            at = pick.randint(0, len(text))
            text[at:at] = passage
        rows.append((i, "\n".join(text)))
    return rows + [(900, rows[0][1]), (901, None), (902, ""), (903, "\n\n\n\n\n"), (904, "\n\n\n\n\n"), (905, "a\nb"), (906, "a\nb"), (907, "z\n" * 20000)]


def test_passages_against_sql(spark):
    import pandas as pd

    rows = [*table(), (908, "a\n\nb\nc"), (909, "x\na\n\nb"), (910, "a\nb\na\nb\na")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(line_dedup.PASSAGE_SQL)
    got = line_dedup.passage_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_shared_passage_goes_once_and_borders_resist_shifts(spark):
    rows = table()
    kept = {r.doc_id: r.text for r in line_dedup.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(kept[900]) < len(rows[0][1]) / 2  # an exact copy of document 0
    whole = sum("\n".join(f"shared {i}" for i in range(4, 12)) in (t or "") for t in kept.values())
    assert whole == 1 and kept[0] == rows[0][1]
    assert kept[901] is None and kept[902] == "" and kept[905] == "a\nb"


def test_borders_depend_on_lines_inside_alone(spark):
    """A passage's own chunks are the same whatever surrounds it, and an inserted line changes only chunks about it."""
    passage = [f"line {i} of the passage" for i in range(40)]
    texts = ["\n".join(passage), "\n".join(["x", "y", *passage, "z"]), "\n".join([*passage[:20], "new", *passage[20:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {k: {r.chunk for r in line_dedup.chunks(docs, with_text=True).collect() if r.doc_id == k} for k in range(3)}
    assert found[0] <= found[1] and all("new" in c or c in found[0] for c in found[2])
    assert len(found[0] - found[2]) <= line_dedup.MOST * 2
    lengths = [c.count("\n") + 1 for c in found[0]]
    assert min(lengths) == 2 and 2 < max(lengths) <= line_dedup.MOST
    # every pair of neighbours is a chunk, and there are at most two chunks for a line
    assert all(f"{a}\n{b}" in found[0] for a, b in zip(passage, passage[1:])) and len(lengths) < 80


def test_a_shared_hash_is_no_repetition(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (3, "a\nb")], "doc_id long, text string")
    whole = line_dedup.chunks
    monkeypatch.setattr(line_dedup, "chunks", lambda *a, **k: whole(*a, **k).withColumn("high", F.lit(0)).withColumn("low", F.lit(0)))
    assert sorted(r.text for r in line_dedup.without_passages(docs).collect()) == ["", "a\nb", "c\nd"]


def test_more_repeated_hashes_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST", 0)
    rows = [r for r in table() if r[0] != 907]
    assert {r.doc_id: r.text for r in line_dedup.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_other_columns_pass_and_may_clash(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "x", 3), (2, "a\nb\nc", "y", None)], "doc_id long, text string, lines string, k int")
    got = line_dedup.without_passages(docs)
    assert got.columns == ["doc_id", "text", "lines", "k", "line_dedup"] and got.count() == 2
    assert line_dedup.passage_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [1, None])
def test_rows_with_one_doc_id_are_one_document(spark, doc_id):
    docs = spark.createDataFrame([(doc_id, "p\nq\nr\ns")] * 2, "doc_id long, text string")
    assert {r.text for r in line_dedup.without_passages(docs).collect()} == {"p\nq\nr\ns"}


def test_one_doc_id_with_different_texts(spark):
    """Chunks that one of the texts loses don't go from the other."""
    rows = [(0, "a\nb"), (1, "a\nb"), (1, "unique\nlines here"), (None, "a\nb"), (None, "other\nlines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # null comes first in the order of doc_ids, as it does for Spark's min
    assert sorted(((str(r.doc_id), r.text) for r in line_dedup.without_passages(docs).collect())) == sorted([("0", ""), ("1", ""), ("1", "unique\nlines here"), ("None", "a\nb"), ("None", "other\nlines")])


def brute(rows):
    """Line by line: windows between neighbouring full lines, in order of doc_id and place."""
    first, kept = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for i, j in zip(full, full[1:]):
            at, end = first.setdefault("\n".join(lines[i : j + 1]), ((doc_id, i), j))
            if at[0] != doc_id or i > end:
                gone |= set(range(i, j + 1))
        kept[doc_id] = text and "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return kept


def test_no_passage_is_missed(spark):
    """Passages of 2 to 10 lines in foreign surroundings, each in three documents: all but the first go whole."""
    rows = []
    for n in range(2, 11):
        for p in range(12):
            passage = [f"passage {n} {p} line {i} with some words" for i in range(n)]
            for copy in range(3):
                own = lambda side: [f"own {n} {p} {copy} {side} {i}" for i in range((p + copy) % 4)]
                rows.append((len(rows), "\n".join([*own("a"), *passage, *own("b")])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id: r.text for r in line_dedup.without_passages(docs).collect()}
    assert kept == brute(rows)
    left = [sum("passage" in x for x in kept[d].split("\n")) for d, _ in rows]
    assert all(n == (text.count("passage") if d % 3 == 0 else 0) for n, (d, text) in zip(left, rows, strict=True))


def test_passages_against_brute_force(spark):
    rows = [r for r in table() if r[0] != 907] + [(907, "z\n" * 300), (908, "a\n\nb\nc"), (909, "x\na\n\nb"), (910, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_dedup.without_passages(docs).collect()} == brute(rows)
    assert line_dedup.passage_report(docs.limit(0)).count() == 0


def test_pipeline_stage_takes_passages(spark):
    import corpus_pipeline

    rows = [(1, "own 1\np\nq\nown 2", 15), (2, "r\np\nq\ns", 7), (3, "p\nq", 3), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.remove_repeated_lines(spark, docs, "").collect()))
    assert got == [(1, "own 1\np\nq\nown 2", 15), (2, "r\ns", 3), (4, None, None)]


@pytest.mark.parametrize("most", [1000, 3])
def test_different_lines_with_one_hash(spark, monkeypatch, most):
    """Hashes that tell little: chunks of other lines with the same ones stay, and their own repetitions go."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "line_hash", lambda line: F.length(line).cast("long"))
    monkeypatch.setattr(line_dedup, "SHARED", most)
    rows = [r for r in table() if r[0] != 907] + [(908, "b1\nb2"), (909, "c1\nc2"), (910, "x\nc1\nc2"), (911, "yy\nb1\nb2")]
    assert {r.doc_id: r.text for r in line_dedup.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_text_moves_as_lines_not_as_chunks(spark, monkeypatch, tmp_path):
    """More hashes are met again than are sent: the joins shuffle the texts once at most, not once for each chunk about a line."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "BROADCAST", 0)
    line = lambda i: F.concat(*[F.sha2(F.concat_ws("-", "id", i, F.lit(k)), 512) for k in range(8)])
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), line), "\n")
    spark.range(300).select("id", text.alias("text")).select(F.explode(F.array("id", F.col("id") + 300)).alias("doc_id"), "text").write.parquet(f"{tmp_path}/docs")
    docs, store = spark.read.parquet(f"{tmp_path}/docs"), spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert line_dedup.repeated_lines(docs).filter("size(gone) = 20").count() == 300
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < written() - before < 1.5 * docs.agg(F.sum(F.length("text"))).first()[0]
