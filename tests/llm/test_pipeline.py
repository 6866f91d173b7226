"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
import base64

import public_tokenizers
import test_decontaminate
import test_jaccard_join
import test_language_id
import test_line_dedup

import corpus_pipeline
from panelloom.llm import language_id

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "line_dedup", "mark"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line_dedup string, mark long"


def table():
    pick = random.Random(12)
    prose = lambda lang, n: test_language_id.text(lang, n, pick)
    lines = lambda lang, n: "\n".join(prose(lang, 9) for _ in range(n))
    items = [(i, " ".join(f"item{i}word{pick.randrange(500)}" for _ in range(30))) for i in range(4)]
    passage = [" ".join(f"shared{k}{i}" for i in range(8)) for k in range(5)]
    docs = []
    for d in range(160):
        lang = pick.choice(["aa", "bb", "cc"])
        text = lines(lang, pick.randint(1, 8))
        if d % 8 == 1:
            text = "\n".join([text, *passage[: pick.randint(2, 5)], prose(lang, 9)])
        if d % 20 == 5:
            text += " " + items[pick.randrange(4)][1]
        docs.append((d, text, lang))
    docs += [(200, docs[0][1], "aa"), (201, docs[3][1] + " one more", docs[3][2]), (202, None, "aa"), (203, "", "aa"), (204, "12 34", None), (205, "x", None)]
    docs += [(206, items[0][1], "bb"), (207, passage[0] + "\n" + passage[1], "cc"), (3, docs[3][1], docs[3][2]), (3, prose("aa", 40), "aa"), (None, prose("bb", 40), "bb"), (208, prose("cc", 9000), None)]
    docs += [(None, prose(lang, 40), lang) for lang in ("aa", "bb", "cc")] + [(None, prose("aa", 30) + " " + items[1][1], "aa")]  # of five texts without an id one leaks
    rows = [(d, t, lang, "s", None if t is None else len(t), "clash", 1) for d, t, lang in docs]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = table()
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def key(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_each_stage_against_a_plain_version(spark, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "decontamination", "encoding"]

    def took(name, rows):
        """The stage's rows over these; all but the last have the columns of documents."""
        got = stages[name](spark, spark.createDataFrame(rows, SCHEMA).repartition(4), folder)
        assert name == "encoding" or got.columns == COLUMNS
        return [tuple(r) for r in got.collect()]

    model = language_id.learn(spark.createDataFrame(held, SCHEMA))
    want = [r for r in held if (lambda found: found[0] != "und" and found[1] >= model.least)(test_language_id.plain(r[1], model))]
    got = took("language", held)
    assert key(got) == key(want) and {202, 203, 204} & {r[0] for r in got} == set() and len(got) > 150

    held, want = got, []
    texts = list(dict.fromkeys(((r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()), r[1]) for r in held))
    kept = test_line_dedup.brute(texts)
    for r in held:
        left = kept[(r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest())]
        if left == r[1]:
            want.append(r)
        elif left.strip():
            want.append((r[0], left, *r[2:4], len(left), *r[5:]))
    got = took("lines", held)
    assert key(got) == key(want) and len(got) < len(held) and sum(r[1].count(x) for r in got for x in ["shared00 ", "shared10 "]) < sum(r[1].count(x) for r in held for x in ["shared00 ", "shared10 "])

    held = got
    sets = test_jaccard_join.brute([(i, r[1]) for i, r in enumerate(held)], 5, 80)
    groups = {}
    for i, r in enumerate(held):
        groups.setdefault(sets[i][1], []).append(((r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest()), r))
    got = took("near_duplicates", held)
    assert key(got) == key([min(g, key=lambda x: x[0])[1] for g in groups.values()]) and len(got) < len(held)
    assert sum(r[0] == 3 for r in got) == 2  # two texts of one doc_id, of which one stood twice

    held = got
    leaks = {i for i, _ in test_decontaminate.brute([(i, r[1]) for i, r in enumerate(held)], items)}
    got = took("decontamination", held)
    assert key(got) == key([r for i, r in enumerate(held) if i not in leaks]) and len(leaks) > 3
    assert sum(r[0] is None for r in held) == 5 and sum(r[0] is None for r in got) == 4

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in got:
        ids = library.encode_ordinary(r[1])
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()))
    assert key(took("encoding", got)) == key(want)
    assert key(corpus_pipeline.run(spark, folder).collect()) == key(want)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    """While a stage runs; the session's own value comes back, and all rows are encoded."""
    import corpus_pipeline as cp

    spark.range(3000).selectExpr("id doc_id", "repeat(concat(id, ' word '), 400) text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before, seen = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), []

    def sizes(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                yield b.slice(0, 1).from_pydict({"size": [b.nbytes]})

        seen.append(max(r.size for r in docs.select("doc_id", "text").mapInArrow(run, "size long").collect()))
        return docs

    monkeypatch.setattr(cp, "STAGES", [("plain", sizes), ("encoding", lambda *a: (cp.encode(*a), sizes(*a))[0])])
    assert cp.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 3000
    assert seen[0] > 6_000_000 > seen[1]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_batches_of_a_stage_called_alone(spark, tmp_path, monkeypatch):
    """What it leaves in the session is not what a later run begins with, and that run leaves what it found."""
    import corpus_pipeline as cp

    spark.range(3).selectExpr("id doc_id", "'some text' text").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(cp.BATCH_BYTES)
    try:
        spark.conf.set(cp.BATCH_BYTES, "9m")
        cp.encode(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
        seen = [spark.conf.get(cp.BATCH_BYTES)]
        monkeypatch.setattr(cp, "STAGES", [("plain", lambda spark, docs, d: (seen.append(spark.conf.get(cp.BATCH_BYTES)), docs)[1])])
        cp.run(spark, str(tmp_path))
        assert [*seen, spark.conf.get(cp.BATCH_BYTES)] == ["4m", "9m", "4m"]
    finally:
        spark.conf.set(cp.BATCH_BYTES, before)
