"""Removal of multi-line chunks that occur elsewhere, with content-defined chunk borders.

A text is cut at newlines. A rolling hash over the hashes of each full line, one that isn't blank, and of the full line before it
chooses borders: one bit of it says in which of ``CHUNKINGS``, two, the line is a border. A chunk runs from a
full line to the next border of a chunking after it, both inside, and no further than ``MOST`` full lines. So where a chunk ends
depends on lines inside it alone: an inserted or lost line, or other surroundings, move no other border, and the two chunkings are complements, so that
even a passage of two full lines holds a whole chunk of one of them, whatever surrounds it. A chunk is known by the hashes of its lines, one after
the other, and 64 bits of them tell which chunks may be met again. Of equal chunks the first stays, by doc_id and place, and the lines of all others go.

That lines with equal hashes are equal is checked byte by byte, with each different line once, not with the text of each chunk: a line lies in six
of them or so. Where different lines share a hash, chunks that hold such a line are compared as text, so none goes that only shares hashes.

As every chunk is made of chunks of two full lines, and those are never missed, the lines that go are those of any passage of two full lines
or more that occurs earlier, which is how the SQL puts it.

A null text stays null; an empty one is a single empty line and stays. Rows with the same doc_id and
text count as one document: they keep the first occurrence in each. Rows with one doc_id and different
texts are documents of their own, in the order of a digest of the text. Very long texts are cut like
others; columns of the caller pass whatever their names. All by DataFrame functions. Hashes that are met again are
broadcast up to ``BROADCAST`` of them; beyond that the joins shuffle hashes and places of chunks, and the lines themselves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import durable, released

#: Most hashes that are broadcast.
BROADCAST = 500_000
#: Most shared hashes whose chunks alone are compared as text; beyond that all are.
SHARED = 1000
#: Values of the bit that chooses borders, its place in the rolling hash, and most full lines of a chunk.
CHUNKINGS, BIT, MOST = 2, 5, 8


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def rolled(before: Column, mark: Column) -> Column:
    """A cyclic polynomial over two lines' hashes: the one before is rotated by a bit."""
    return F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63)).bitwiseXOR(mark)


def chunks(docs: DataFrame, with_text: bool | list[int] = False, with_own: bool = False) -> DataFrame:
    """doc_id, mark (a digest of the text), and i, j (first and last line) and high (its hash) of each chunk.

    ``own`` are the hashes of its lines, ``chunk`` is its text: of all chunks, or of those with a line of the hashes in ``with_text``.
    """
    cut = docs.filter(F.col("text").contains("\n")).select("doc_id", _digest("text").alias("mark"), F.split("text", "\n", -1).alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    cut = cut.withColumn("full", full).filter(F.size("full") > 1).withColumn("marks", F.transform("lines", line_hash))
    mark_at = lambda k: F.get("marks", F.get("full", k))
    bit = lambda k: F.shiftrightunsigned(rolled(mark_at(k - 1), mark_at(k)), BIT) % CHUNKINGS
    cut = cut.withColumn("kind", F.transform("full", lambda i, k: F.when(k > 0, bit(k))))

    def chunk(i, j):
        own = F.slice("marks", i + 1, j - i + 1)
        # ``lines`` is named twice, so that the optimizer keeps it as a column instead of splitting the text again for each chunk
        text = F.array_join(F.slice("lines", F.least(i, F.size("lines")) + 1, j - i + 1), "\n")
        if isinstance(with_text, list):
            text = F.when(F.arrays_overlap(own, F.array(*map(F.lit, with_text))), text)
        return F.struct(i.alias("i"), j.alias("j"), F.xxhash64(own).alias("high"), *[own.alias("own")] * with_own, *[text.alias("chunk")] * bool(with_text))

    def started(i, k):
        """The chunk to the next line, which is a border of one chunking, and that to the next border of the other."""
        other = F.coalesce(*[F.when(F.get("kind", k + d) != F.get("kind", k + 1), F.get("full", k + d)) for d in range(2, MOST)], F.get("full", k + MOST - 1))
        return F.array(chunk(i, F.get("full", k + 1)), F.when(other.isNotNull(), chunk(i, other)))

    # The chunks are built in the row and only they are exploded: a row with all lines for each chunk would be quadratic.
    built = F.flatten(F.transform(F.slice("full", 1, F.size("full") - 1), started))
    return cut.select("doc_id", "mark", F.explode(built).alias("c")).filter("c IS NOT NULL").select("doc_id", "mark", "c.*")


def _few(hashes: DataFrame) -> tuple[DataFrame, bool]:
    """``hashes``, written, and broadcast if they are few enough to be sent to every task."""
    hashes = durable(hashes)
    few = hashes.count() <= BROADCAST
    return (F.broadcast(hashes) if few else hashes), few


def _met_again(docs: DataFrame, again: DataFrame, as_text: bool | list[int] = False) -> DataFrame:
    """doc_id, mark, i, j and own of the chunks that occur earlier without overlap; those with text are equal as text."""
    place = F.struct("doc_id", "mark", "i", "j")
    met = chunks(docs, as_text, with_own=True).join(again, "high").withColumn("chunk", F.coalesce("chunk", F.lit("")) if as_text else F.lit(""))
    met, equal = durable(met), ["high", "own", "chunk"]
    first = met.groupBy(*equal).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.filter(~F.col("first").eqNullSafe(F.col("last"))).select(*equal, "first")
    inside = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")) & (F.col("i") <= F.col("first.j"))  # the first, or one that overlaps it
    # Joined by other keys than grouped by, so that both sides are dealt anew and Spark may split what a very common passage fills.
    return durable(met.join(first.drop("high"), equal[1:]).filter(~inside).select("doc_id", "mark", "i", "j", "own"))


def shared_hashes(docs: DataFrame, known: DataFrame, few: bool) -> list[int]:
    """Hashes that different lines share, ``SHARED`` and one at most: among the known ones, or among all if those are too many to be sent."""
    lines = docs.filter(F.col("text").contains("\n")).select(F.explode(F.split("text", "\n", -1)).alias("line")).select(line_hash(F.col("line")).alias("hash"), "line")
    lines = lines.join(known, "hash") if few else lines
    shared = lines.distinct().groupBy("hash").count().filter("count > 1")
    return [r.hash for r in shared.select("hash").limit(SHARED + 1).collect()]


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark and ``gone``, the sorted numbers of its lines in chunks that occur earlier; only documents with any."""
    again, _ = _few(chunks(docs).groupBy("high").count().filter("count > 1").select("high"))
    later = _met_again(docs, again)
    shared = shared_hashes(docs, *_few(later.select(F.explode("own").alias("hash")).distinct()))
    released(docs.sparkSession)  # the lines that moved, before the texts move
    if shared:
        later = _met_again(docs, again, shared if len(shared) <= SHARED else True)
    lines = later.select("doc_id", "mark", F.explode(F.sequence("i", "j")).alias("line"))
    return lines.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _rows_as_they_are(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Each row of ``docs`` in a struct ``row``, and beside it what ``gone`` has for its doc_id and text. Each text moves once, as it is."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), _digest("text").alias("mark"))
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "mark": "gone_mark"})
    return held.join(gone, F.col("key").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left").drop("key", "mark", "gone_id", "gone_mark")


def _with_text(cut: DataFrame, columns: list[str], text: Column, report: Column, name: str = "line_dedup") -> DataFrame:
    """The caller's columns, with the new text, and ``report`` under that name.

    The generator over one struct is a barrier: a caller's filter on the text would otherwise be pushed below
    the projections, and with it a copy of everything the text is made of for each time it is named.
    """
    one = cut.select("row", text.alias("new_text"), report.alias("report")).select("row", F.explode(F.array(F.struct("new_text", "report"))).alias("new"))
    return one.select(*[F.col("new.new_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns], F.col("new.report").alias(name))


def without_passages(docs: DataFrame, name: str = "line_dedup") -> DataFrame:
    """``docs`` without any line of a passage that occurs earlier, by doc_id and place, and a struct ``name`` of n_lines, removed_lines.

    A passage is a run of equal lines of which two at least aren't blank, wherever it begins and
    whatever surrounds it; chunks of the two chunkings lie in every such run and cover it, so none is
    missed. A line goes if a chunk about it occurs earlier without overlap; so the first occurrence
    of each line's text always stays. Rows with the same doc_id and text each keep their first occurrences.
    """
    cut = _rows_as_they_are(docs, repeated_lines(docs)).withColumn("lines", F.split("row.text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    report = F.struct(
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("removed_lines"),
    )
    return _with_text(cut, docs.columns, text, report, name)


def passage_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, removed_lines, kept_md5 (of the remaining text) for each document."""
    return without_passages(docs.select("doc_id", "text")).select("doc_id", "line_dedup.*", F.md5("text").alias("kept_md5"))


#: ``passage_report`` for DuckDB.
PASSAGE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
numbered AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines),
units AS (
  SELECT doc_id, g, min(i) AS i, arg_min(line, i) AS line, string_agg(line, chr(10) ORDER BY i) AS unit FROM numbered WHERE g > 0 GROUP BY doc_id, g),
windows AS (
  SELECT doc_id, i, lead(i) OVER w AS j, unit || chr(10) || lead(line) OVER w AS passage FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
placed AS (
  SELECT *, first_value(doc_id) OVER p AS first_doc, first_value(j) OVER p AS first_j FROM windows WHERE j IS NOT NULL WINDOW p AS (PARTITION BY passage ORDER BY doc_id, i)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM placed WHERE doc_id <> first_doc OR i > first_j)
SELECT d.doc_id,
       count(l.i)::BIGINT AS n_lines,
       count(g.i)::BIGINT AS removed_lines,
       md5(CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') END) AS kept_md5
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id
"""
