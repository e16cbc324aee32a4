"""Line dedup by winnowing over line hashes.

A line is what lies between line feeds; lines without a word are not compared, and go only
with a window that they lie in.  The order of the corpus is by doc_id (null last), then by the text's hash, then by line.  A
line goes if it lies in a run of lines of one document, of ``words`` words or more, that
also occurs earlier in the corpus; the first occurrence of each run stays.

* Winnowing: windows are, from each line on and up to each line, the fewest lines that reach
  ``words`` words.  The line with the smallest hash in a window is selected, which keeps a share of
  all lines only.  Equal windows select equal lines, so each run that repeats has a fingerprint in
  every place where it occurs.
* Positions: the selected lines are joined on their hash; those that occur once are done with.
* Extension: around each position that is left the windows that selected it, which go on from it in
  both directions, are compared by two hashes of all their lines.  A repeated run of any length is the
  union of its windows, so each window with an earlier place loses all its lines.

The windows are frames over the running count of words, so a document of any length is
handled in one sorted pass.  Positions and windows that occur often are joined apart from the others,
so no task gathers those of one line.  The texts are shuffled once, against the lines to drop, in a
hash join that does not sort them.

Defined results: a null text stays null and counts as no lines; a document may become
empty and stays; rows with equal doc_id and equal text are one document and are treated
alike, so neither is a repeat of the other; n_chars, if there, becomes the length of the
new text; other columns stay as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import cut, fresh, n_words, spread_join

WORDS = 50


def _key(doc_id: str, text: str) -> Column:
    """Order of a document in the corpus: equal only for equal ids and texts."""
    return F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))


def word_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, line (from 0), h and g (hashes) and words of the lines that have a word; repeated rows once."""
    lines = docs.select(_key(doc_id, text).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "string"))
    hashed = lines.select("doc", "line", F.xxhash64("string").alias("h"), F.hash("string").alias("g"), n_words(F.col("string")).alias("words")).where("words > 0")
    return hashed.repartition("doc").dropDuplicates(["doc", "line"])


def _frames(lines: DataFrame, words: int) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """lines with running counts, and the frames of the windows that start at a line and that end at one."""
    by_line = Window.partitionBy("doc").orderBy("line")
    counted = lines.withColumn("upto", F.sum("words").over(by_line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("words"))
    start = Window.partitionBy("doc").orderBy("before").rangeBetween(0, words - 1)
    end = Window.partitionBy("doc").orderBy("upto").rangeBetween(1 - words, 0)
    return counted, start, end


def fingerprints(lines: DataFrame, words: int = WORDS) -> DataFrame:
    """doc, line and print (its hash) of the lines that some window selects."""
    counted, *frames = _frames(lines, words)
    least = [F.when(F.sum("words").over(f) >= words, F.min(F.struct("h", "line")).over(f)) for f in frames]
    both = counted.select("doc", F.array(*least).alias("least")).select("doc", F.explode("least").alias("least")).where("least is not null")
    return both.select("doc", F.col("least.line").alias("line"), F.col("least.h").alias("print")).dropDuplicates(["doc", "line"])


def windows(lines: DataFrame, anchors: DataFrame, words: int = WORDS) -> DataFrame:
    """doc, first, last and content (two hashes of all lines) of the windows that selected one of ``anchors`` (doc, line)."""
    marks = anchors.select("doc", "line", F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("g"), F.lit(None).cast("long").alias("words"))
    # lines and marks of a document meet by one exchange
    marked = lines.unionByName(marks).repartition("doc").withColumn("kept", F.max(F.col("h").isNull()).over(Window.partitionBy("doc", "line"))).where("h is not null")
    marked = marked.withColumn("any", F.max("kept").over(Window.partitionBy("doc"))).where("any").drop("any")
    counted, start, end = _frames(marked, words)

    def of(frame: WindowSpec) -> Column:
        inside = F.collect_list(F.struct("h", "g")).over(frame)
        return F.struct(
            F.min("line").over(frame).alias("first"),
            F.max("line").over(frame).alias("last"),
            F.min(F.struct("h", "line", "kept")).over(frame)["kept"].alias("kept"),
            F.struct(F.xxhash64(inside).alias("x"), F.hash(inside).alias("m")).alias("content"),
            F.sum("words").over(frame).alias("words"),
        )

    both = counted.select("doc", of(start).alias("from"), of(end).alias("to"))
    either = F.when(F.col("from") == F.col("to"), F.array("from")).otherwise(F.array("from", "to"))
    found = both.select("doc", F.explode(either).alias("w")).where((F.col("w.words") >= words) & F.col("w.kept"))
    return found.select("doc", "w.first", "w.last", "w.content")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """doc and gone, the array of the lines to drop, of the documents that lose some."""
    lines = cut(word_lines(docs, text, doc_id))
    positions = cut(fingerprints(lines, words))
    repeated = positions.groupBy(F.col("print").alias("_print")).agg(F.count("*").alias("_rows")).where("_rows > 1")
    around = cut(windows(lines, spread_join(positions, repeated, "print", "_print", "_rows"), words))
    place = F.struct("doc", "first")
    first = around.groupBy(F.col("content").alias("_content")).agg(F.min(place).alias("_first"), F.max(place).alias("_final"), F.count("*").alias("_rows")).where("_first <> _final").drop("_final")
    later = spread_join(around, first, "content", "_content", "_rows").where(place > F.col("_first"))
    return later.select("doc", F.explode(F.sequence("first", "last")).alias("line")).groupBy("doc").agg(F.collect_set("line").alias("gone"))


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """``docs`` with the repeated lines dropped from the text."""
    of_id, of_hash, lost = fresh(docs.columns, "_id", "_hash", "_gone")
    gone = repeated_lines(docs, text, doc_id, words).select(F.col("doc.id").alias(of_id), F.col("doc.hash").alias(of_hash), F.col("gone").alias(lost)).hint("shuffle_hash")
    old = F.col(f"`{text}`")
    joined = docs.join(gone, docs[doc_id].eqNullSafe(F.col(of_id)) & (F.xxhash64(docs[text]) == F.col(of_hash)), "left")
    lines = F.split(old, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    new = F.when(F.col(lost).isNull(), old).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length(out[text]).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
