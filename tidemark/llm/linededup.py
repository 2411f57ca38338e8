"""Deletion of repeated line runs, with DataFrame functions only.

The sequence of a document is its lines that hold a word.  Line identifiers are hashes, and prefix doubling names every run of 2^j lines by
the names of its two halves, level by level, for all suffixes at once.  A run of any length l is named by its first
and its last 2^j lines, 2^j <= l < 2^(j+1): suffixes with the same name at length l are one interval of the suffix
array whose longest common prefix is l or more, and the interval's least place is its first copy.

A repeated run counts from `min_words` words on.  From each line the shortest run with that many words is taken,
forwards and backwards.  A line lies in a counting run that repeats an earlier place exactly if one of these shortest
runs over it does (inside the run, either the rest behind the line or the part before it reaches the number, or the
run that starts with its first line covers it).  So the intervals of these runs decide, however long the maximal runs
are, and the maximal runs are the unions of the marked ones.  Every line has a word, so shortest runs have at most
`min_words` lines and the doubling needs log2(min_words) levels.

An interval is shuffled as its first place and size (pre-aggregated before the shuffle); a marked run is found by a
join that may be split, so no key is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._text import new_name

MIN_WORDS = 8
KEY = ["l", "a", "b", "g"]
WORD = "[^\\x20\\x09-\\x0D]"
SPACE = "[\\x20\\x09-\\x0D]+"


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, uid (one for each doc_id and text, so that repeated rows are one document), text without nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("uid"), text.alias("text"))


def shortest_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, uid, r (number of the first line among those with a word), first and last line number, and interval key of the shortest counting runs from each line, both ways."""
    lines = _identified(docs).select("doc_id", "uid", F.posexplode(F.split("text", "\n")).alias("i", "x")).where(F.col("x").rlike(WORD))
    words = F.size(F.array_remove(F.split("x", SPACE), ""))
    lines = lines.select("doc_id", "uid", "i", F.xxhash64("x").alias("n0"), F.hash("x").alias("g"), words.alias("w"))
    suffixes = Window.partitionBy("uid", "doc_id").orderBy("i")
    # the copies of a repeated row are one document: of equal line numbers one stays (on the exchange and order of the rest)
    copy = F.lag("i").over(suffixes)
    lines = lines.withColumn("copy", F.coalesce(copy == F.col("i"), F.lit(False))).where("not copy").drop("copy")
    level, size = 0, 1
    rows = lines.withColumn("before", F.sum("w").over(suffixes.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0))).withColumn("r", F.row_number().over(suffixes))
    while size * 2 <= min_words:  # level by level: the name of 2 * size lines from two names of size lines
        half = F.lead(f"n{level}", size).over(suffixes)
        rows = rows.withColumn(f"n{level + 1}", F.when(half.isNotNull(), F.xxhash64(f"n{level}", half)))
        level, size = level + 1, size * 2
    runs = []
    for n in range(1, min_words + 1):  # run of n lines from here: its words, last line and name
        j = n.bit_length() - 1
        tail = F.col(f"n{j}") if n == 1 << j else F.lead(f"n{j}", n - (1 << j)).over(suffixes)
        last = F.col("i") if n == 1 else F.lead("i", n - 1).over(suffixes)
        total = F.col("w") if n == 1 else F.lead(F.col("before") + F.col("w"), n - 1).over(suffixes) - F.col("before")
        less = F.lit(0) if n == 1 else F.lead("before", n - 1).over(suffixes) - F.col("before")  # without the last line
        own = F.col("w")
        # shortest forwards: without its last line too few words; shortest backwards: without its first line too few
        counts = (total >= min_words) & ((less < min_words) | (total - own < min_words))
        runs.append(F.when(counts, F.struct(F.col("i").alias("start"), last.alias("end"), F.lit(n).alias("l"), F.col(f"n{j}").alias("a"), tail.alias("b"))))
    # a line starts one shortest run forwards and any number of shortest runs backwards
    rows = rows.select("doc_id", "uid", "g", "r", F.array(*runs).alias("all"))
    found = rows.select("doc_id", "uid", "g", "r", F.explode("all").alias("x")).where("x is not null")
    return found.select("doc_id", "uid", "r", "x.start", "x.end", "x.l", "x.a", "x.b", "g")


def intervals(runs: DataFrame) -> DataFrame:
    """The intervals of two suffixes or more: key, first place, number of places.

    Part of the key is rewritten (to the same value), so that a join on it deals this small side anew: Spark splits a
    hot key of a join only if both its sides come straight from a shuffle.
    """
    place = F.struct("doc_id", "uid", "start")
    found = runs.groupBy(*KEY).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return found.select(*[F.col(c).bitwiseXOR(F.lit(0)).alias(c) if c == "g" else c for c in KEY], "first", "n")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, uid, runs: the maximal runs (start, end: line numbers, end included) that repeat an earlier place.

    Earlier means a smaller doc_id (null first; equal ids by a hash of the text), or a smaller line in the same document.
    """
    runs = shortest_runs(docs, min_words)
    marked = runs.join(intervals(runs), KEY).where(F.struct("doc_id", "uid", "start") > F.col("first")).select("doc_id", "uid", "r", "start", "end", (F.col("r") + F.col("l") - 1).alias("to")).distinct()
    order = Window.partitionBy("uid", "doc_id").orderBy("r", "to")
    reached = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = marked.withColumn("opens", F.when(reached >= F.col("r") - 1, 0).otherwise(1)).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("uid", "doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, joined again: the stretches between the runs, in time linear in the lines."""
    ends = F.concat(F.array(F.lit(-1)), F.transform(runs, lambda r: r["end"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    stretch = F.zip_with(ends, starts, lambda e, s: F.slice(lines, e + 2, F.greatest(s - e - 1, F.lit(0))))
    return F.array_join(F.flatten(stretch), "\n")


def delete_repeats(docs: DataFrame, min_words: int = MIN_WORDS, kept: str = "kept_text", removed: str = "removed_runs") -> DataFrame:
    """All columns of docs, with the columns named by `kept` (the text left, null for null) and `removed` (the runs deleted, empty if none).

    Null, empty and wordless texts lose nothing; a wordless line goes if the lines with words on both sides of it go.  A very long text has as many rows as
    lines, like many short ones.  Repeated rows (equal doc_id and text) are one document and keep or lose the same lines.
    Columns named as the two are replaced, all others return.  An empty table gives no rows.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (kept, removed)])
    doc, uid, runs = (new_name(n, docs) for n in ("doc", "uid", "runs"))
    found = repeated_runs(docs, min_words).select(F.col("doc_id").alias(doc), F.col("uid").alias(uid), F.col("runs").alias(runs))
    same = (F.xxhash64(base["doc_id"], F.coalesce(base["text"], F.lit(""))) == found[uid]) & base["doc_id"].eqNullSafe(found[doc])
    joined = base.join(found, same, "left").drop(doc, uid)
    left = F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n")), lambda x: _kept(x, F.col(runs)))[0])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.withColumns({kept: left, removed: F.coalesce(runs, none)}).drop(runs)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their own columns and text without repeats; n_chars, if there, follows.  Documents that lose their last word go."""
    kept, removed = new_name("kept", docs), new_name("removed", docs)
    out = delete_repeats(docs, min_words, kept, removed)
    lost = (F.size(removed) > 0) & ~F.col(kept).rlike(WORD)
    out = out.where(~F.coalesce(lost, F.lit(False)))
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.col(kept).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.size(removed) > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(kind).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
