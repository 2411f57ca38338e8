"""Grammars of the text sidecars, as expressions and table functions over (clip, line_no, line) or whole texts.

The grammars disagree on purpose: each file kind has its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECIMAL = r"(\d+\.\d+)"


def decimals(text: Column) -> Column:
    """Every digits.digits anywhere in the text: no signs, no bare integers, comments included."""
    return F.transform(F.regexp_extract_all(text, F.lit(DECIMAL), F.lit(1)), lambda x: x.cast("double"))


def as_number(line: Column) -> Column:
    """The line as a double, null unless it is a plain decimal number."""
    x = F.trim(line)
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double"))


def lines(df: DataFrame, text: str = "text", key: str = "clip") -> DataFrame:
    """(key, line_no, line) of each text; null texts have none."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line"))


def times_lenient(rows: DataFrame, key: str = "clip") -> DataFrame:
    """One number a line, other lines dropped; (key, idx, t) in order of time."""
    x = rows.select(key, as_number(F.col("line")).alias("t"), "line_no").where("t is not null")
    return x.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("t", "line_no")) - 1).alias("idx"), "t")


def times_strict(rows: DataFrame, key: str = "clip") -> DataFrame:
    """Blank lines and # lines skipped, every other line must be a number: a bad one fails the query."""
    x = rows.where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    return x.select(key, "line_no", F.trim("line").cast("double").alias("t"))


def preamble(rows: DataFrame, key: str = "clip") -> DataFrame:
    """(key, preamble): the leading # lines, joined again."""
    body = F.when(~F.startswith(F.trim("line"), F.lit("#")), F.col("line_no"))
    first = F.min(body).over(Window.partitionBy(key))
    x = rows.withColumn("_b", F.coalesce(first, F.lit(1 << 30))).where("line_no < _b")
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("xs"))
    return g.select(key, F.array_join(F.transform("xs", lambda r: r["line"]), "\n").alias("preamble"))


def beep_last(rows: DataFrame, key: str = "clip") -> DataFrame:
    """(key, t): the last line that is a number."""
    return _pick(rows, key, F.max_by)


def beep_first(rows: DataFrame, key: str = "clip") -> DataFrame:
    """(key, t): the first line, null if it is no number."""
    return rows.where("line_no = 0").select(key, as_number(F.col("line")).alias("t"))


def _pick(rows: DataFrame, key: str, by) -> DataFrame:
    x = rows.select(key, "line_no", as_number(F.col("line")).alias("t")).where("t is not null")
    return x.groupBy(key).agg(by("t", "line_no").alias("t"))


def count_lines(rows: DataFrame, key: str = "clip") -> DataFrame:
    """(key, n): lines that are not blank, comments included."""
    return rows.groupBy(key).agg(F.count_if(F.trim("line") != "").alias("n"))


def backend(sidecar: Column, comment: Column, default: str) -> Column:
    """auto, cnn or ast from the sidecar's first such word, else from shot_detector=... in the comment, else the default."""
    own = F.lower(F.regexp_extract(F.coalesce(sidecar, F.lit("")), r"(?i)^\s*(auto|cnn|ast)\s*$", 1))
    note = F.lower(F.regexp_extract(F.coalesce(comment, F.lit("")), r"(?i)shot_detector\s*=\s*(auto|cnn|ast)", 1))
    return F.when(own != "", own).when(note != "", note).otherwise(F.lit(default))


def splits_to_times(splits: DataFrame, start: DataFrame) -> DataFrame:
    """(clip, idx, t): running sums of splits (clip, idx, split) behind each clip's start (clip, t0; 0 if missing)."""
    run = F.sum("split").over(Window.partitionBy("clip").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return splits.withColumn("_sum", run).join(start.select("clip", "t0"), "clip", "left").select("clip", "idx", (F.coalesce("t0", F.lit(0.0)) + F.col("_sum")).alias("t"))


def looks_absolute(values: DataFrame, least: float = 0.2, slack: float = 0.01) -> DataFrame:
    """(clip, absolute): two values or more, none below `least`, none more than `slack` below the one before."""
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("clip").orderBy("idx"))
    g = values.withColumn("_gap", gap).groupBy("clip").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.min("_gap").alias("gap"))
    return g.select("clip", ((F.col("n") >= 2) & (F.col("low") >= least) & (F.coalesce("gap", F.lit(0.0)) >= -slack)).alias("absolute"))


def reference_times(absolute: DataFrame, mixed: DataFrame, start: DataFrame) -> DataFrame:
    """(clip, idx, t, source) from absolute lists and lists that may be splits.

    A clip with an absolute list uses it, sorted, even if it has no rows of the other kind.  Another list is absolute if it looks so - moved behind
    the start if it begins before it - and a list of splits otherwise.  Clips with neither have no rows.
    """
    a = absolute.select("clip", (F.row_number().over(Window.partitionBy("clip").orderBy("x", "idx")) - 1).alias("idx"), F.col("x").alias("t"), F.lit("cali").alias("source"))
    rest = mixed.join(absolute.select("clip").distinct(), "clip", "left_anti").join(looks_absolute(mixed), "clip").join(start.select("clip", "t0"), "clip", "left").withColumn("t0", F.coalesce("t0", F.lit(0.0)))
    order = Window.partitionBy("clip").orderBy("idx")
    first = F.first("x").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0))
    t = F.when(F.col("absolute"), F.when(F.col("_first") < F.col("t0"), F.col("t0") + F.col("x")).otherwise(F.col("x"))).otherwise(F.col("t0") + F.col("_sum"))
    b = rest.withColumn("_first", first).withColumn("_sum", total).select("clip", (F.row_number().over(order) - 1).alias("idx"), t.alias("t"), F.when(F.col("absolute"), "absolute").otherwise("splits").alias("source"))
    return a.unionByName(b)


def resolve_t0(clips: DataFrame, beep_file: DataFrame, overrides: DataFrame, detected: DataFrame) -> DataFrame:
    """(clip, t0, source): the beep file's time, else the override, else the detected one, else 0."""
    x = clips.select("clip").join(beep_file.select("clip", F.col("t").alias("a")), "clip", "left").join(overrides.select("clip", F.col("t").alias("b")), "clip", "left").join(detected.select("clip", F.col("t").alias("c")), "clip", "left")
    source = F.when(F.col("a").isNotNull(), "file").when(F.col("b").isNotNull(), "override").when(F.col("c").isNotNull(), "detector").otherwise("none")
    return x.select("clip", F.coalesce("a", "b", "c", F.lit(0.0)).alias("t0"), source.alias("source"))


def ocr_times(text: Column, expected: Column) -> Column:
    """Decimals of an OCR text, cut to the expected number from the end if there are more."""
    xs = decimals(text)
    return F.when(F.size(xs) > expected, F.slice(xs, F.size(xs) - expected + 1, expected)).otherwise(xs)


def audit_markers(text: Column) -> Column:
    """struct(fp, fn) of sorted times from a JSON object with fp and fn (or false_positives, false_negatives), or times (all fp)."""
    shape = "struct<fp:array<double>,fn:array<double>,false_positives:array<double>,false_negatives:array<double>,times:array<double>>"
    j = F.from_json(text, shape)
    none = F.array().cast("array<double>")
    return F.struct(F.array_sort(F.coalesce(j["fp"], j["false_positives"], j["times"], none)).alias("fp"), F.array_sort(F.coalesce(j["fn"], j["false_negatives"], none)).alias("fn"))


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def prefix(name: Column) -> Column:
    """The part of a stem before its first "-"."""
    return F.split_part(name, F.lit("-"), F.lit(1))
