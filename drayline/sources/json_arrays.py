"""Files that each hold one JSON array of objects, read in byte ranges.

Spark's text source splits a file at any byte that is a separator; here that is the closing brace, so a task's rows are pieces of
text that end before a ``}`` (which cannot stand inside an escape sequence). Whether a brace closes an element depends on what
comes before it: on being inside a string, and on how deep it is nested. A first pass finds, for every range of bytes, how it
would change that state, for both possible beginnings; a running sum over the ranges, which are as few as the file has blocks, gives
the state at the beginning of each. The second pass then numbers the elements and puts the pieces of each together, also
of those that cross from one range into the next. Nothing of a file goes to one task but a range, or an element, at a time.

Compressed files cannot be split; they are read as one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.session import local_rows

RANGE = ["file", "at"]
STATES = "file string, at long, inside int, depth long, elements long"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, n, piece): the text before every closing brace, numbered in order within the range of bytes that starts at ``at``."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").alias("piece"),
    )


def _count(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]", ""))


def _outside(unescaped: Column, inside: int) -> Column:
    """A piece without its strings; ``inside``: whether it begins in one."""
    begun = F.concat(F.lit('"'), unescaped) if inside else unescaped
    return F.regexp_replace(begun, r'"[^"]*("|$)', "")


def _followed(pieces: DataFrame) -> DataFrame:
    """Adds, for a range that begins outside (0) or inside (1) of a string: whether a piece begins inside (``i0``, ``i1``), and how much
    deeper it is after the piece and the brace behind it than where the range began (``d0``, ``d1``). ``ends``: the brace is no part of a string."""
    unescaped = F.regexp_replace("piece", r"(?s)\\.", "")
    within = Window.partitionBy(*RANGE).orderBy("n")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.select(
        *RANGE,
        "n",
        "piece",
        _count(unescaped, '"').alias("quotes"),
        *[(_count(_outside(unescaped, i), r"{\[") - _count(_outside(unescaped, i), r"\]")).alias(f"deeper{i}") for i in (0, 1)],
    )
    turned = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    followed = counted.select("*", turned.alias("i0"), (1 - turned).alias("i1"))
    for i in (0, 1):
        deeper = F.when(F.col(f"i{i}") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))
        closes = F.when((F.col(f"i{i}") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
        followed = followed.withColumns({f"ends{i}": closes == 1, f"step{i}": deeper - closes})
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return followed.withColumns({f"d{i}": F.sum(f"step{i}").over(running) for i in (0, 1)})


def _states(spark: SparkSession, pieces: DataFrame) -> tuple[DataFrame, int]:
    """The state in which each range begins: inside of a string or not, depth, elements before it; and the number of ranges.

    The driver holds a few numbers a range: its change of state, and how many braces close at each depth.
    """
    followed = _followed(pieces)
    per_range = followed.groupBy(*RANGE).agg(
        F.sum("quotes").alias("quotes"), F.sum("step0").alias("step0"), F.sum("step1").alias("step1")
    )
    closing = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"d{i}").alias("d"), F.col(f"ends{i}").alias("ends")) for i in (0, 1)]))
    closed = followed.select(*RANGE, closing.alias("c")).where("c.ends").groupBy(*RANGE, "c.i", "c.d").agg(F.count(F.lit(1)).alias("n"))
    closed_at = {(r.file, r["at"], r.i, r.d): r.n for r in closed.collect()}
    found: dict[str, tuple[int, int, int]] = {}
    rows = []
    for r in sorted(per_range.collect(), key=lambda r: (r.file, r["at"])):
        inside, depth, elements = found.get(r.file, (0, 0, 0))
        rows.append((r.file, r["at"], inside, depth, elements))
        elements += closed_at.get((r.file, r["at"], inside, 1 - depth), 0)
        found[r.file] = ((inside + r.quotes) % 2, depth + (r.step1 if inside else r.step0), elements)
    for file, (inside, depth, _) in found.items():
        # The last piece of a file is not followed by a brace.
        if inside or depth != -1:
            raise ValueError(f"not a JSON array: {file} does not hold one that is complete")
    return local_rows(spark, rows, STATES), len(rows)


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, value): the text of every object in the arrays, numbered from 0 in each file."""
    pieces = _pieces(spark, path)
    states, _ = _states(spark, pieces)
    # One row per range of bytes, as many as the scan has tasks.
    entered = _followed(pieces).join(F.broadcast(states), RANGE)
    inside = F.col("inside") == 1
    ends = F.when(inside, F.col("ends1")).otherwise(F.col("ends0"))
    depth = F.col("depth") + F.when(inside, F.col("d1")).otherwise(F.col("d0"))
    last = (F.when(inside, F.col("i1")).otherwise(F.col("i0")) + F.col("quotes")) % 2 == 0
    closing = entered.select(*RANGE, "n", "piece", "elements", (ends & last & (depth == 1)).cast("long").alias("closes"))
    before = Window.partitionBy(*RANGE).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    numbered = closing.withColumn("element", F.col("elements") + F.coalesce(F.sum("closes").over(before), F.lit(0)))
    together = numbered.groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "piece"))).alias("pieces"), F.max("closes").alias("closes")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "}")
    first, whole = F.col("element") == 0, F.col("closes") == 1
    opened = F.when(first, F.rlike(text, F.lit(r"(?s)^\s*\[\s*\{"))).otherwise(F.rlike(text, F.lit(r"(?s)^\s*,\s*\{")))
    closed = F.when(first, F.rlike(text, F.lit(r"(?s)^\s*\[\s*\]\s*$"))).otherwise(F.rlike(text, F.lit(r"(?s)^\s*\]\s*$")))
    value = F.concat(F.regexp_replace(text, r"(?s)^\s*[\[,]\s*", ""), F.lit("}"))
    refused = F.raise_error(F.concat(F.lit("not a JSON array of objects: "), F.substring(text, 1, 80)))
    checked = F.when(whole & opened, value).when(~whole & closed, F.lit(None)).otherwise(refused)
    return together.select("file", "element", checked.alias("value")).where(F.col("value").isNotNull())
