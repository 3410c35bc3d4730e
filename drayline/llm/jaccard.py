"""Exact Jaccard join of word-shingle sets in metric space, and the groups of linked documents.

Jaccard distance is a metric, but unrelated texts are all about 1 apart, so Voronoi regions around sampled documents would
replicate nearly every document to every region. Regions are therefore found in projections of the space first: the
shingles are dealt to the m parts of a size class, and documents that hold exactly the same of a part share a cell. Two
sets that differ in at most k shingles agree in at least m - k parts, and m is chosen so that one of these is not empty; a
document in which too many parts are empty is dealt anew with another salt. A document is also in the cells of the next
smaller size class where its size lies in the window of both.

In a cell of a few documents all are compared, by parity sketches (which never exceed the true difference) and then by
their sets. The pivot of a larger cell is its most central document, the one with the largest cells. The region of a pivot
are the documents that share such a cell with it, so two linked documents meet in a small cell or in a region. Every document is compared with its pivots; those
linked with a pivot are one component with it and are not compared with each other. For the others the region is joined
once more, exactly, around its middle, the set of what most of its documents hold: symmetric differences from it keep the
distances between documents. Those near the middle are linked by the triangle inequality; any other linked pair shares so many
of its differences that prefixes of them (new shingles first) find it, and what is left after a shared one excludes most others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drayline.llm import text
from drayline.llm.components import components
from drayline.session import workspace

SKETCH_WORDS = 8
#: The shorter sketch that a document's differences carry, so that a region's join itself excludes pairs.
SHORT_WORDS = 4
#: Documents of cells up to this size are compared with each other by their sketches, those of larger ones around a pivot.
SMALL_CELL = 8
#: Rows that go to a Python worker at once, as each may hold two sets.
BATCH_ROWS = 1_000
#: Of these so many at a time where each becomes many rows.
SLICE_ROWS = 200
MAX_SALTS = 200
#: Parts beyond those that must be there, as a share of the differences of a linked pair; each is one cell more to spare.
SPARE_SHARE = 0.15
MOST_SPARED = 1 << 14


@dataclass(frozen=True)
class Threshold:
    """Linked: ``whole * intersection >= part * union``."""

    part: int
    whole: int
    words: int

    def class_starts(self, size: int) -> list[int]:
        starts = [1]
        while starts[-1] <= size:
            starts.append(max(starts[-1] + 1, starts[-1] * self.whole // self.part + 1))
        return starts

    def differences(self, largest_smaller: int) -> int:
        """Most differing shingles of a linked pair whose smaller set has at most this size."""
        return largest_smaller * (self.whole - self.part) // self.part


class Cells:
    """The cells a set belongs to, and how many of them it can spare.

    Where a set fills more parts than must agree, a linked set shares as many cells more with it. In any order of all cells that is the
    same for all sets, both can then leave out that many of their last ones and still meet in the first one they share.
    """

    def __init__(self, threshold: Threshold) -> None:
        self.threshold, self.starts = threshold, threshold.class_starts(1)
        self.shape: dict[int, tuple[int, int]] = {}

    def _parts(self, j: int) -> tuple[int, int]:
        """(parts, differences) of size class j."""
        if j not in self.shape:
            k = self.threshold.differences(self.starts[j + 1] - 1)
            empty = (k + 1) * np.exp(-self.starts[j] / (k + 1))
            self.shape[j] = (k + 1 + (int(np.ceil(empty + 2 * np.sqrt(empty) + SPARE_SHARE * k)) if k else 0), k)
        return self.shape[j]

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and beside each how many may be left out of those of its size class, which the lowest bit tells from the next."""
        n = len(shingles)
        if not n:
            return shingles, np.zeros(0, dtype=np.int16)
        if self.starts[-1] <= n:
            self.starts = self.threshold.class_starts(n)
        own = int(np.searchsorted(self.starts, n, "right")) - 1
        classes = [own]
        if own and n <= (self.starts[own] - 1) * self.threshold.whole // self.threshold.part:
            classes.append(own - 1)
        sorted_by_salt: dict[int, np.ndarray] = {}
        out, spare = [], []
        with np.errstate(over="ignore"):
            for j in classes:
                m, k = self._parts(j)
                for salt in range(MAX_SALTS):
                    if salt not in sorted_by_salt:
                        sorted_by_salt[salt] = np.sort(text.mix(shingles ^ text.mix(np.array([salt + 1], dtype=np.uint64))))
                    x = sorted_by_salt[salt]
                    part = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    tag = text.mix((np.uint64(j) << np.uint64(44)) + (np.uint64(salt) << np.uint64(32)) + part[first])
                    out.append((text.mix(np.add.reduceat(text.mix(x), first) ^ tag) & ~np.uint64(1)) | np.uint64(j & 1))
                    # those of further salts are few: all are kept
                    spare.append(np.full(len(first), 0 if salt else min(MOST_SPARED, max(0, len(first) - k - 1)), dtype=np.int16))
                    if len(first) > k:  # fewer empty parts than parts that must agree
                        break
                else:
                    raise ValueError("no salt deals the set to enough parts")
        return np.concatenate(out), np.concatenate(spare)


def parity_sketch(mixed: np.ndarray, rows: np.ndarray, many: int, words: int) -> np.ndarray:
    """(rows, words): for each of 64 * words slots whether an odd number of a row's hashes falls in it."""
    slots = 64 * words
    slot = rows * slots + (mixed % np.uint64(slots)).astype(np.int64)
    odd = (np.bincount(slot, minlength=many * slots) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(many, -1), axis=1).reshape(-1).view(np.int64).reshape(many, words)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and its parity sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.each_chunk(batches):
            shingles, bounds = text.shingle_sets(text.words(batch.column("text")), words)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            mixed = text.mix(shingles + np.uint64(0x1234567))
            prints = []
            with np.errstate(over="ignore"):
                for values in (mixed, text.mix(mixed ^ np.uint64(0x777))):
                    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
                    prints.append(text.signed(sums[bounds[1:]] - sums[bounds[:-1]]))
            sketch = parity_sketch(mixed, rows, batch.num_rows, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), *map(pa.array, prints), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS))],
                ["doc_id", "n", "fa", "fb", *(f"s{i}" for i in range(SKETCH_WORDS))],
            )

    return _rows(docs).mapInArrow(run, "doc_id long, n long, fa long, fb long, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)))


def shingle_arrays(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.each_chunk(batches):
            shingles, bounds = text.shingle_sets(text.words(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.lists(text.signed(shingles), bounds, pa.int64())], ["doc_id", "shingles"])

    return _rows(docs).mapInArrow(run, "doc_id long, shingles array<long>")


def document_cells(docs: DataFrame, threshold: Threshold) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(threshold)
        for batch in text.each_chunk(batches):
            shingles, bounds = text.shingle_sets(text.words(batch.column("text")), threshold.words)
            found, spare = zip(*(cells.of(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:])))
            ids = np.repeat(batch.column("doc_id").to_numpy(), [len(f) for f in found])
            columns = [pa.array(text.signed(np.concatenate(found))), pa.array(ids, pa.int64()), pa.array(np.concatenate(spare))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "doc", "spare"])

    return _rows(docs).mapInArrow(run, "cell long, doc long, spare short")


class Join:
    def __init__(self, spark: SparkSession, docs: DataFrame, threshold: Threshold) -> None:
        self.spark, self.docs, self.threshold = spark, docs, threshold

    def kept(self, frame: DataFrame, label: str) -> DataFrame:
        path, setting = workspace(self.spark, label), "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        try:
            frame.write.parquet(path)
        finally:
            self.spark.conf.set(setting, before)
        return self.spark.read.parquet(path)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Without pairs that sizes or sketches rule out."""
        t = self.threshold
        columns = ["n", *(f"s{i}" for i in range(SKETCH_WORDS))]
        for side in ("a", "b"):
            pairs = pairs.join(self.member_keys.select(F.col("doc_id").alias(side), *(F.col(c).alias(side + c) for c in columns)), side)
        apart = sum((F.bit_count(F.col(f"as{i}").bitwiseXOR(F.col(f"bs{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("as0").bitwiseXOR(F.col("bs0"))))
        near = (apart * (t.whole + t.part) <= (F.col("an") + F.col("bn")) * (t.whole - t.part)) & (F.least("an", "bn") * t.whole >= F.greatest("an", "bn") * t.part)
        return pairs.where(near).select("a", "b")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both, either): sizes of intersection and union of each pair's sets."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    both.append(len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)))
                either = [len(x) + len(y) - n for x, y, n in zip(batch.column("x"), batch.column("y"), both)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

        a, b = (self.sets.select(F.col("doc_id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, both long, either long")

    def links(self, measured: DataFrame) -> DataFrame:
        return measured.where(f"{self.threshold.whole} * both >= {self.threshold.part} * either").select("a", "b")

    def shared_cells(self, cells: DataFrame) -> DataFrame:
        """``cells`` of two documents or more, with their size."""
        cell = Window.partitionBy("cell")
        shared = cells.withColumns({"low": F.min("doc").over(cell), "high": F.max("doc").over(cell), "size": F.count("*").over(cell)})
        return shared.where("low <> high").drop("low", "high")

    def needed_cells(self, shared: DataFrame) -> DataFrame:
        """(cell, doc) without the largest cells of each document, as many as it can spare. Where texts share an id and the number to
        spare, fewer are left out."""
        largest = Window.partitionBy("doc", "spare", F.col("cell").bitwiseAND(F.lit(1))).orderBy(F.desc("size"), "cell")
        return shared.withColumn("place", F.row_number().over(largest)).where("place > spare").select("cell", "doc")

    def near_each_other(self, members: DataFrame) -> DataFrame:
        """(a, b) of the small cells. A document meets fewer than ``SMALL_CELL`` others in each."""
        small = members.where(f"size <= {SMALL_CELL}")
        a, b = small.select("cell", F.col("doc").alias("a")), small.select("cell", F.col("doc").alias("b"))
        return a.join(b, "cell").where("a < b").select("a", "b").distinct()

    def pivoted(self, members: DataFrame) -> DataFrame:
        """(cell, pivot, doc) of the larger cells, without the pivot itself."""
        large = members.where(f"size > {SMALL_CELL}")
        central = members.groupBy("doc").agg(F.sum("size").alias("weight"))
        first = F.max(F.struct("weight", (-F.col("doc")).alias("minus")))
        pivots = large.join(central, "doc").groupBy("cell").agg(first.alias("first")).select("cell", (-F.col("first.minus")).alias("pivot"))
        return large.join(pivots, "cell").where("doc <> pivot").select("cell", "pivot", "doc")

    def open_regions(self, pivoted: DataFrame, labels: DataFrame) -> DataFrame:
        """(pivot, doc, component) of the documents with a cell in which two beside the pivot, not of the same component, may be linked."""
        label = labels.withColumnRenamed("component", "label").withColumnRenamed("node", "doc")
        placed = pivoted.join(label, "doc", "left").withColumn("component", F.coalesce("label", "doc")).drop("label")
        several = placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("cell")
        return placed.join(several, "cell").select("pivot", "doc", "component").distinct()

    def differences(self, regions: DataFrame) -> DataFrame:
        """(centre, doc, component, n, new, lost, k0...): what each document holds beyond its pivot, what it lacks of it, and a short
        sketch of its set. A centre is one text of one pivot."""
        short = [f"k{i}" for i in range(SHORT_WORDS)]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
                new, lost, n, sketches = [], [], [], []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    mine, pivot = x.values.to_numpy(), y.values.to_numpy()
                    new.append(np.setdiff1d(mine, pivot, assume_unique=True))
                    lost.append(np.setdiff1d(pivot, mine, assume_unique=True))
                    n.append(len(mine))
                    sketches.append(parity_sketch(text.mix(mine.view(np.uint64)), np.zeros(len(mine), dtype=np.int64), 1, SHORT_WORDS))
                if n:
                    both = [text.lists(np.concatenate(part), np.concatenate([[0], np.cumsum([len(p) for p in part])]), pa.int64()) for part in (new, lost)]
                    columns = [*(batch.column(c) for c in ("centre", "doc", "component")), pa.array(n, pa.int64()), *both]
                    yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, np.ascontiguousarray(np.concatenate(sketches).T))], ["centre", "doc", "component", "n", "new", "lost", *short])

        x, y = (self.sets.select(F.col("doc_id").alias(i), F.col("shingles").alias(s)) for i, s in (("doc", "x"), ("pivot", "y")))
        both = regions.join(x, "doc").join(y, "pivot").select(F.xxhash64("pivot", "y").alias("centre"), "doc", "component", "x", "y")
        return both.mapInArrow(run, "centre long, doc long, component long, n long, new array<long>, lost array<long>, " + ", ".join(f"{k} long" for k in short))

    def centred(self, apart: DataFrame) -> DataFrame:
        """``diff``, the differences from the middle of each region in place of those from its pivot, and ``slack``.

        The middle is the set that holds what more than half of the region's documents hold, or the pivot where they are even. What
        they all differ in from the pivot, its own edits, is then no difference any more. New shingles come first, as unrelated edits
        add different ones but may lose the same.
        """
        t = self.threshold
        many = apart.groupBy("centre").agg(F.count("*").alias("many"))
        elements = [apart.select("centre", F.lit(c == "new").alias("added"), F.explode(c).alias("element")) for c in ("new", "lost")]
        times = elements[0].unionByName(elements[1]).groupBy("centre", "added", "element").agg(F.count("*").alias("times"))
        often = times.join(many, "centre").where("2 * times > many").groupBy("centre")
        often = often.agg(F.collect_list(F.when(F.col("added"), F.col("element"))).alias("put"), F.collect_list(F.when(~F.col("added"), F.col("element"))).alias("cut"))
        none = F.array().cast("array<long>")
        moved = apart.join(often, "centre", "left").withColumns({c: F.coalesce(c, none) for c in ("put", "cut")})
        sides = (("new", "put", "lost", "cut"), ("lost", "cut", "new", "put"))
        parts = [F.array_sort(F.concat(F.array_except(mine, taken), F.array_except(given, other))) for mine, taken, other, given in sides]
        moved = moved.withColumn("diff", F.concat(*parts)).drop("new", "lost", "put", "cut")
        return moved.withColumn("slack", F.size("diff").cast("long") * (t.whole + t.part) - F.col("n") * (t.whole - t.part))

    def cores(self, centred: DataFrame) -> DataFrame:
        """``centred`` with ``sure``, the region's document of least slack where it is of another component and linked by the triangle
        inequality, ``inside``, whether one of the component is so linked, and ``least``, the least slack of a possible partner.

        Two documents are linked if their slacks add up to 0 or less, and else only if they share as many differences as half the sum
        asks for, in units of whole + part. The components inside are one in the end, so one of a pair is outside.
        """
        nearest = centred.groupBy("centre").agg(F.min(F.struct("slack", "doc", "component")).alias("first"))
        placed = centred.join(nearest, "centre").withColumn("core", F.col("slack") + F.col("first.slack") <= 0)
        inside = placed.where("core").select("centre", "component").distinct().withColumn("inside", F.lit(True))
        placed = placed.join(inside, ["centre", "component"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
        outside = placed.where("not inside").groupBy("centre").agg(F.min("slack").alias("outer"))
        placed = placed.join(outside, "centre", "left").withColumn("least", F.when(F.col("inside"), F.col("outer")).otherwise(F.col("first.slack")))
        return placed.withColumn("sure", F.when(F.col("core") & (F.col("component") != F.col("first.component")), F.col("first.doc"))).drop("first", "core", "outer")

    def prefixes(self, placed: DataFrame) -> DataFrame:
        """(centre, element, left, few, doc, component, inside, n, apart, slack, k0...): the first differences of each document, one of
        which it shares with any it is linked with, how many come after, and whether it is among the first for partners of more slack."""
        unit = 2 * (self.threshold.whole + self.threshold.part)
        some = placed.where("least is not null").withColumn("apart", F.size("diff").cast("long"))

        def length(other: Column) -> Column:
            needed = F.greatest(F.lit(1), F.ceil((F.col("slack") + other) / F.lit(unit) - 1e-9))
            return F.greatest(F.lit(0), F.col("apart") - needed + 1)

        columns = ["centre", "doc", "component", "inside", "n", "apart", "slack", *(f"k{i}" for i in range(SHORT_WORDS))]
        first = F.slice("diff", F.lit(1), length(F.col("least")).cast("int"))
        found = some.select(*columns, length(F.greatest("slack", "least")).alias("most"), F.posexplode(first).alias("at", "element"))
        return found.withColumns({"left": F.col("apart") - F.col("at") - 1, "few": F.col("at") < F.col("most")}).drop("at", "most")

    def inner_pairs(self, prefixes: DataFrame) -> DataFrame:
        """Pairs of different components that share a difference in a region, where their distances from its middle, short sketches and
        the differences left after it allow a link; what a pair shares first allows all that it shares."""
        t = self.threshold
        short = [f"k{i}" for i in range(SHORT_WORDS)]
        columns = ["doc", "component", "inside", "n", "apart", "slack", "left", *short]
        x, y = (f.select("centre", "element", *(F.col(c).alias(side + c) for c in columns)) for f, side in ((prefixes, "x"), (prefixes.where("few"), "y")))
        once = (F.col("xslack") > F.col("yslack")) | ((F.col("xslack") == F.col("yslack")) & (F.col("xdoc") > F.col("ydoc")))
        open_pair = (F.col("xcomponent") != F.col("ycomponent")) & ~(F.col("xinside") & F.col("yinside"))
        enough = F.col("xslack") + F.col("yslack") <= 2 * (t.whole + t.part) * (F.least("xleft", "yleft") + 1)
        odd = [F.bit_count(F.col("x" + k).bitwiseXOR(F.col("y" + k))) for k in short]
        apart = F.greatest(F.col("xapart") - F.col("yapart"), F.col("yapart") - F.col("xapart"), sum(odd[1:], odd[0]).cast("long"))
        near = apart * (t.whole + t.part) <= (F.col("xn") + F.col("yn")) * (t.whole - t.part)
        met = x.join(y, ["centre", "element"]).where(once & open_pair & enough & near)
        return met.select(F.least("xdoc", "ydoc").alias("a"), F.greatest("xdoc", "ydoc").alias("b")).distinct()

    def run(self) -> DataFrame:
        t = self.threshold
        keys = self.kept(set_keys(self.docs, t.words), "set-keys")
        known = keys.where("doc_id is not null and n > 0")
        classes = self.kept(known.groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "set-classes")
        one_text = known.groupBy("doc_id").agg(((F.min("fa") == F.max("fa")) & (F.min("fb") == F.max("fb"))).alias("sure")).where("sure").select("doc_id")
        copies = self.kept(known.join(classes, ["fa", "fb", "n"]).where("doc_id <> rep").select("doc_id").join(one_text, "doc_id"), "copies")
        distinct_docs = _rows(self.docs).where("doc_id is not null").join(copies, "doc_id", "left_anti")
        shared = self.kept(self.shared_cells(document_cells(distinct_docs, t)), "shared-cells")
        members = self.kept(self.shared_cells(self.needed_cells(shared)), "cells")
        ids = self.kept(members.select(F.col("doc").alias("doc_id")).distinct(), "members")
        self.member_keys = known.join(ids, "doc_id").dropDuplicates(["doc_id", "fa", "fb"])
        pivoted = self.kept(self.pivoted(members), "pivoted")
        regions = self.kept(pivoted.select("pivot", "doc").distinct(), "regions")
        pivots = regions.select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b"))
        near = self.kept(self.possible(self.near_each_other(members).unionByName(pivots).distinct()), "near")
        # sets only of documents that still take part
        wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(regions.select(F.explode(F.array("pivot", "doc")).alias("doc_id"))).distinct()
        ids = self.kept(wanted, "compared")
        self.sets = self.kept(shingle_arrays(_rows(self.docs).join(ids, "doc_id"), t.words).dropDuplicates(["doc_id", "shingles"]), "sets")
        links = self.kept(self.links(self.measured(near)), "links")
        labels = components(self.spark, links)
        apart = self.kept(self.differences(self.open_regions(pivoted, labels)), "differences")
        placed = self.kept(self.cores(self.kept(self.centred(apart), "centred")), "placed")
        sure = placed.where("sure is not null").select(F.least("doc", "sure").alias("a"), F.greatest("doc", "sure").alias("b")).distinct()
        found = self.links(self.measured(self.possible(self.inner_pairs(self.prefixes(placed)))))
        found = self.kept(found.unionByName(sure), "inner-links")
        if not found.isEmpty():
            labels = components(self.spark, links.unionByName(found))
        rep = F.coalesce("rep", F.when(F.col("n") > 0, F.col("doc_id")))
        placed = keys.join(classes, ["fa", "fb", "n"], "left").withColumn("node", rep).join(labels, "node", "left")
        return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.coalesce("component", "node")), F.col("doc_id"))).alias("component_id"))


def linked_documents(spark: SparkSession, docs: DataFrame, similarity_percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least the given per cent.
    Copies of one set are one class; links between different sets are found exactly. A NULL, empty or blank text has no
    shingles and links with nothing. A row with a NULL doc_id links with nothing and has a NULL component. Rows that
    repeat a doc_id are one document, linked with whatever any of them links with. Other columns are not read.
    """
    return Join(spark, docs, Threshold(similarity_percent, 100, words)).run()


def one_of_each(spark: SparkSession, docs: DataFrame, similarity_percent: int = 80, words: int = 5) -> DataFrame:
    """``docs`` with one document of each group of linked ones, that of the smallest doc_id.

    Every row is a document: where ids are NULL or repeat, a hash of id and text stands in for the id (below all ids), so rows
    with different texts are judged by themselves and of equal rows one stays. Documents without words stay as they are
    (those with the same id and text: once).
    """
    path, repeated = workspace(spark, "linked-away"), workspace(spark, "repeated-ids")
    docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id").write.parquet(repeated)
    ids = spark.read.parquet(repeated)
    if ids.isEmpty():
        linked = linked_documents(spark, docs, similarity_percent, words)
        linked.where("doc_id <> component_id").select("doc_id").distinct().write.parquet(path)
        return docs.join(spark.read.parquet(path), "doc_id", "left_anti").select(docs.columns)
    row, shared, other = "row", "shared", "doc"
    rows = docs.select(F.struct(*docs.columns).alias(row))
    again = ids.select(F.col("doc_id").alias(other), F.lit(True).alias(shared))
    rows = rows.join(again, F.col("row.doc_id").eqNullSafe(F.col(other)), "left").select(row, F.coalesce(shared, F.lit(False)).alias(shared))
    stand_in = F.shiftright(F.xxhash64("row.doc_id", "row.text"), 2) - F.lit(1 << 62)
    keyed = rows.withColumn("doc_id", F.when(F.col(shared), stand_in).otherwise(F.col("row.doc_id")))
    linked = linked_documents(spark, keyed.select("doc_id", "row.text"), similarity_percent, words)
    linked.where("doc_id <> component_id").select("doc_id").distinct().write.parquet(path)
    kept = keyed.join(spark.read.parquet(path), "doc_id", "left_anti")
    once = kept.where(shared).dropDuplicates(["doc_id"])
    return kept.where(~F.col(shared)).unionByName(once).select("row.*")
