"""Exact top-k search in binary codes by incremental multi-index hashing, in DataFrame functions only.

A code is cut into segments of equal width, to a bit, each with an index from value to codes. A round with radius r looks up every
segment value within r bit flips. After it, each code at a distance below segments * (r + 1) has been met in some segment,
so a query whose kth nearest distance is below that bound is finished; the others go on with r + 1. The first round asks for the first
segment alone, for a kth distance to begin with. The kth distance so far bounds what is
still of use: codes beyond it are dropped where they are met, and of the m segments only the first a are looked up with radius r once
it is below m * r + a, as all codes below that distance have then been met. A code is taken only where it is met first, by radius and then by
segment, so no pair has to be found among its repetitions.

Equal codes are one entry of the index and equal query codes are searched once, so copies of a vector meet no one in
pairs. A code keeps its k + 1 smallest ids, which is all that a ranking by distance and id can use of it.

Look-ups are made on the executors and stay there: the driver holds the masks of half a segment, whatever the radius, and sees look-ups
only where they are few.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drayline.session import workspace

LEAST_BITS, MOST_BITS = 4, 24
#: Bits of a word that holds a part of a code.
WORD = 64
#: Look-ups of a task; each meets about sixteen codes.
TASK_LOOKUPS = 1 << 15
#: So many look-ups go to every task; more are shuffled, however small the rows they are made of look to the planner.
FEW_LOOKUPS = 1 << 14


def segment_width(codes: int) -> int:
    """So many bits that a segment value is shared by about sixteen codes: wider means more look-ups, narrower more codes
    to compare."""
    return min(MOST_BITS, max(LEAST_BITS, max(1, codes).bit_length() - 5))


def segment_bits(dimensions: int, width: int) -> list[int]:
    """Bits of each segment, like ones: as many segments as the width asks for. A short one would be shared by a large part of the codes."""
    parts = -(-dimensions // width)
    return [dimensions // parts + (i < dimensions % parts) for i in range(parts)]


def signs(vector: Column, dimensions: int) -> list[Column]:
    """Signs of the components as bits of words; a missing or NULL component is 0, as one that is not positive."""
    out = []
    for low in range(0, dimensions, WORD):
        held = [(1 << b) - ((1 << WORD) if b == WORD - 1 else 0) for b in range(min(WORD, dimensions - low))]
        bits = [F.when(F.get(vector, F.lit(low + b)) > 0, F.lit(m).cast("long")).otherwise(F.lit(0).cast("long")) for b, m in enumerate(held)]
        out.append(reduce(Column.bitwiseOR, bits))
    return out


def segment(words: list[Column], low: int, bits: int) -> Column:
    """The value of the segment that begins at a bit of the code."""
    first, at = divmod(low, WORD)
    value = F.shiftrightunsigned(words[first], at)
    if at + bits > WORD:
        value = value.bitwiseOR(F.shiftleft(words[first + 1], WORD - at))
    return value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def flipped(own: Column, radius: int, bits: int) -> Column:
    """The values that differ from a segment's in exactly ``radius`` bits, as an array. Masks of its upper and its lower half are
    combined in the row, so the plan holds 2 ** (bits / 2) numbers of each at most."""
    lower = bits // 2
    low, high = ([[m for m in range(1 << n) if m.bit_count() == c] for c in range(n + 1)] for n in (lower, bits - lower))

    def both(above: Column, below: Column) -> Column:
        return F.flatten(F.transform(above, lambda h: F.transform(below, lambda m: own.bitwiseXOR(h).bitwiseXOR(m))))

    parts = [both(_longs([m << lower for m in high[c]]), _longs(low[radius - c])) for c in range(max(0, radius - lower), min(radius, bits - lower) + 1)]
    return F.concat(*parts) if parts else F.array().cast("array<bigint>")


class Search:
    def __init__(self, spark: SparkSession, k: int, dimensions: int, width: int) -> None:
        self.spark, self.k, self.dimensions = spark, k, dimensions
        self.bits = segment_bits(dimensions, width)
        self.lows = [sum(self.bits[:i]) for i in range(len(self.bits))]
        self.words = [f"w{i}" for i in range(-(-dimensions // WORD))]

    def kept(self, frame: DataFrame, label: str) -> DataFrame:
        path = workspace(self.spark, label)
        frame.write.parquet(path)
        return self.spark.read.parquet(path)

    def coded(self, vectors: DataFrame) -> DataFrame:
        words = [c.alias(w) for c, w in zip(signs(F.col("embedding"), self.dimensions), self.words)]
        return vectors.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), *words)

    def differing(self) -> list[Column]:
        return [F.col("q" + w).bitwiseXOR(F.col("c" + w)) for w in self.words]

    def apart(self) -> Column:
        each = [F.bit_count(d).cast("int") for d in self.differing()]
        return sum(each[1:], each[0])

    def met_first(self, radius: int) -> Column:
        """Whether the segment is the first of those that differ in ``radius`` bits, and none differs in fewer."""
        each = [F.bit_count(segment(self.differing(), low, bits)) for low, bits in zip(self.lows, self.bits)]
        own, here = F.col("segment"), F.lit(True)
        for i, differs in enumerate(each):
            here = here & F.when(own > i, differs > radius).otherwise(differs >= radius)
        return here

    def codes_met(self, queries: DataFrame, how_many: int, index: DataFrame, radius: int, first: int, last: int) -> DataFrame:
        """(query, code, held, distance) of the codes with a segment, from ``first`` to ``last``, at exactly this radius of the query's,
        but those met before, those beyond its ``bound`` and those that are met otherwise if within it."""
        own = [segment([F.col(w) for w in self.words], low, bits) for low, bits in zip(self.lows, self.bits)][first : last + 1]
        asked = queries.select("bound", F.col("code").alias("query"), *(F.col(w).alias("q" + w) for w in self.words), F.posexplode(F.array(*own)).alias("segment", "own"))
        asked = asked.withColumn("segment", (F.col("segment") + first).cast("int"))
        asked = asked.where(f"bound is null or segment <= bound - {len(self.bits) * radius}")
        lookups = how_many * sum(comb(bits, radius) for bits in self.bits[first : last + 1])
        tasks = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), lookups // TASK_LOOKUPS)
        if tasks > 1:
            asked = asked.repartition(tasks, "query", "segment")
        values = F.col("own")
        if radius:
            wide, narrow = max(self.bits), min(self.bits)
            is_wide = F.col("segment") < self.bits.count(wide)
            values = flipped(F.col("own"), radius, wide)
            if narrow < wide:
                values = F.when(is_wide, values).otherwise(flipped(F.col("own"), radius, narrow))
            values = F.explode(values)
        asked = asked.withColumn("value", values).withColumn("key", F.shiftleft(F.col("segment").cast("long"), MOST_BITS).bitwiseOR(F.col("value"))).drop("own", "value")
        # the planner knows the size of the rows that look-ups are made of, and would have the driver collect them all
        asked = asked.hint("broadcast" if lookups <= FEW_LOOKUPS else "merge")
        met = index.where(F.col("key") >= first << MOST_BITS).where(F.col("key") < (last + 1) << MOST_BITS).join(asked, "key")
        met = met.where(F.col("bound").isNull() | (self.apart() <= F.col("bound"))).where(self.met_first(radius))
        return met.select("query", "code", "held", self.apart().alias("distance"))

    def nearest(self, met: DataFrame, reach: int) -> DataFrame:
        """Of the codes met by each query, the nearest that can hold its k nearest ids beside its own, the distance ``bound`` within which
        these lie, and whether they are proven: all codes at a distance below ``reach`` have been met."""
        first = Window.partitionBy("query").orderBy("distance", "code")
        upto = Window.partitionBy("query").orderBy("distance", "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        query = Window.partitionBy("query")
        near = met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= self.k + 1).drop("place")
        full = near.withColumn("so_far", F.sum("held").over(upto))
        kth = F.min(F.when(F.col("so_far") >= self.k + 1, F.col("distance"))).over(query)
        return full.withColumn("bound", kth).withColumn("proven", F.coalesce(F.col("bound") < reach, F.lit(False))).drop("so_far")

    def run(self, vectors: DataFrame, queries: DataFrame) -> DataFrame:
        ranked = self.coded(vectors).distinct().withColumn("place", F.row_number().over(Window.partitionBy(*self.words).orderBy("vec_id"))).where(F.col("place") <= self.k + 1)
        ids = F.array_sort(F.collect_list("vec_id"))
        codes = self.kept(ranked.groupBy(*self.words).agg(ids.alias("ids")).withColumn("code", F.element_at("ids", 1)).withColumn("held", F.size("ids")), "codes")
        keys = F.array(*[segment([F.col(w) for w in self.words], low, bits).bitwiseOR(F.lit(i << MOST_BITS).cast("long")) for i, (low, bits) in enumerate(zip(self.lows, self.bits))])
        index = self.kept(codes.select("code", "held", *(F.col(w).alias("c" + w) for w in self.words), F.explode(keys).alias("key")), "code-index")
        # a query code that no vector has is searched under its own smallest id, told apart by its sign
        own = F.coalesce("code", -F.min("vec_id").over(Window.partitionBy(*self.words)) - 1)
        asked = self.kept(self.coded(queries).distinct().join(codes.drop("ids", "held"), self.words, "left").withColumn("code", own), "query-codes")
        active = self.kept(asked.select("code", *self.words).distinct().withColumn("bound", F.lit(None).cast("int")), "active")
        how_many = active.count()
        done: list[DataFrame] = []
        met: DataFrame | None = None
        last = len(self.bits) - 1
        rounds = [(0, 0, 0), *([(0, 1, last)] if last else []), *((r, 0, last) for r in range(1, max(self.bits) + 1))]
        for radius, first, until in rounds:
            found = self.codes_met(active, how_many, index, radius, first, until)
            if met is not None:
                found = found.unionByName(met)
            near = self.kept(self.nearest(found, len(self.bits) * radius + until + 1), "nearest")
            if radius == max(self.bits):  # every code has been met
                done.append(near)
                break
            done.append(near.where("proven"))
            state = near.select(F.col("query").alias("code"), "proven", "bound").distinct()
            active = self.kept(active.drop("bound").join(state, "code", "left").where("proven is null or not proven").drop("proven"), "active")
            how_many = active.count()
            if not how_many:
                break
            met = near.where("not proven").drop("proven", "bound")
        best = done[0]
        for more in done[1:]:
            best = best.unionByName(more)
        neighbours = best.select("query", "code", "distance").join(codes.select("code", F.explode("ids").alias("neighbor_id")), "code")
        pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).join(neighbours, "query").where("query_id <> neighbor_id")
        order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select("query_id", "neighbor_id", "distance", "rank")


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, dimensions: int | None = None) -> DataFrame:
    """The ``k`` vectors nearest to each query by Hamming distance of their sign codes: query_id, neighbor_id, distance, rank.

    Exact, with ties by id; a query is no neighbour of itself. Rows without an id or vector are left out, and repeated rows
    count once. ``dimensions`` is the length of the longest vector where not given; shorter vectors are filled with 0. With
    fewer than k other vectors all are returned. Other columns are not read. Empty tables give no rows.
    """
    size = vectors.agg(F.max(F.size("embedding")).alias("dimensions"), F.count("*").alias("rows")).first()
    dimensions = max(1, dimensions or size["dimensions"] or 1)
    return Search(spark, k, dimensions, min(dimensions, segment_width(size["rows"]))).run(vectors, queries)
