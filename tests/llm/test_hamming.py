import random

from pyspark.sql import functions as F

from drayline.llm import hamming


def test_codes_beyond_the_bound_are_dropped_where_they_are_met(spark, monkeypatch):
    rng = random.Random(5)
    vectors = [(i, [rng.choice((-1.0, 1.0)) for _ in range(64)]) for i in range(2000)]
    vectors += [(2000 + i, vectors[i][1]) for i in range(30)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    met = []
    nearest = hamming.Search.nearest

    def counted(self, found, reach):
        met.append(found.count())
        return nearest(self, found, reach)

    monkeypatch.setattr(hamming.Search, "nearest", counted)
    rows = hamming.top_k(spark, frame, frame.where("vec_id % 50 = 0"), 10).collect()
    codes = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in vectors]
    expected = set()
    for q, own in codes[::50]:
        ranked = sorted(((own ^ c).bit_count(), i) for i, c in codes if i != q)[:10]
        expected |= {(q, i, d, rank) for rank, (d, i) in enumerate(ranked, 1)}
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)
    # a round without bounds meets about half of all codes, 41 * 1000 pairs
    assert len(met) > 2 and max(met[2:]) < 41 * 100


def test_many_look_ups_do_not_pass_the_driver(spark, plan, monkeypatch):
    """A lone query without near codes: its look-ups are many, though they are made of few rows."""
    rng = random.Random(6)
    vectors = [(i, [rng.choice((-1.0, 1.0)) for _ in range(64)]) for i in range(2000)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    plans = []
    met = hamming.Search.codes_met

    def seen(self, *of):
        found = met(self, *of)
        found.collect()
        plans.append(plan(found))
        return found

    monkeypatch.setattr(hamming.Search, "codes_met", seen)
    monkeypatch.setattr(hamming, "TASK_LOOKUPS", 1 << 10)  # they are dealt to tasks first, so the planner learns the size of the rows
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        rows = hamming.Search(spark, 10, 64, 16).run(frame, frame.where("vec_id = 0")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    codes = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in vectors]
    near = sorted(((codes[0][1] ^ c).bit_count(), i) for i, c in codes[1:])[:10]
    assert sorted((r["rank"], r.distance, r.neighbor_id) for r in rows) == [(n, d, i) for n, (d, i) in enumerate(near, 1)]
    # the last round has flipped five bits or more of each segment of 16: 4 * 4368 look-ups
    assert near[-1][0] >= 20
    assert "BroadcastHashJoin Inner" not in plans[-1] and "SortMergeJoin" in plans[-1]
    assert max(map(len, plans)) < 100_000


def test_segments_are_alike_and_flips_complete(spark):
    assert hamming.segment_bits(64, 19) == [16] * 4 and hamming.segment_bits(64, 11) == [11] * 4 + [10] * 2
    one = spark.range(1)
    for bits, radius in ((7, 0), (7, 1), (7, 3), (7, 7), (8, 5), (1, 1), (2, 3)):
        found = one.select(hamming.flipped(F.lit(5).cast("long").bitwiseAND(F.lit((1 << bits) - 1)), radius, bits).alias("v")).first()["v"]
        assert sorted(found) == [v for v in range(1 << bits) if (v ^ 5 & (1 << bits) - 1).bit_count() == radius]


def test_codes_of_several_words(spark):
    rng = random.Random(7)
    vectors = [(i, [rng.choice((-1.0, 1.0)) for _ in range(150)]) for i in range(120)]
    vectors += [(200 + i, [x if rng.random() > 0.03 else -x for x in vectors[i % 5][1]]) for i in range(60)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    codes = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in vectors]
    expected = set()
    for q, own in codes[::6]:
        ranked = sorted(((own ^ c).bit_count(), i) for i, c in codes if i != q)[:4]
        expected |= {(q, i, d, rank) for rank, (d, i) in enumerate(ranked, 1)}
    queries = frame.where(F.col("vec_id").isin([i for i, _ in codes[::6]]))
    assert {tuple(r) for r in hamming.Search(spark, 4, 150, 11).run(frame, queries).collect()} == expected
