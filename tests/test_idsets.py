from pyspark.sql import functions as F

from harborline.operators import idsets as I


def as_sets(df):
    out = {}
    for r in df.collect():
        assert r.ids == sorted(set(r.ids)) and r.n == len(r.ids)
        assert not out.setdefault(r.key, set()) & set(r.ids)
        out[r.key] |= set(r.ids)
    return out


def test_chunks_are_bounded_and_whole(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 29_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.concat(F.lit("r"), F.col("id") % 25_000).alias("raw"))
    sets = I.id_sets(rows.unionByName(spark.createDataFrame([("none", None), ("hot", None)], "key string, raw string")), ["key"], "raw", per_chunk=64)
    got = as_sets(sets)
    want = {}
    for r in rows.collect():
        want.setdefault(r.key, set()).add(r.raw)
    assert got == want and "none" not in got
    assert max(r.n for r in sets.collect()) < 200 and sets.where("key = 'hot'").count() > 200 and sets.where("key = 'k1'").count() == 1
    sizes = {r.key: (r.n_ids, r.first_id) for r in I.set_sizes(sets, ["key"]).collect()}
    assert sizes == {k: (len(v), min(v)) for k, v in want.items()}
    assert I.members(sets, ["key"]).count() == sum(map(len, want.values()))


def test_merge_is_union(spark):
    a = spark.createDataFrame([("k", i) for i in range(200)] + [("a", 1)], "key string, raw long")
    b = spark.createDataFrame([("k", i) for i in range(150, 900)] + [("b", 2), ("a", 1)], "key string, raw long")
    one, two = I.id_sets(a, ["key"], "raw", 32), I.id_sets(b, ["key"], "raw", 32)
    both = I.merge_sets(one, two, ["key"], 32)
    assert as_sets(both) == {"k": set(range(900)), "a": {1}, "b": {2}}
    assert sorted(map(repr, both.collect())) == sorted(map(repr, I.id_sets(a.unionByName(b), ["key"], "raw", 32).collect()))
