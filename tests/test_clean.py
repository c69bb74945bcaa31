from pyspark.sql import functions as F

from semspace.functions import scores as S
from semspace.functions import text as T
from semspace.operators import clean as C
from semspace.operators import features as X
from semspace.operators import skew
from semspace.operators.skew import hot_keys, salted_lookup


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


def test_short_text_edges(spark):
    f = T.short_text(F.col("t"))
    assert one(spark, f, t="x" * 240) == "x" * 240
    assert one(spark, f, t="x" * 241) == "x" * 240 + "…"
    assert one(spark, f, t=" a\nb ") == "a b"
    assert one(spark, f, t=None) == ""


def test_item_text_forms(spark):
    full, plain = T.item_text(F.lit("N"), F.col("t")), T.item_text_plain(F.lit("N"), F.col("t"))
    assert one(spark, full, t="  d ") == "N. d" and one(spark, plain, t="  d ") == "N.   d "
    assert one(spark, full, t=None) == "N" and one(spark, plain, t=None) == "N. "
    assert one(spark, full, t="x" * 9000) == "N. " + "x" * 9000
    assert one(spark, T.item_text(F.lit("N"), F.col("t"), 8000), t="x" * 9000) == "N. " + "x" * 8000


def test_numbers_and_missing_tokens(spark):
    values = ["1.5", " 2 ", "abc", "NaN", "", None, "1e3"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r[0] for r in df.select(T.try_number(F.col("t"))).collect()] == [1.5, 2.0, None, None, None, None, 1000.0]
    kept = df.select(T.na_to_null(F.col("t"), ["abc"])).collect()
    assert kept[2][0] is None and kept[3][0] == "NaN"


def test_space_case_and_pair_key(spark):
    assert one(spark, T.space_case(F.col("t")), t="HeroOfTVShow9Lives") == "Hero Of TV Show9 Lives"
    assert one(spark, T.pair_key(F.col("a"), F.col("b")), a="i2", b="i10") == "i10+i2"


def test_dominant_ties_and_none(spark):
    rows = [(0, 0, 0), (2, 2, 0), (0, 1, 1), (0, 0, 3)]
    df = spark.createDataFrame(rows, "f long, t long, l long")
    got = [r[0] for r in df.select(S.dominant([("film", F.col("f")), ("tv", F.col("t")), ("lit", F.col("l"))])).collect()]
    assert got == ["unused", "film", "tv", "lit"]


def test_keep_first_of_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                  (2000 - F.col("id")).alias("ord"), F.col("id").alias("x"))
    got = {r["k"]: r["x"] for r in C.keep_first(df, ["k"], "ord").collect()}
    assert got["hot"] == 1999 and len(got) == 668


def test_dense_index_both_ways(spark):
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("h"), "id")
    small = {r["id"]: r["idx"] for r in C.dense_index(df, ["h"]).collect()}
    large = {r["id"]: r["idx"] for r in C.dense_index(df, ["h"], small_rows=10).collect()}
    assert small == large and sorted(small.values()) == list(range(5000))


def test_salted_lookup_equals_plain_join(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(
        F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 50, 2)]], "k string, x int")
    assert hot_keys(rows, "k", 100) == [("hot", 10)]
    for how in ("left", "inner"):
        salted = salted_lookup(rows, lookup, "k", how, hot_rows=100)
        plain = rows.join(lookup, "k", how)
        assert sorted(map(str, salted.select("id", "k", "x").collect())) == sorted(map(str, plain.select("id", "k", "x").collect()))


def test_legend_lookup_beyond_the_limit(spark, monkeypatch):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    legend = spark.createDataFrame([(0, "a"), (1, "b")], "k long, label string")
    small = sorted(map(tuple, skew.legend_lookup(rows, legend, "k").select("id", "label").collect()))
    monkeypatch.setattr(skew, "MAX_BROADCAST_ROWS", 1)
    assert sorted(map(tuple, skew.legend_lookup(rows, legend, "k").select("id", "label").collect())) == small


def test_first_usable_score_per_name(spark):
    scores = spark.createDataFrame([("A", "n/a", 0), ("A", "0.5", 1), ("A", "0.7", 2), ("B", "x", 3)],
                                   "name string, score string, ord long")
    items = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "item_id string, name string")
    got = {r["item_id"]: r["gender_ratio"] for r in X.name_score_lookup(items, scores).collect()}
    assert got == {"1": 0.5, "2": None, "3": None}


def test_row_parity(spark):
    a, b = spark.range(3).toDF("k"), spark.range(1, 5).toDF("k")
    assert sorted(map(tuple, C.row_parity(a, b, "k").collect())) == [(0, "left"), (3, "right"), (4, "right")]
    assert C.row_parity(a, a, "k").count() == 0


def test_numbers_have_no_suffix(spark):
    texts = ["1d", "2.5f", "0x1p3", "3.", ".5", "-1e3", " 7 ", "inf", "nan", "", "1e", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.try_number(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [None, None, None, 3.0, 0.5, -1000.0, 7.0, float("inf"), None, None, None, None]


def test_rows_without_key_keep_their_place(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), ("a", 2), ("b", 3)], "k string, n int")
    found = spark.createDataFrame([("a", 10), (None, 20)], "k string, m int")
    want = [(None, 1, None), (None, 1, None), ("a", 2, 10), ("b", 3, None)]
    for hot in (None, [("a", 3)]):
        got = salted_lookup(rows, found, "k", "left", hot=hot)
        assert got.columns == ["k", "n", "m"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
