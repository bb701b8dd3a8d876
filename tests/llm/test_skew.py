"""The salted join against a plain one."""

from pyspark.sql import functions as F

from ledgerline.llm import _skew


def test_salted_join_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(_skew, "SHARE", 8)  # a key with more than an eighth of the rows is hot
    rows = spark.range(4000).select(F.when(F.col("id") < 2500, 1).when(F.col("id") < 2600, None).otherwise(F.col("id") % 300).cast("long").alias("k"), F.col("id").alias("v"))
    facts = rows.where("k is not null").groupBy("k").agg(F.min("v").alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1 and k <> 7")
    expected = sorted(tuple(r) for r in rows.join(facts.drop("c"), "k").collect())
    assert sorted(tuple(r) for r in _skew.salted_join(rows, facts, ["k"], ["v"]).collect()) == expected
    semi = _skew.salted_join(rows, facts, ["k"], ["v"], "left_semi")
    assert semi.columns == ["k", "v"] and sorted(r.v for r in semi.collect()) == sorted(v for _, v, _ in expected)
    assert _skew.salted_join(rows, facts.where("false"), ["k"], ["v"]).count() == 0


def test_rows_of_a_hot_key_are_dealt_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(_skew, "SHARE", 8)
    seen = {}
    plain = type(spark.range(1)).join

    def join(self, other, *rest):
        if "_salt" in self.columns:
            seen["most"] = self.groupBy("k", "_salt").count().agg(F.max("count")).first()[0]
            seen["facts"] = other.count()
        return plain(self, other, *rest)

    rows = spark.range(8000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("v"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    monkeypatch.setattr(type(rows), "join", join)
    assert _skew.salted_join(rows, facts, ["k"], ["v"]).count() == 8000
    assert seen["facts"] == 8 and seen["most"] < 1200
