"""The table function from SQL, and the trend it follows."""

import pytest
from pyspark.sql import functions as F

from barwright.functions import tables as table_functions
from barwright.operators import structure
from barwright.plans import catalogue


def test_sql_breaks_equal_the_operator(spark, sf):
    m = catalogue.market(spark, sf)
    cols = ["symbol", "i", "price", "type", "side", "broken_level", "broken_i"]
    table_functions.register(spark)
    odd = m.bars.repartition(5).withColumn("type", F.lit("clash")).unionByName(m.bars.limit(1).withColumns({"type": F.lit("x"), "symbol": F.lit("nulls"), "close": F.lit(None).cast("double")}))
    odd.createOrReplaceTempView("odd_bars")
    for n in (2, 3):
        want = structure.structure_events(m.bars, structure.swings(m.bars, n)).select(cols)
        got = spark.sql(f"SELECT * FROM structure_events(TABLE(odd_bars), {n})").select(cols)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_sql_refuses_other_tables(spark):
    table_functions.register(spark)
    spark.range(3).createOrReplaceTempView("no_bars")
    with pytest.raises(Exception, match="columns"):
        spark.sql("SELECT * FROM structure_events(TABLE(no_bars))").collect()
    spark.sql("SELECT 'a' AS symbol, 1 AS i, 1D AS high, 1D AS low, 1D AS close WHERE false").createOrReplaceTempView("empty_bars")
    assert spark.sql("SELECT * FROM structure_events(TABLE(empty_bars))").collect() == []


def test_trend_is_the_last_break(spark, sf):
    m = catalogue.market(spark, sf)
    events = {}
    for r in m.events.collect():
        events.setdefault(r.symbol, []).append((r.i, r.side))
    for r in structure.current_trend(m.bars, m.events).collect():
        before = [e for e in sorted(events.get(r.symbol, [])) if e[0] <= r.i]
        assert r.trend == (before[-1][1] if before else None)
