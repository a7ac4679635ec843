import datetime as dt

from pyspark.sql import functions as F

from barwright.operators.bars import bars_from_ticks
from barwright.streaming import live


def test_stream_bars_equal_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")
    src.write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")).withColumn("seq", F.struct("ts", "event_id"))
    seen = []
    live.each_batch(live.stream_bars(ticks), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    batch = bars_from_ticks(src.withColumn("seq", F.struct("ts", "event_id")), "1 hour")
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in batch.collect()}
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in seen}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())


def test_stream_alerts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", "bull", t0, 50.0), ("A", "bull", t0 + dt.timedelta(days=1), 55.0), ("A", "bull", t0 + dt.timedelta(days=2), 70.0), ("A", "bull", t0 + dt.timedelta(days=8), 70.0)]
    spark.createDataFrame(rows, "symbol string, side string, at timestamp, score double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("symbol string, side string, at timestamp, score double").parquet(str(tmp_path / "in"))
    seen = []
    live.each_batch(live.stream_alerts(s), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.score for r in seen) == [50.0, 70.0, 70.0]


def in_files(spark, df, path, parts):
    """df as a stream that brings the given parts (filters) one after the other; file times tell the order."""
    import os

    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.parquet(f"{path}/{k}")
    os.makedirs(f"{path}/all")
    for k in range(len(parts)):
        for f in os.listdir(f"{path}/{k}"):
            if f.startswith("part-"):
                os.rename(f"{path}/{k}/{f}", f"{path}/all/{k}.parquet")
                os.utime(f"{path}/all/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/all")


def collected(stream, where):
    rows = []
    live.each_batch(stream, lambda df, n: rows.extend(df.collect()), where).awaitTermination(240)
    return rows


def test_alerts_without_a_score_and_old_state(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", "bull", t0, 50.0), ("A", "bull", t0, None), ("B", "bull", None, 50.0), ("C", "bull", t0 + dt.timedelta(days=30), 50.0), ("A", "bull", t0 + dt.timedelta(days=31), 51.0)]
    df = spark.createDataFrame(rows, "symbol string, side string, at timestamp, score double").coalesce(1)
    stream = in_files(spark, df, str(tmp_path / "in"), ["at IS NULL OR at < '2024-01-05'", "symbol = 'C'", "at > '2024-01-31 12:00:00'"])
    assert sorted((r.symbol, r.score) for r in collected(live.stream_alerts(stream), str(tmp_path / "cp"))) == [("A", 50.0), ("A", 51.0), ("C", 50.0)]


POSITIONS = "symbol string, ts timestamp, entry_price double, stop double, high double, close double, atr double"


def position_moves():
    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    bars = [("A", t(k), None, None, 100.0 + k, 99.0 + k, 2.0) for k in range(6)] + [("A", t(6), None, None, 106.0, 101.0, 9.0), ("A", t(7), None, None, 103.0, 94.0, 9.0), ("A", t(8), None, None, 120.0, 119.0, 2.0)]
    return [("A", t(1), 100.0, None, None, None, None), ("A", t(2), 100.0, 97.0, None, None, None), ("B", t(0), 50.0, 40.0, None, None, None), ("B", t(1), None, None, 55.0, 54.0, None),
            ("A", t(3), None, None, None, None, 1.0), *bars, ("Z", t(90), None, None, 1.0, 1.0, 1.0), ("Z", t(91), None, None, 1.0, 1.0, 1.0)]


def test_positions_ratchet_and_expire(spark, tmp_path):
    df = spark.createDataFrame(position_moves(), POSITIONS)
    parts = ["entry_price IS NOT NULL OR ts < '2024-01-04'", "entry_price IS NULL AND ts >= '2024-01-04' AND ts < '2024-01-08'", "entry_price IS NULL AND ts >= '2024-01-08' AND ts < '2024-02-01'", "ts = '2024-03-31'", "ts = '2024-04-01'"]
    from barwright.streaming import state

    rows = collected(state.stream_positions(in_files(spark, df, str(tmp_path / "in"), parts), 3.0), str(tmp_path / "cp"))
    by = {}
    for r in rows:
        by.setdefault((r.symbol, r.entry_ts.day), []).append(r)
    a = sorted((r for r in by["A", 2]), key=lambda r: r.ts)
    # The range widens on day 7: the batch form would drop the stop to 106 - 27, the stream keeps 105 - 6.
    assert [r.stop for r in a] == [95.0, 96.0, 97.0, 98.0, 99.0, 99.0, 99.0] and [r.breached for r in a] == [False] * 6 + [True]
    assert [r.n_bars for r in a] == list(range(1, 8)) and a[-1].ts.day == 8 and a[4].locked_in is False
    b = sorted((r for r in by["B", 1]), key=lambda r: r.n_bars)
    assert [(r.stop, r.expired) for r in b] == [(40.0, False), (40.0, True)] and ("Z", 1) not in by


def test_positions_equal_batch_where_the_range_is_steady(spark, tmp_path):
    from barwright.operators import tracking
    from barwright.streaming import state

    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    bars = [(s, t(k), k, 100.0 + (k * 7 % 11), 99.0 + (k * 5 % 9), 20.0) for s in "AB" for k in range(20)]
    held = [("A", t(3), 100.0, None), ("B", t(5), 101.0, 60.0)]
    ind = spark.createDataFrame(bars, "symbol string, ts timestamp, i int, high double, close double, atr double")
    p = spark.createDataFrame([(s, x.strftime("%Y-%m-%d"), e, stop) for s, x, e, stop in held], "symbol string, entry_date string, entry_price double, stop double")
    want = {r.symbol: (r.n_bars, r.peak, r.last, r.initial_stop, r.stop, r.locked_in, r.breached) for r in tracking.track_positions(p, ind.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()}
    moves = [(s, x, e, stop, None, None, None) for s, x, e, stop in held] + [(s, x, None, None, h, c, a) for s, x, _, h, c, a in bars]
    stream = in_files(spark, spark.createDataFrame(moves, POSITIONS), str(tmp_path / "in"), ["entry_price IS NOT NULL", *(f"entry_price IS NULL AND day(ts) {c}" for c in ("<= 8", "BETWEEN 9 AND 14", "> 14"))])
    last = {}
    for r in sorted(collected(state.stream_positions(stream), str(tmp_path / "cp")), key=lambda r: r.ts):
        last[r.symbol] = (r.n_bars, r.peak, r.last, r.initial_stop, r.stop, r.locked_in, r.breached)
    assert last == want


def test_flips_equal_batch(spark, sf, tmp_path):
    from barwright.plans import catalogue
    from barwright.plans.config import Config
    from barwright.streaming import state

    m = catalogue.market(spark, sf, Config(gap_min_atr=0.0)).keep()
    few = m.bars.select("symbol").distinct().orderBy("symbol").limit(4)
    own = lambda df: df.join(few, "symbol", "left_semi")
    bull, eqh = F.col("side") == "bullish", F.col("kind") == "EQH"
    parts = [
        (own(m.order_blocks), F.concat_ws("-", F.lit("ob"), "start_i", "side"), "event_i", "mitigated_i", F.col("top"), F.col("bottom"), False),
        (own(m.gaps), F.concat_ws("-", F.lit("gap"), "end_i"), "end_i", "filled_i", F.when(bull, F.col("top")), F.when(~bull, F.col("bottom")), False),
        (own(m.pools), F.concat_ws("-", F.lit("pool"), "kind", "a_i", "b_i"), "conf_i", "swept_i", F.when(~eqh, F.col("price")), F.when(eqh, F.col("price")), True),
    ]
    moves, want = state.bar_moves(own(m.bars)), {}
    for df, name, known, flip, top, bottom, strict in parts:
        df = df.withColumn("name", name)
        moves = moves.unionByName(state.level_moves(df, "name", known, top, bottom, strict))
        want |= {(r.symbol, r.name): r[flip] for r in df.where(F.col(flip).isNotNull()).collect()}
    assert len(want) > 100
    stream = in_files(spark, moves, str(tmp_path / "in"), ["i < 60", "i >= 60 AND i < 150", "i >= 150"])
    rows = collected(state.stream_flips(stream), str(tmp_path / "cp"))
    assert {(r.symbol, r.level): r.flip_i for r in rows} == want and len(rows) == len(want)


def test_a_batch_is_sent_once(spark, tmp_path):
    import pytest
    from barwright.streaming import outbox

    df = spark.createDataFrame([(k,) for k in range(6)], "k int")
    stream = in_files(spark, df, str(tmp_path / "in"), ["k < 2", "k BETWEEN 2 AND 3", "k > 3"])
    sent, kept, folder = [], [], str(tmp_path / "box")

    def keep(rows):
        kept.append(sorted(r.k for r in rows.collect()))
        if len(kept) == 2:
            raise RuntimeError("lost while keeping")

    send = lambda rows, name: sent.append((name, sorted(r.k for r in rows.collect())))
    with pytest.raises(Exception, match="lost while keeping"):
        outbox.send_once(stream, send, folder, keep).awaitTermination(120)
    outbox.send_once(stream, send, folder, keep).awaitTermination(120)
    assert sent == [("batch-0", [0, 1]), ("batch-1", [2, 3]), ("batch-2", [4, 5])]
    assert kept == [[0, 1], [2, 3], [2, 3], [4, 5]]
    outbox.send_once(stream, send, folder, keep).awaitTermination(120)
    assert len(sent) == 3
