import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from quotecraft.operators import returns as R
from quotecraft.params import W_SHORT
from quotecraft.plans.study import Study
from quotecraft.session import local_path, new_table_path
from quotecraft.streaming import (compact, current_prices, current_returns, start_daily_refresh,
                                  write_daily_files)

SYMBOLS = ("U1", "U2", "U3", "U7", "SP500TR")


def _prices(st):
    return st.eod_r.where(F.col("symbol").isin(*SYMBOLS)).select(
        "symbol", "date", F.col("adj_close").cast("float").alias("adj_close"))


def _run(spark, st, incoming, path, checkpoint, files):
    q = start_daily_refresh(spark, incoming, st.calendar, path, checkpoint, files_per_batch=files)
    assert q.awaitTermination(300)


def test_streamed_returns_equal_batch_returns_with_late_day(spark):
    st = Study(spark, "/root/testdata/sf0.01", W_SHORT)
    prices = _prices(st)
    late = dt.date(2024, 1, 10)
    incoming, path, ckpt = (new_table_path(spark, n) for n in ("incoming", "stream-rows", "stream-ckpt"))
    # all days but one, then a second start of the stream with the late day
    write_daily_files(prices.where(F.col("date") != F.lit(late)), incoming)
    _run(spark, st, incoming, path, ckpt, 4)
    early = {(r.symbol, r.date) for r in current_returns(spark, path).collect()}
    prices.where(F.col("date") == F.lit(late)).write.parquet(f"{incoming}/arrival=late")
    _run(spark, st, incoming, path, ckpt, 4)
    streamed = {(r.symbol, r.date): r.ret for r in current_returns(spark, path).collect()}
    batch = {(r.symbol, r.date): r.ret for r in R.strict_returns(prices, st.calendar).collect()}
    assert streamed == batch
    after = dt.date(2024, 1, 11)
    assert any(k[1] == late for k in batch) and any(k[1] == after for k in batch)
    assert not any(d in (late, after) for _, d in early)
    assert sorted(current_prices(spark, path).collect()) == sorted(prices.collect())
    # a start without new files changes nothing
    _run(spark, st, incoming, path, ckpt, 4)
    assert {(r.symbol, r.date): r.ret for r in current_returns(spark, path).collect()} == batch
    table = spark.read.parquet(compact(spark, path, new_table_path(spark, "stream-compact")))
    assert table.count() == prices.count() and table.where("has_ret").count() == len(batch)


def test_corrected_price_and_replayed_batch(spark):
    """A price that comes again replaces the one before; a batch that runs again after a crash (its commit
    is missing) leaves the same rows once."""
    st = Study(spark, "/root/testdata/sf0.01", W_SHORT)
    prices = _prices(st)
    incoming, path, ckpt = (new_table_path(spark, n) for n in ("incoming", "stream-rows", "stream-ckpt"))
    write_daily_files(prices, incoming)
    _run(spark, st, incoming, path, ckpt, 1000)
    day = prices.where("symbol = 'SP500TR'").agg(F.min("date")).first()[0]
    fixed = prices.where((F.col("symbol") == "SP500TR") & (F.col("date") == F.lit(day))).withColumn(
        "adj_close", (F.col("adj_close") * 2).cast("float"))
    fixed.write.parquet(f"{incoming}/arrival=again")
    _run(spark, st, incoming, path, ckpt, 1000)
    now = prices.join(fixed.select("symbol", "date"), ["symbol", "date"], "left_anti").unionByName(fixed)
    want = {(r.symbol, r.date): r.ret for r in R.strict_returns(now, st.calendar).collect()}
    assert {(r.symbol, r.date): r.ret for r in current_returns(spark, path).collect()} == want
    rows = spark.read.parquet(path).count()
    last = max(glob.glob(f"{local_path(ckpt)}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for name in (os.path.basename(last), f".{os.path.basename(last)}.crc"):
        os.replace(f"{local_path(ckpt)}/commits/{name}", f"{local_path(ckpt)}/gone-{name}")
    _run(spark, st, incoming, path, ckpt, 1000)
    assert {(r.symbol, r.date): r.ret for r in current_returns(spark, path).collect()} == want
    assert spark.read.parquet(path).count() == rows


def test_a_batch_calls_python_once_per_bucket(spark, monkeypatch):
    """Forty symbols in three buckets: three calls a batch, the returns of single prices, two prices of one day, a
    missing symbol, missing, NaN and zero prices as the batch form has them."""
    import numpy as np
    import pandas as pd
    from quotecraft.streaming import daily_refresh as dr

    class Kept:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rng, state, seen, rows, sizes = np.random.default_rng(8), Kept(), {}, [], []
    days = list(range(19700, 19720))
    for part in ([1, 4, 5, 9], [0, 2, 3, 19], [6, 7, 8], [18, 2, 10, 11, 12, 13, 14, 15, 16, 17]):
        frame = [(s, days[d], float(np.float32(rng.choice([0.0, np.nan, rng.uniform(1, 9), rng.uniform(1, 9)]))),
                  days[d] - 1 if d % 5 else None, [days[d] + 1] if (d + 1) % 5 and d < 19 else [])
                 for d in part for s in [None, "", *(f"T{i}" for i in range(38))] for _ in range(2) if rng.random() < 0.8]
        pdf = pd.DataFrame(frame, columns=["symbol", "day", "adj_close", "prev", "nexts"]).sample(frac=1, random_state=1)
        batch = {}
        for s, day, price, _, _ in pdf.itertuples(index=False):
            batch[s, day] = np.fmax(batch.get((s, day), np.nan), price)
        seen |= batch
        out = pd.concat(dr._advance((0,), iter([pdf[:50], pdf[50:]]), state))
        sizes.append(len(out.drop_duplicates(["symbol", "day"])) == len(out))
        rows.append(out)
    assert all(sizes) and state.get[4] == 4
    last = pd.concat(rows).drop_duplicates(["symbol", "day"], keep="last")
    assert len(last) == len(seen) and {s for s, _ in seen} == {s for s in state.get[0]}
    for s, day, price, ret, has, _ in last.itertuples(index=False):
        s = s if isinstance(s, str) else None
        assert np.float32(price) == np.float32(seen[s, day]) or np.isnan(price) and np.isnan(seen[s, day])
        assert has == ((day - 19700) % 5 != 0 and (s, day - 1) in seen)
        if has:
            with np.errstate(divide="ignore", invalid="ignore"):
                want = float(np.float32(seen[s, day]) / np.float32(seen[s, day - 1])) - 1.0
            assert ret == want or np.isnan(ret) and np.isnan(want)
    # the stream itself: as many states as buckets
    monkeypatch.setattr(dr, "BUCKETS", 3)
    st = Study(spark, "/root/testdata/sf0.01", W_SHORT)
    incoming, path, ckpt = (new_table_path(spark, n) for n in ("incoming", "stream-rows", "stream-ckpt"))
    prices = st.eod_r.where("symbol like 'U%'").select("symbol", "date", F.col("adj_close").cast("float").alias("adj_close"))
    write_daily_files(prices, incoming)
    q = start_daily_refresh(spark, incoming, st.calendar, path, ckpt, files_per_batch=1000)
    assert q.awaitTermination(300)
    assert prices.select("symbol").distinct().count() >= 40
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    want = {(r.symbol, r.date): r.ret for r in R.strict_returns(prices, st.calendar).collect()}
    assert {(r.symbol, r.date): r.ret for r in current_returns(spark, path).collect()} == want
