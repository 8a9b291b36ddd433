from pyspark.sql import functions as F

from quotecraft import schemas as SC
from quotecraft.operators import quality as Q
from quotecraft.params import W_LONG, W_SHORT
from quotecraft.plans.study import Study
from quotecraft.session import new_table_path
from quotecraft.sources import exports, loaders, tables
from quotecraft.sources.refresh import study_views
from quotecraft.operators import returns as R

SF = "/root/testdata/sf0.01"


def test_fixture_counts(spark):
    st = Study(spark, SF)
    assert st.quotes.count() == 40274
    assert st.indices.count() == 1807
    assert st.staging.count() == 1457
    assert st.nasdaq_null_sector.count() == 260


def test_refresh_is_stale_until_refreshed_in_order(spark):
    st = Study(spark, SF, W_SHORT)
    sv = study_views(st)
    offenders = R.extreme_return_symbols(sv.read("mv_ret"))
    bad = {r.ticker for r in offenders.collect()}
    assert bad
    sv.append("exclusions", offenders)
    stale = {r.symbol for r in sv.read("mv_eod").collect()}
    assert bad <= stale                                   # not excluded yet
    sv.refresh("mv_ret")                                  # wrong order: prices still stale
    assert bad & {r.symbol for r in sv.read("mv_ret").collect()}
    sv.refresh("mv_eod")
    sv.refresh("mv_ret")
    assert not bad & {r.symbol for r in sv.read("mv_eod").collect()}
    assert not bad & {r.symbol for r in sv.read("mv_ret").collect()}


def test_staging_csv_keeps_blanks(spark):
    st = Study(spark, SF).staging
    back = loaders.read_staging_csv(spark, loaders.write_csv(st, new_table_path(spark, "csv")))
    assert back.where(F.col("name").startswith("  ")).count() == st.count()


def test_wide_csv_round_trip(spark):
    st = Study(spark, SF, W_LONG)
    wide = exports.wide_csv_round_trip(spark, st.eod_ret, ["L1", "SP500TR"])
    assert wide.columns == ["date", "L1", "SP500TR"] and wide.count() == 1770


def test_overwrite_append_drop(spark):
    path = new_table_path(spark, "stock_mkt")
    mkt = spark.createDataFrame([("NASDAQ",)], SC.STOCK_MKT)
    tables.overwrite(mkt, path)
    tables.append(spark.createDataFrame([("AMEX",)], SC.STOCK_MKT), path)
    assert spark.read.parquet(path).count() == 2
    tables.overwrite(spark.createDataFrame([], SC.STOCK_MKT), path)      # TRUNCATE
    assert spark.read.parquet(path).count() == 0
    tables.drop(spark, path=path)
    assert not tables.exists(spark, path)
    v = tables.create_view(spark, mkt, "stock_mkt")
    assert v.count() == 1
    tables.drop(spark, name="stock_mkt")
    assert not spark.catalog.tableExists("stock_mkt")


def test_declared_schema_and_not_null(spark):
    c = SC.conform(Study(spark, SF).company_list_raw, SC.COMPANY_LIST)
    assert [f.dataType.simpleString() for f in c.schema.fields][:4] == ["string", "string", "string", "double"]
    v = Q.not_null_violations(c, SC.not_null_columns(SC.COMPANY_LIST), ["symbol"])
    assert v.count() == 0


def test_window_read_prunes(spark):
    st = Study(spark, SF)
    path = loaders.store_by_year(st.quotes, new_table_path(spark, "q"))
    df = loaders.read_window(spark, path, "1997-01-01", "1997-12-31", ["ticker", "date", "adj_close"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan
    assert df.select(F.min("date"), F.max("date")).first()[0].year == 1997


def test_company_file_per_market(spark):
    st = Study(spark, SF).staging
    nasdaq = st.where("exchange = 'NASDAQ'").drop("exchange")
    path = loaders.write_csv(nasdaq, new_table_path(spark, "nasdaq_csv"))
    back = loaders.read_company_file(spark, path, "NASDAQ")
    assert back.columns == st.columns
    assert sorted(back.collect()) == sorted(st.where("exchange = 'NASDAQ'").collect())


def test_index_download_thousands_separators(spark):
    import datetime as dt
    idx = spark.createDataFrame(
        [("SP500TR", dt.date(2024, 1, 2), 1234.5, 98765.25, 1.0, 4321.0, 4321.0, 0.0)],
        "symbol string, date date, open float, high float, low float, close float, adj_close float, "
        "volume double")
    raw = loaders.index_download_frame(idx)
    first = raw.first()
    assert first.Open == "1,234.5" and first.High == "98,765.25" and first.Volume == "-"
    back = loaders.read_index_csv(spark, loaders.write_csv(raw, new_table_path(spark, "idx_csv"))).first()
    assert (back.open, back.high, back.low, back.adj_close, back.volume) == (1234.5, 98765.25, 1.0, 4321.0, 0.0)


def test_append_enforces_primary_key(spark):
    import pytest
    from quotecraft.sources.refresh import StoredViews
    sv = StoredViews(spark)
    sv.store("exclusions", spark.createDataFrame([("A", "x")], "ticker string, reason string"))
    sv.append("exclusions", spark.createDataFrame([("B", "y")], "ticker string, reason string"), key=["ticker"])
    assert sv.read("exclusions").count() == 2
    with pytest.raises(ValueError):
        sv.append("exclusions", spark.createDataFrame([("A", "z")], "ticker string, reason string"), key=["ticker"])
    assert sv.read("exclusions").count() == 2


def _views(spark, exclusions):
    """Stored exclusions, prices without the excluded symbols, and a count per symbol on top."""
    from quotecraft.sources.refresh import StoredViews
    prices = spark.createDataFrame([(s, d, float(d)) for s in "ABCDE" for d in range(4)], "symbol string, day int, px double")
    sv, built = StoredViews(spark), []
    sv.store("exclusions", spark.createDataFrame([(t,) for t in exclusions], "ticker string"), key="ticker")

    def kept(v, symbols=None):
        built.append(None if symbols is None else {r.symbol for r in symbols.collect()})
        rows = prices if symbols is None else prices.join(symbols, "symbol", "left_semi")
        return rows.join(v.read("exclusions").withColumnRenamed("ticker", "symbol"), "symbol", "left_anti")

    def counts(v, symbols=None):
        rows = v.read("prices")
        rows = rows if symbols is None else rows.join(symbols, "symbol", "left_semi")
        return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))

    sv.define("prices", kept, on=["exclusions"], part=kept)
    sv.define("counts", counts, on=["prices"], part=counts)
    sv.refresh("prices")
    sv.refresh("counts")
    return sv, built


def test_refresh_of_changed_symbols_equals_rebuild(spark):
    sv, built = _views(spark, "AB")
    read = lambda n: sorted(tuple(r) for r in sv.read(n).collect())
    sv.append("exclusions", spark.createDataFrame([("C",)], "ticker string"), key=["ticker"])
    assert {s for s, *_ in read("prices")} == set("CDE")            # stale
    assert sv.refresh_changed("prices") and sv.refresh_changed("counts")
    assert built[-1] == {"C"}                                       # nothing else was derived again
    assert {s for s, *_ in read("prices")} == set("DE") and read("counts") == [("D", 4), ("E", 4)]
    # another version of the list: A comes back, E goes; the change is the difference of the versions
    sv.store("exclusions", spark.createDataFrame([("B",), ("C",), ("E",)], "ticker string"), key="ticker")
    assert sv.refresh_changed("prices") and sv.refresh_changed("counts")
    assert built[-1] == {"A", "E"}
    changed = (read("prices"), read("counts"))
    sv.refresh("prices")
    sv.refresh("counts")
    assert changed == (read("prices"), read("counts")) and {s for s, *_ in read("prices")} == set("AD")
    # prices were rebuilt as a whole: what changed in them is not known, so counts are too
    sv.refresh("prices")
    assert not sv.refresh_changed("counts") and read("counts") == [("A", 4), ("D", 4)]
    assert sv.refresh_changed("counts") and read("counts") == [("A", 4), ("D", 4)]    # nothing to do


def test_versions_are_never_written_again(spark):
    sv, _ = _views(spark, "A")
    old = sv.read("exclusions")
    before = sv.version("exclusions")
    sv.append("exclusions", spark.createDataFrame([("B",)], "ticker string"))
    assert [r.ticker for r in old.collect()] == ["A"] and sv.version("exclusions")[:-1] == before
    assert sorted(r.ticker for r in sv.read("exclusions").collect()) == ["A", "B"]


def _exchanges(df):
    import re
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)


def test_bucketed_tables_need_no_exchange(spark):
    from quotecraft.queries import queries
    for name in ("jon_03_bucketed_self_join", "ret_01_bucketed_returns", "ret_02_bucketed_grid_returns"):
        # beyond the broadcast threshold, as at scale
        df = queries()[name](spark, SF)
        df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert _exchanges(df) == [], name
    plain = R.prev_price_join(Study(spark, SF, W_LONG).mv_eod, Study(spark, SF, W_LONG).calendar)
    assert _exchanges(plain)


def test_company_files_with_bad_lines(spark, tmp_path):
    head = ",".join(SC.COMPANY_FILE.names)
    good = lambda s, name="x": f"{s},{name},1,0,0%,5,US,1999,0,Tech,Soft"
    (tmp_path / "nasdaq.csv").write_text("\n".join([head, good("A", '"Inc, ""A"""'), good("B") + ",more", good("C")]) + "\n")
    (tmp_path / "nyse.csv").write_text("\n".join([head, "D,too,short", good("E", " blank ")]) + "\n")
    (tmp_path / "amex.csv").write_text(head + "\n")
    staging, rejects = loaders.read_company_files(spark, str(tmp_path))
    assert sorted((r.symbol, r.exchange, r["name"]) for r in staging.collect()) == [
        ("A", "NASDAQ", 'Inc, "A"'), ("C", "NASDAQ", "x"), ("E", "NYSE", " blank ")]
    assert sorted((r.exchange, r.line) for r in rejects.collect()) == [("NASDAQ", good("B") + ",more"), ("NYSE", "D,too,short")]
    table, _ = loaders.load_company_files(spark, str(tmp_path), new_table_path(spark, "companies"), ("NASDAQ", "AMEX", "NYSE"))
    assert sorted((r.symbol, r.stock_mkt_name, r.market_cap, r.ipo_year) for r in table.collect()) == [
        ("A", "NASDAQ", 5.0, 1999), ("C", "NASDAQ", 5.0, 1999), ("E", "NYSE", 5.0, 1999)]
