from quotecraft.operators import quality as Q
from quotecraft.operators import relational as REL


def _companies(spark):
    rows = [("A", "NASDAQ", " Alpha Inc. ", 0.0, " US ", "Tech "), ("A", "NYSE", "Alpha Inc.", 5.0, "US", None),
            ("B", "NASDAQ", "Beta Corp", None, None, "Fin"), ("B", "NASDAQ", "Beta Corp", 1.0, None, "Fin"),
            ("C", "AMEX", "Gamma Tech", 3.0, "DE", None)]
    return spark.createDataFrame(rows, "symbol string, stock_mkt_name string, company_name string, "
                                       "market_cap double, country string, sector string")


def test_pk_and_nulls(spark):
    c = _companies(spark)
    assert {r.symbol for r in Q.pk_violations(c, ["symbol"]).collect()} == {"A", "B"}
    assert [(r.symbol, r.n_rows) for r in Q.pk_violations(c, ["symbol", "stock_mkt_name"]).collect()] == [("B", 2)]
    counts = {r.column_name: r.null_count for r in Q.null_counts(c).collect()}
    assert counts["market_cap"] == 1 and counts["country"] == 2 and counts["symbol"] == 0


def test_fk_and_lengths(spark):
    c = _companies(spark)
    mkt = spark.createDataFrame([("NASDAQ",), ("NYSE",)], "stock_mkt_name string")
    assert [r.symbol for r in Q.fk_orphans(c, mkt, "stock_mkt_name", "stock_mkt_name").collect()] == ["C"]
    rep = {r.column_name: (r.max_length, r.n_over) for r in Q.length_report(c, {"company_name": 10}).collect()}
    assert rep["company_name"] == (12, 1)


def test_cleaning(spark):
    c = Q.trim_columns(Q.zero_to_null(_companies(spark), "market_cap"), ["company_name", "country", "sector"])
    first = c.where("symbol = 'A' AND stock_mkt_name = 'NASDAQ'").first()
    assert first.market_cap is None and first.company_name == "Alpha Inc." and first.sector == "Tech"


def test_lenient_cast_rejects(spark):
    df = spark.createDataFrame([("a", "12"), ("b", "x1"), ("c", None)], "k string, v string")
    typed, rej = Q.cast_lenient(df, {"v": "int"}, ["k"])
    assert {r.k: r.v for r in typed.collect()} == {"a": 12, "b": None, "c": None}
    assert [(r.k, r.value) for r in rej.collect()] == [("b", "x1")]


def test_not_in_null_semantics(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a",)], "k string")
    assert {r.k for r in REL.not_in(left, right, "k", "k").collect()} == {"b"}
    right_null = spark.createDataFrame([("a",), (None,)], "k string")
    assert REL.not_in(left, right_null, "k", "k").count() == 0


def test_paired_methods_agree(spark):
    c = _companies(spark)
    q = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    nasdaq = c.where("stock_mkt_name = 'NASDAQ'")
    m1 = {r.symbol for r in REL.missing_by_outer_join(nasdaq, q, "symbol", "ticker").collect()}
    m2 = {r.symbol for r in REL.not_in(nasdaq, q, "symbol", "ticker").collect()}
    assert m1 == m2 == {"B"}
    u = {r.symbol for r in REL.all_keys_union(c, q, "symbol", "ticker").collect()}
    f = {r.tck for r in REL.all_keys_full_outer(c, q, "symbol", "ticker").collect()}
    assert u == f == {"A", "B", "C", "Z"}
    r1 = {r.ticker for r in REL.missing_by_right_join(nasdaq, q, "symbol", "ticker", "ticker").collect()}
    assert r1 == {"Z"}


def test_nulls_last_bottom_k(spark):
    c = _companies(spark)
    rows = REL.bottom_k(c, "market_cap", 5, ["symbol", "stock_mkt_name"]).collect()
    assert rows[-1].market_cap is None and rows[0].market_cap == 0.0


def test_markets_and_group_null(spark):
    c = _companies(spark)
    assert [r.symbol for r in REL.on_markets(c, "symbol", ["NASDAQ", "NYSE"], ["symbol"]).collect()] == ["A"]
    g = {r.country for r in REL.distinct_markets_at_least(c, ["country"], 1, exact=True).collect()}
    assert None in g                                 # GROUP BY keeps the NULL group


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Scan parquet") + plan.count("Scan ExistingRDD")


def test_checks_of_all_columns_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "c")
    _companies(spark).write.parquet(path)
    c = spark.read.parquet(path)
    bad = Q.not_null_violations(c, ["market_cap", "country", "sector", "symbol"], ["symbol", "stock_mkt_name"])
    assert sorted((r.column_name, r.symbol, r.stock_mkt_name) for r in bad.collect()) == [
        ("country", "B", "NASDAQ"), ("country", "B", "NASDAQ"), ("market_cap", "B", "NASDAQ"), ("sector", "A", "NYSE"),
        ("sector", "C", "AMEX")]
    long = Q.length_violations(c, {"company_name": 10, "sector": 4}, ["symbol"])
    assert sorted((r.column_name, r.symbol, r.length) for r in long.collect()) == [
        ("company_name", "A", 12), ("sector", "A", 5)]
    _, rejects = Q.cast_lenient(c, {"country": "int", "sector": "double"}, ["symbol"])
    assert sorted((r.symbol, r.column_name, r.value) for r in rejects.collect()) == [
        ("A", "country", " US "), ("A", "country", "US"), ("A", "sector", "Tech "), ("B", "sector", "Fin"), ("B", "sector", "Fin"),
        ("C", "country", "DE")]
    assert all(_scans(df) == 1 for df in (bad, long, rejects))


def test_a_load_measures_itself(spark, tmp_path):
    c, seen = Q.observed(_companies(spark), ["country", "symbol"], {"company_name": 10}, {"sector": "int"})
    c.write.parquet(str(tmp_path / "c"))
    got = {(r.check_name, r.column_name): r.n for r in Q.load_report(c, seen).collect()}
    assert got == {("n_rows", ""): 5, ("null", "country"): 2, ("null", "symbol"): 0, ("long", "company_name"): 1, ("cast", "sector"): 3}


def test_match_flag_keeps_every_left_row_once(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "k string, n int")
    right = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "k string")
    got = REL.match_flag(left, right, ["k"], "hit")
    assert sorted(((r.k or "", r.n, r.hit) for r in got.collect())) == [("", 1, 0), ("a", 1, 1), ("a", 2, 1), ("b", 1, 0)]
