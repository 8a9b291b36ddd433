from quotecraft.params import W_LONG
from quotecraft.plans.run_study import run
from quotecraft.plans.study import Study
from quotecraft.session import new_table_path


def test_run_study_writes_every_output(spark):
    st = Study(spark, "/root/testdata/sf0.01", W_LONG)
    out = new_table_path(spark, "study")
    paths = run(st, out, tickers=["L1", "L2", "L3", "SP500TR"])
    for name in ("company_list", "exclusions", "mv_eod", "mv_ret", "stats", "capm", "weights",
                 "portfolio_returns", "portfolio_annualized"):
        assert spark.read.parquet(paths[name]).count() > 0, name
    wide = spark.read.option("header", "true").csv(paths["eod_ret_wide"])
    assert wide.columns == ["date", "L1", "L2", "L3", "SP500TR"]
    w = spark.read.parquet(paths["weights"]).collect()
    assert abs(sum(r.weight for r in w) - 1.0) < 1e-9


def test_run_study_cli(spark, capsys):
    from quotecraft.plans.run_study import main
    out = new_table_path(spark, "study_cli")
    main(["--sf-dir", "/root/testdata/sf0.01", "--start", "1994-12-30", "--end", "2001-11-02",
          "--threshold", "0.6", "--tickers", "L1,L2,SP500TR", "--out", out])
    printed = capsys.readouterr().out
    assert "weights\t" in printed and "capm\t" in printed
    assert spark.read.parquet(f"{out}/capm").count() == 3
