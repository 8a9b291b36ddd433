"""Faults found in review that must not come back."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quotecraft import session
from quotecraft.functions.columns import int_div
from quotecraft.operators.calendar import update_from
from quotecraft.schemas import EOD_QUOTES
from quotecraft.sources.loaders import read_quotes_csv
from quotecraft.streaming import daily_refresh


def test_int_div_is_exact_above_2_to_the_53(spark):
    df = spark.createDataFrame([(9007199254740993,), (-7,)], "a bigint")
    assert [r.q for r in df.select(int_div(F.col("a"), 1).alias("q")).collect()] == [9007199254740993, -7]
    assert [r.q for r in df.select(int_div(F.col("a"), 2).alias("q")).collect()] == [4503599627370496, -3]


def test_nan_in_a_file_becomes_null(spark, tmp_path):
    fields = [f.name for f in EOD_QUOTES]
    values = {"ticker": "A", "date": "2020-01-02"}
    reals = [f.name for f in EOD_QUOTES if f.dataType.typeName() in ("float", "double")]
    line = ",".join(values.get(f, "NaN" if f == reals[0] else "1") for f in fields)
    (tmp_path / "q.csv").write_text(",".join(fields) + "\n" + line + "\n")
    row = read_quotes_csv(spark, str(tmp_path / "q.csv")).first()
    assert row[reals[0]] is None and all(row[c] == 1.0 for c in reals[1:])


def test_update_from_refuses_a_repeated_key(spark):
    target = spark.createDataFrame([(1, 0)], "id int, c int")
    source = spark.createDataFrame([(1, 5), (1, 6)], "id int, c int")
    with pytest.raises(Exception, match="more than once"):
        update_from(target, source, "id", ["c"]).collect()


def test_only_a_missing_table_reads_as_empty(spark, tmp_path):
    assert daily_refresh._read_table(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        daily_refresh._read_table(spark, str(tmp_path / "bad"), "a int").count()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

        @property
        def sparkContext(self):
            raise RuntimeError("no context on this client")

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_python_steps_run_outside_the_repository(tmp_path):
    code = ("import importlib.util as u; s = u.spec_from_file_location('e', '/root/repo/__spark_entry__.py'); "
            "m = u.module_from_spec(s); s.loader.exec_module(m); from quotecraft.session import get_session; "
            "sp = get_session('local[2]', 4); "
            "print(m.queries()['ptf_04_min_variance_weights'](sp, '/root/testdata/sf0.001').count() >= 0)")
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
    env |= {k: v for k, v in os.environ.items() if k.startswith(("JAVA", "PATH", "SPARK")) and k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("True"), out.stderr[-2000:]


def test_flagship_holds_no_extreme_return(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).agg(F.max("ret")).first()[0] <= 1.0
