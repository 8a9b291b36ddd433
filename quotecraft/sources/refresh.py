"""SRC-14: stored (materialised) views refreshed in dependency order.

A stored view is a query plus its last written version in the shared folder.
Reading a stored view reads that version, so it is *stale* until refreshed:
adding exclusions changes nothing until prices, then returns, are refreshed
-- the reference's lesson, kept on purpose.  A version is a tuple of folders that are
never written again: a refresh writes a new one, an append adds one, and a reader of the
version before keeps reading it.  A lost executor recomputes from files, not
from the raw tables.

A refresh of changed keys (:meth:`StoredViews.refresh_changed`) derives only the keys that
differ in the versions of what the view is built on, and copies the other rows, a narrow
step, from its version before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices as px
from ..operators import returns as rt
from ..session import new_table_path

Builder = Callable[["StoredViews"], DataFrame]
#: the view's rows of the keys in a one-column frame
Part = Callable[["StoredViews", DataFrame], DataFrame]
Version = tuple[str, ...]


@dataclass
class _View:
    build: Builder | None = None
    part: Part | None = None
    on: tuple[str, ...] = ()
    key: str = "symbol"
    version: Version = ()
    #: what the version was built from
    built_on: dict[str, Version] = field(default_factory=dict)
    #: (version before, version, folder of the keys that changed) of each step whose keys are known
    steps: list[tuple[Version, Version, str]] = field(default_factory=list)


class StoredViews:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._views: dict[str, _View] = {}

    def define(self, name: str, builder: Builder, on: Sequence[str] = (), key: str = "symbol",
               part: Part | None = None) -> None:
        """``CREATE MATERIALIZED VIEW name AS ... WITH NO DATA``.  ``on``: the tables and views it reads;
        ``part`` builds its rows of given keys, which must depend on nothing but those keys' rows."""
        self._views[name] = _View(builder, part, tuple(on), key)

    def _write(self, name: str, df: DataFrame) -> str:
        path = new_table_path(self.spark, name)
        df.write.parquet(path)
        return path

    def store(self, name: str, df: DataFrame, key: str = "symbol") -> None:
        """Write a plain stored table (``SELECT ... INTO``) as a new version; ``key`` names what its rows belong to."""
        view = self._views.setdefault(name, _View(key=key))
        view.key, view.version = key, (self._write(name, df),)

    def append(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        """``INSERT INTO name SELECT ...``: a new version that holds one folder more.  With ``key``
        the table's primary key is enforced as the database would: a row whose key is already
        stored, or repeated among the new rows, fails the insert."""
        # ``df`` may read the table it appends to: its rows are written first
        path = self._write(name, df)
        rows = self.spark.read.parquet(path)
        view = self._views.setdefault(name, _View(key=key[0] if key else "symbol"))
        if key:
            clash = view.version and rows.join(self.read(name).select(*key), key, "left_semi").limit(1).count()
            dup = rows.groupBy(*key).count().where("count > 1").limit(1).count()
            if clash or dup:
                raise ValueError(f"primary key violation on {name}({', '.join(key)})")
        before, view.version = view.version, (*view.version, path)
        if before and view.key in rows.columns:
            view.steps.append((before, view.version, path))

    def refresh(self, name: str) -> None:
        """``REFRESH MATERIALIZED VIEW name WITH DATA``: a new version from current inputs."""
        view = self._views[name]
        built_on = {d: self.version(d) for d in view.on}
        view.version, view.built_on = (self._write(name, view.build(self)),), built_on

    def refresh_changed(self, name: str) -> bool:
        """A new version in which only the changed keys are derived again; False where the change
        is not known or the view has no version yet, and all of it was derived."""
        view = self._views[name]
        parts = [self.changes(d, view.built_on[d]) for d in view.on if d in view.built_on]
        if not view.version or view.part is None or len(parts) < len(view.on) or any(p is None for p in parts):
            self.refresh(name)
            return False
        changed = None
        for p, d in zip(parts, view.on, strict=True):
            keys = p.select(F.col(self._views[d].key).alias(view.key))
            changed = keys if changed is None else changed.unionByName(keys)
        keys = self._write(f"{name}_changed", changed.where(F.col(view.key).isNotNull()).distinct())
        changed = self.spark.read.parquet(keys)
        built_on = {d: self.version(d) for d in view.on}
        same = self.read(name).join(changed, view.key, "left_anti")
        again = view.part(self, changed)
        before, view.version = view.version, (self._write(name, same.unionByName(again)),)
        view.built_on = built_on
        view.steps.append((before, view.version, keys))
        return True

    def changes(self, name: str, since: Version) -> DataFrame | None:
        """Keys of ``name`` whose rows may differ between the version ``since`` and the current one:
        those of the steps in between, else those of rows that only one of two tables holds.
        ``None`` for a view rebuilt as a whole: its rows are not compared."""
        view = self._views[name]
        if since == view.version:
            return self.read(name).select(view.key).limit(0)
        at, paths = since, []
        for before, after, path in view.steps:
            if before == at:
                paths.append(path)
                at = after
        if at == view.version:
            return self.spark.read.parquet(*paths).select(view.key)
        if view.build is not None:
            return None
        return difference(self.spark.read.parquet(*since), self.read(name)).select(view.key)

    def read(self, name: str) -> DataFrame:
        if name not in self._views or not self._views[name].version:
            raise ValueError(f"stored view {name} has no data: refresh it first")
        return self.spark.read.parquet(*self._views[name].version)

    def version(self, name: str) -> Version:
        return self._views[name].version if name in self._views else ()


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two tables holds, or that one holds more often."""
    cols = old.columns
    sides = old.select(*cols, F.lit(-1).alias("_k")).unionByName(new.select(*cols, F.lit(1).alias("_k")))
    return sides.groupBy(*cols).agg(F.sum("_k").alias("_k")).where("_k <> 0").select(*cols)


def study_views(study) -> StoredViews:
    """The study's exclusions, mv_eod and mv_ret as stored views (first pass done)."""
    sv = StoredViews(study.spark)
    sv.store("exclusions", study.excl_missing, key="ticker")

    def prices(v: StoredViews, symbols: DataFrame | None = None) -> DataFrame:
        some = (lambda df, c: df) if symbols is None else (
            lambda df, c: df.join(symbols.select(F.col("symbol").alias(c)), c, "left_semi"))
        return px.apply_exclusions(some(study.v_indices, "symbol"), some(study.v_quotes, "ticker"), v.read("exclusions"))

    def returns(v: StoredViews, symbols: DataFrame | None = None) -> DataFrame:
        eod = v.read("mv_eod")
        return rt.strict_returns(eod if symbols is None else eod.join(symbols, "symbol", "left_semi"), study.calendar)

    sv.define("mv_eod", prices, on=["exclusions"], part=prices)
    sv.define("mv_ret", returns, on=["mv_eod"], part=returns)
    sv.refresh("mv_eod")
    sv.refresh("mv_ret")
    return sv


def refreshed_study_views(study) -> dict[str, DataFrame]:
    """Second pass: add return offenders, then refresh prices, then returns, each for the
    changed symbols only."""
    sv = study_views(study)
    sv.append("exclusions", rt.extreme_return_symbols(sv.read("mv_ret")), key=["ticker"])
    sv.refresh_changed("mv_eod")
    sv.refresh_changed("mv_ret")
    return {"exclusions": sv.read("exclusions"), "mv_eod": sv.read("mv_eod"), "mv_ret": sv.read("mv_ret")}


def view_states(study) -> DataFrame:
    """(state, view, n_rows, n_symbols, total): both views after the exclusions grew but before any
    refresh, after prices, after returns, and derived anew from the same exclusions."""
    sv = study_views(study)
    sv.append("exclusions", rt.extreme_return_symbols(sv.read("mv_ret")), key=["ticker"])
    seen: list[DataFrame] = []

    def look(state: str) -> None:
        for name, value in (("mv_eod", "adj_close"), ("mv_ret", "ret")):
            seen.append(sv.read(name).agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"),
                F.sum(F.col(value).cast("double")).alias("total")).select(
                    F.lit(state).alias("state"), F.lit(name).alias("view"), "n_rows", "n_symbols", "total"))

    look("stale")
    sv.refresh_changed("mv_eod")
    look("prices")
    sv.refresh_changed("mv_ret")
    look("both")
    sv.refresh("mv_eod")
    sv.refresh("mv_ret")
    look("rebuilt")
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out
