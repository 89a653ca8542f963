"""A versioned sample-by-feature store in Parquet.

Values lie in one dataset, partitioned by logical type, as rows (sample_id,
feature_name, value, version, ingest_seq, row_seq).  Writing appends; of several rows
for one (sample, feature) the one of the highest version, then ingest_seq (a number of the
ingest, growing with time), then row_seq (its place in that ingest) counts, which is
decided when reading, so late and repeated deliveries do no harm.  Columns that older
files lack are null.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import numbers
from . import filters, infer

BIN_NAME = r"(?i)^(chr)?[0-9XYMT]+_[0-9]+_[0-9]+$"
KEYS = ("sample_id", "feature_name")


def latest(values: DataFrame) -> DataFrame:
    """One row for each (sample, feature): the newest; partial maxima are taken before the shuffle."""
    order = F.struct(*(c for c in ("version", "ingest_seq", "row_seq") if c in values.columns))
    rest = [c for c in values.columns if c not in KEYS]
    newest = values.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("v"))
    return newest.select(*KEYS, *(F.col(f"v.{c}").alias(c) for c in rest))


def feature_statistics(newest: DataFrame, value: str = "value") -> DataFrame:
    """feature_name, mean, std (of the sample; one value: null)."""
    return newest.groupBy("feature_name").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def sample_count(*tables: DataFrame) -> DataFrame:
    """n_samples over all tables; one shuffle of distinct ids."""
    ids = tables[0].select("sample_id")
    for t in tables[1:]:
        ids = ids.unionByName(t.select("sample_id"))
    return ids.agg(F.count_distinct("sample_id").alias("n_samples"))


def widen(newest: DataFrame, features: list[str], value: str = "value") -> DataFrame:
    """A row a sample, a column a feature: a full outer alignment in one aggregation."""
    names = list(dict.fromkeys(features))
    chosen = newest.where(F.col("feature_name").isin(names))
    return chosen.groupBy("sample_id").pivot("feature_name", names).agg(F.first(value))


def is_core(name: Column) -> Column:
    """Names of the extractors' own features: sizes 0 to 999, motifs, bins."""
    number = F.when(name.rlike("^[0-9]+$"), name.try_cast("bigint"))
    return F.coalesce(number.between(0, 999), F.lit(False)) | name.endswith("-csm") | name.endswith("-5p") | name.rlike(BIN_NAME)


def group_of(name: Column) -> Column:
    """fszd (1 to 1000), csm, 5p, bincount, or null."""
    number = F.when(name.rlike("^[0-9]+$"), name.try_cast("bigint"))
    return F.when(number.between(1, 1000), "fszd").when(name.endswith("-csm"), "csm").when(name.endswith("-5p"), "5p").when(name.rlike(BIN_NAME), "bincount")


def encode(value: Column, logical: str) -> Column:
    """A text as the logical type; null where it isn't one.  Numbers out of range are null, not wrapped; halves round to even."""
    text = F.trim(value.cast("string"))
    if logical in S.INTEGER_BOUNDS:
        low, high = S.INTEGER_BOUNDS[logical]
        whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
        number = F.coalesce(whole, F.rint(numbers.number(text)).try_cast("bigint"))
        return F.when(number.between(low, high), number).cast(S.VALUE_TYPES[logical])
    if logical in ("Float32", "Float64"):
        return numbers.number(text).cast(S.VALUE_TYPES[logical])
    if logical == "Bool":
        word = F.lower(text)
        return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)
    if logical == "Date":
        return F.to_date(F.try_to_timestamp(text))
    if logical == "DateTime":
        return F.try_to_timestamp(text)
    if logical == "String":
        return text
    raise ValueError(f"unknown type {logical!r}")


def ingest_stamp() -> int:
    """A number that grows with each ingest: microseconds of time."""
    return time.time_ns() // 1000


def check_names(columns: list[str], rename: dict[str, str]) -> None:
    """Raises where two columns would be stored under one name."""
    names = [rename.get(c, c) for c in columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several columns would have the names {twice}")


def column_types(wide: DataFrame, columns: list[str], col_types: dict[str, str] | None = None, data_type: str | None = None, sample_rows: int | None = None) -> dict[str, str]:
    """The type of each column: as given for it, else as given for all, else (or for ``auto``) inferred from its values."""
    given = col_types or {}
    if unknown := sorted(set(given.values()) - set(S.VALUE_TYPES) | ({data_type} - {None, "auto", *S.VALUE_TYPES})):
        raise ValueError(f"unknown types {unknown}")
    open_ = [c for c in columns if c not in given] if data_type in (None, "auto") else []
    inferred = infer.types(wide, open_, sample_rows) if open_ else {}
    return {c: given.get(c) or inferred.get(c) or data_type for c in columns}


def melt(wide: DataFrame, id_col: str, types: dict[str, str], version: int, rename: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """By logical type: rows (sample_id, feature_name, value, raw, version, ingest_seq, row_seq).

    Missing, blank and ``nan`` cells are left out.  Cells that aren't of their
    column's type have a null value and their text in ``raw``: see :func:`split_rejected`.
    """
    rename, stamp = rename or {}, ingest_stamp()
    check_names(list(types), rename)
    wide = wide.withColumn("__row", F.monotonically_increasing_id())
    out = {}
    for logical in dict.fromkeys(types.values()):
        columns = [c for c, t in types.items() if t == logical]
        text = wide.select(F.col(f"`{id_col}`").cast("string").alias("sample_id"), "__row", *(F.col(f"`{c}`").cast("string").alias(rename.get(c, c)) for c in columns))
        long = text.unpivot(["sample_id", "__row"], [rename.get(c, c) for c in columns], "feature_name", "raw")
        real = long.where("raw is not null and trim(raw) <> '' and lower(trim(raw)) <> 'nan'")
        stamped = real.withColumns({"value": encode(F.col("raw"), logical), "version": F.lit(version).cast("long"), "ingest_seq": F.lit(stamp).cast("long"), "row_seq": F.col("__row")})
        out[logical] = stamped.select(*KEYS, "value", "raw", "version", "ingest_seq", "row_seq")
    return out


def split_rejected(melted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values to store, and rejected cells counted by feature."""
    rejected = melted.where("value is null").groupBy("feature_name").agg(F.count("*").alias("n_rejected"))
    return melted.where("value is not null").drop("raw"), rejected


def merge_catalog(fresh: DataFrame, existing: DataFrame, feature_type: str | None = None, description: str | None = None, imported: Iterable[str] = ()) -> DataFrame:
    """The new catalogue: ``fresh`` (feature_name, data_type, mean, std), one row a name, with type and description.

    Of a name in several typed tables the later type wins.  Features just imported
    take the given type; others keep theirs (``meta`` is put right to ``core`` where
    the name is an extractor's); new ones get the given type or follow their name.
    """
    order = {t: i for i, t in enumerate(S.VALUE_TYPES)}
    rank = F.coalesce(F.element_at(F.create_map(*(x for t, i in order.items() for x in (F.lit(t), F.lit(i)))), F.col("data_type")), F.lit(-1))
    one = fresh.groupBy("feature_name").agg(F.max_by(F.struct("data_type", "mean", "std"), rank).alias("f")).select("feature_name", "f.*")
    known = existing.select("feature_name", F.col("feature_type").alias("old_type"), F.coalesce("description", F.lit("")).alias("old_description"), F.lit(True).alias("known"))
    joined = one.join(known, "feature_name", "left")
    by_name = F.when(is_core(F.col("feature_name")), "core").otherwise("meta")
    mine = F.col("feature_name").isin(list(imported)) if feature_type is not None and imported else F.lit(False)
    kept = F.when((F.col("old_type") == "meta") & is_core(F.col("feature_name")), "core").otherwise(F.coalesce("old_type", F.lit("meta")))
    new = F.lit(feature_type) if feature_type is not None else by_name
    kind = F.when(mine, F.lit(feature_type)).when(F.col("known"), kept).otherwise(new)
    old_text = F.coalesce("old_description", F.lit(""))
    text = F.when(mine, F.lit(description) if description else old_text).when(F.col("known"), old_text).otherwise(F.lit(description or ""))
    return joined.select("feature_name", "data_type", "mean", "std", kind.alias("feature_type"), text.alias("description"))


def drop_features(values: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of features that aren't named in ``features``."""
    return values.join(features.select("feature_name"), "feature_name", "left_anti").select(*values.columns)


def without_blank(values: DataFrame) -> DataFrame:
    """Rows whose text isn't empty or ``nan``."""
    return values.where("not (value = '' or lower(value) = 'nan')")


@dataclass(frozen=True)
class Store:
    """The datasets under one folder, of any file system that Spark reads."""

    spark: SparkSession
    path: str

    def _values(self, logical: str) -> str:
        return f"{self.path}/values/data_type={logical}"

    def append(self, logical: str, rows: DataFrame) -> None:
        """Append rows (sample_id, feature_name, value, version, ingest_seq and, if there is one, row_seq) of one type."""
        kind, place = S.VALUE_TYPES[logical], F.col("row_seq") if "row_seq" in rows.columns else F.lit(None)
        self._recover(self._values(logical))
        rows.select(*KEYS, F.col("value").cast(kind), F.col("version").cast("long"), F.col("ingest_seq").cast("long"), place.cast("long").alias("row_seq")).write.mode("append").parquet(self._values(logical))

    def read(self, logical: str) -> DataFrame:
        """All versions of one type; an empty table where there are none."""
        schema = f"sample_id string, feature_name string, value {S.VALUE_TYPES[logical]}, version long, ingest_seq long, row_seq long"
        return self._read(self._values(logical), schema)

    def latest_text(self) -> DataFrame:
        """sample_id, feature_name, data_type and the newest value of each type as text."""
        parts = [latest(self.read(t)).select(*KEYS, F.lit(t).alias("data_type"), F.col("value").cast("string").alias("value")) for t in S.VALUE_TYPES]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def ingest(self, wide: DataFrame, id_col: str, types: dict[str, str], version: int, rename: dict[str, str] | None = None) -> dict[str, int]:
        """Melt and append a wide table; how many cells of each feature were rejected."""
        rejected: dict[str, int] = {}
        for logical, rows in melt(wide, id_col, types, version, rename).items():
            good, bad = split_rejected(rows)
            self.append(logical, good)
            rejected |= {r["feature_name"]: r["n_rejected"] for r in bad.collect()}  # at most a row a column
        return rejected

    def catalog(self) -> DataFrame:
        path = f"{self.path}/catalog"
        schema = "feature_name string, data_type string, mean double, std double, feature_type string, description string"
        return self._read(path, schema)

    def _read(self, path: str, schema: str) -> DataFrame:
        self._recover(path)
        fs, (target,) = self._files(path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(target) else self.spark.createDataFrame([], schema)

    def tables(self) -> DataFrame:
        """data_type, n_rows and n_features of each type that holds any rows."""
        parts = [self.read(t).select(F.lit(t).alias("data_type"), "feature_name") for t in S.VALUE_TYPES]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("data_type").agg(F.count("*").alias("n_rows"), F.count_distinct("feature_name").alias("n_features"))

    def feature_types(self, features: list[str]) -> dict[str, str]:
        """The catalogue's type of each feature; String for those it doesn't have."""
        wanted = self.spark.createDataFrame([(f,) for f in features], "feature_name string")
        known = {r["feature_name"]: r["data_type"] for r in self.catalog().join(wanted, "feature_name", "left_semi").collect()}
        return {f: known.get(f, "String") for f in features}

    def upload(self, wide: DataFrame, version: int | None = None, *, id_col: str | None = None, col_types: dict[str, str] | None = None, data_type: str | None = None, include: list[str] | None = None, rename: dict[str, str] | None = None, feature_type: str | None = None, description: str | None = None) -> dict[str, int]:
        """Store a wide table whose first column is the sample, and refresh the catalogue; how many cells of each feature were rejected.

        ``include`` names the columns to take.  A column's type is the one given for
        it, else the one given for all, else inferred.  The version is the time in
        seconds unless it is given.
        """
        id_col = id_col or wide.columns[0]
        columns = [c for c in wide.columns if c != id_col and (include is None or c in include)]
        check_names(columns, rename or {})
        types = column_types(wide, columns, col_types, data_type)
        rejected = self.ingest(wide, id_col, types, int(time.time()) if version is None else version, rename)
        self.refresh_catalog(feature_type, description, [(rename or {}).get(c, c) for c in columns])
        return rejected

    def selection(self, features: list[str], samples: DataFrame, specs: list[dict] | None = None) -> DataFrame:
        """The wide rows of the selected samples that pass the filters, as the explorer's table and its export show them."""
        wide = widen(self.latest_text(), features)
        return filters.apply(wide, specs).join(samples.select("sample_id").distinct(), "sample_id", "left_semi")

    def refresh_catalog(self, feature_type: str | None = None, description: str | None = None, imported: Iterable[str] = ()) -> None:
        """Recompute statistics of all types and replace the catalogue."""
        fresh = None
        for t in S.VALUE_TYPES:
            newest = latest(self.read(t))
            if t in S.NUMERIC_TYPES:
                part = feature_statistics(newest).select("feature_name", F.lit(t).alias("data_type"), "mean", "std")
            else:
                part = newest.select("feature_name").distinct().select("feature_name", F.lit(t).alias("data_type"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"))
            fresh = part if fresh is None else fresh.unionByName(part)
        self._replace(merge_catalog(fresh, self.catalog(), feature_type, description, imported), f"{self.path}/catalog")

    def compact(self, logical: str) -> None:
        """Keep only the newest rows of a type."""
        self._replace(latest(self.read(logical)), self._values(logical))

    def drop(self, features: list[str]) -> int:
        """Remove features from values and catalogue; how many were asked for."""
        names = self.spark.createDataFrame([(f,) for f in features], "feature_name string")
        for logical in S.VALUE_TYPES:
            have = self.read(logical)
            if have.join(names, "feature_name", "left_semi").limit(1).count():
                self._replace(drop_features(have, names), self._values(logical))
        self._replace(drop_features(self.catalog(), names), f"{self.path}/catalog")
        return len(features)

    def clear(self) -> None:
        """Remove everything."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def _files(self, *paths: str) -> tuple:
        """The file system and its paths."""
        found = [self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        return found[0].getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _beside(self, path: str) -> tuple[str, str]:
        """Where the new and the old data of a folder are during a swap; not among the values, where they would look like data."""
        name = path.removeprefix(self.path).strip("/").replace("/", "_")
        return f"{self.path}/_swap/{name}.new", f"{self.path}/_swap/{name}.old"

    def _recover(self, path: str) -> None:
        """End a swap that was cut off between its two renames: the new data if they are whole, else the old."""
        fs, (target, new, old, done) = self._files(path, *self._beside(path), f"{self._beside(path)[0]}/_SUCCESS")
        if fs.exists(target):
            return
        if fs.exists(done):
            fs.rename(new, target)
        elif fs.exists(old):
            fs.rename(old, target)

    def _replace(self, rows: DataFrame, path: str) -> None:
        """Write the new data beside the old, then swap.

        Between the two renames the folder is missing for a moment; whoever reads or
        writes next ends a swap that was cut off there, so no data are lost.
        """
        fs, (target, fresh, aside) = self._files(path, *self._beside(path))
        rows.write.mode("overwrite").parquet(self._beside(path)[0])
        fs.delete(aside, True)
        if fs.exists(target) and not fs.rename(target, aside):
            raise OSError(f"{path} can't be moved aside")
        if not fs.rename(fresh, target) and not fs.exists(target):
            raise OSError(f"{path} can't be put in place; its data are in {self._beside(path)[0]}")
        fs.delete(aside, True)
        self.spark.catalog.refreshByPath(path)
