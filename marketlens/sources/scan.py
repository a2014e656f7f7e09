"""Sources: partitioned and globbed Parquet, CSV and NDJSON text, versioned tables, JDBC, and what each covers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marketlens.operators.pit import latest_by_key


def scan_partitioned(spark: SparkSession, base: str, schema: StructType | str | None = None) -> DataFrame:
    """Hive-partitioned Parquet; partition columns come from the path, and filters on them prune folders."""
    r = spark.read
    return (r.schema(schema) if schema else r).parquet(base)


def scan_glob(spark: SparkSession, base: str, pattern: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet files whose names fit a pattern; strays beside them can't spoil the schema."""
    r = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return (r.schema(schema) if schema else r).parquet(base)


def scan_csv_strings(spark: SparkSession, base: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """CSV (gzip too) with every column a string; short and long lines are kept, filled or cut."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(base)


def scan_csv_dict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One CSV file with a header: an item dictionary."""
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_ndjson(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """NDJSON with every field a string; a malformed line is a row with its text in _corrupt."""
    schema = StructType([StructField(c, StringType()) for c in (*columns, "_corrupt")])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def scan_versioned_table(spark: SparkSession, path: str, key: Sequence[str], order: str) -> DataFrame:
    """The current rows of an append-only table: the last version of each key."""
    return latest_by_key(spark.read.parquet(path), key, [order])


def scan_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A relational table, read by ranges of a column in parallel; filters and columns are pushed down."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=dict(options))


def scan_or_empty(spark: SparkSession, candidates: Sequence[str], schema: StructType | str) -> tuple[DataFrame, str]:
    """The first of the paths that can be read, else an empty table of the schema; and which it was."""
    for path in candidates:
        try:
            df = spark.read.schema(schema).parquet(path)
            df.inputFiles()
            return df, path
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema), "empty"


def coverage_report(sources: Mapping[str, tuple[DataFrame, str]], needs: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Per source: rows and days, counted up to its needs only, first and last day, and what is missing.

    needs: source -> (rows, days). Counting stops at the need; the first and last day take a scan of the day's column.
    """
    out = None
    for name, (df, day) in sources.items():
        rows, days = needs.get(name, (1, 1))
        n = df.limit(rows).agg(F.count("*").alias("rows"))
        d = df.select(F.to_date(day).alias("d")).distinct().limit(days).agg(F.count("*").alias("days"))
        span = df.agg(F.min(F.to_date(day)).alias("first_day"), F.max(F.to_date(day)).alias("last_day"))
        one = n.join(d).join(span).select(F.lit(name).alias("source"), "*")  # a row each
        why = F.when(F.col("rows") < rows, "too few rows").when(F.col("days") < days, "too few days")
        one = one.withColumn("missing", why)
        out = one if out is None else out.unionByName(one)
    return out


def source_frontier(a: DataFrame, b: DataFrame, day: str) -> DataFrame:
    """One row: the span of days that both sources cover, and whether b starts only after a ends."""
    x = a.agg(F.min(day).alias("a0"), F.max(day).alias("a1"))
    y = b.agg(F.min(day).alias("b0"), F.max(day).alias("b1"))
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    return x.join(y).select(F.when(lo <= hi, lo).alias("overlap_from"), F.when(lo <= hi, hi).alias("overlap_to"), (F.col("b0") > F.col("a1")).alias("disjoint"))


def load_dimension_snapshot(df: DataFrame, key: str, as_of: date) -> DataFrame:
    """A dated list as a dimension: keys trimmed and upper-cased, blank ones dropped, one row each, stamped as_of. Of several rows of a key the least stays, whole, by its other columns in their order (nulls first)."""
    k = F.upper(F.trim(F.col(key).cast("string")))
    rest = [c for c in df.columns if c != key]
    return df.withColumn(key, k).where(F.col(key) != "").groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*", F.lit(as_of).alias("as_of_date"))


def gate_partial_landing(bars: DataFrame, day: date, min_symbols: int, proxy: object, exclude_vendor: str, symbol: str = "symbol", day_col: str = "trade_date", vendor: str = "vendor") -> DataFrame:
    """One row: whether a day has landed: enough distinct symbols, and the market proxy's row, index rows of a vendor aside."""
    own = ~F.col(vendor).eqNullSafe(F.lit(exclude_vendor))
    n = F.countDistinct(F.when(own, F.col(symbol)))
    has = F.count_if(own & (F.col(symbol) == F.lit(proxy)))
    return bars.where(F.col(day_col) == F.lit(day)).agg(n.alias("symbols"), (has > 0).alias("has_proxy"), ((n >= min_symbols) & (has > 0)).alias("landed"))


def arbitrate_sources(a: DataFrame, b: DataFrame, key: Sequence[str], day: str, cutoff: date) -> DataFrame:
    """Rows of two vendors, each (key, day) from one only: a owns days before the cutoff, b the others; each loses only what the owner really has."""
    keys = [*key, day]
    old = lambda df: df.where(F.col(day) < F.lit(cutoff)).select(*keys).distinct()
    new = lambda df: df.where(F.col(day) >= F.lit(cutoff)).select(*keys).distinct()
    return a.join(new(b), keys, "left_anti").unionByName(b.join(old(a), keys, "left_anti"), allowMissingColumns=True)


def symbol_map(sources: Sequence[DataFrame], ticker: str = "ticker", symbol: str = "symbol") -> DataFrame:
    """One symbol for each ticker: of the first source that has it; of several there, the smallest."""
    rows = None
    for k, df in enumerate(sources):
        one = df.select(ticker, symbol, F.lit(k).alias("_prio"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(ticker).agg(F.min_by(symbol, F.struct("_prio", symbol)).alias(symbol))
