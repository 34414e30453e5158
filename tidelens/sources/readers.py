"""Loading a table with one time column: CSV, Parquet, JDBC."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import at, floor_div
from ..plans.dataset import Dataset
from ..plans.limits import LIMITS, is_numeric, is_temporal

# From these magnitudes on, epoch numbers are milliseconds, microseconds, nanoseconds; and microseconds of
# a unit by its name (0: a thousandth of one).
EPOCH_BOUNDS = [("s", 0), ("ms", 100_000_000_000), ("us", 100_000_000_000_000), ("ns", 100_000_000_000_000_000)]
MICROS = {"s": 1_000_000, "ms": 1000, "us": 1, "μs": 1, "ns": 0}


@dataclass(frozen=True)
class LoadOptions:
    time_column: str | None = None
    time_unit: str | None = None
    columns: list[str] = field(default_factory=list)
    skip_rows: int = 0
    n_rows: int | None = None
    start: Any = None
    end: Any = None


def read_csv(spark: SparkSession, path: str, skip_rows: int = 0, strict: bool = False) -> DataFrame:
    """Header, inferred types, cells that do not fit null; skip_rows lines before the header are dropped."""
    options = {"header": True, "inferSchema": True, "mode": "FAILFAST" if strict else "PERMISSIVE"}
    if not skip_rows:
        return spark.read.options(**options).csv(path)
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("id"))
    first = lines.orderBy("id").limit(skip_rows).agg(F.max("id")).head()[0]
    return spark.read.options(**options).csv(lines.where(F.col("id") > (first if first is not None else -1)).select("value").rdd.map(lambda r: r[0]))


def preview_csv(spark: SparkSession, path: str) -> DataFrame:
    """Strict first; on a malformed file once more with nulls in its place."""
    try:
        df = read_csv(spark, path, strict=True)
        df.limit(1000).count()
        return df
    except Exception:  # noqa: BLE001 - whatever the reader raises, the relaxed one follows
        return read_csv(spark, path)


def read(spark: SparkSession, path: str, skip_rows: int = 0) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, skip_rows)


def slice_rows(df: DataFrame, skip: int = 0, limit: int | None = None, *order: str) -> DataFrame:
    df = df.orderBy(*order) if order else df
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def keep_columns(df: DataFrame, columns: list[str], ts: str) -> DataFrame:
    """The listed columns that exist, and the time column; all if none are listed."""
    wanted = {c.strip() for c in columns if c.strip()} | {ts}
    return df.select(*[c for c in df.columns if c in wanted]) if len(wanted) > 1 else df


def time_column(df: DataFrame, wanted: str | None = None) -> str:
    """The wanted column, or the first time or date; an error without one."""
    if wanted and wanted in df.columns:
        return wanted
    found = next((f.name for f in df.schema.fields if is_temporal(f.dataType)), None)
    if found is None:
        raise ValueError("the table has no time column")
    return found


def preview_time_column(df: DataFrame, wanted: str | None = None) -> str | None:
    """Looser: the wanted one, ts, the first time, or an integer whose name speaks of time; none is no error."""
    if wanted and wanted in df.columns:
        return wanted
    fields = {f.name: f.dataType for f in df.schema.fields}
    if "ts" in fields and (is_temporal(fields["ts"]) or isinstance(fields["ts"], T.IntegralType)):
        return "ts"
    named = lambda n: any(w in n.lower() for w in ("ts", "time", "timestamp"))
    return next((n for n, k in fields.items() if is_temporal(k)), None) or next((n for n, k in fields.items() if isinstance(k, T.IntegralType) and named(n)), None)


def epoch_unit(greatest: int | None) -> str | None:
    """Unit of epoch numbers by their greatest; None if that is not positive."""
    if greatest is None or greatest <= 0:
        return None
    return [u for u, low in EPOCH_BOUNDS if greatest >= low][-1]


def normalise_time(df: DataFrame, ts: str, unit: str | None = None) -> DataFrame:
    """ts as a zone-less UTC timestamp; integers by the given unit or the one that their greatest value shows."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, T.TimestampType | T.DateType):
        return df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    if isinstance(kind, T.IntegralType):
        unit = unit or epoch_unit(df.agg(F.max(ts)).head()[0]) or "ms"
        scale = MICROS.get(unit, 1000)
        x = F.col(ts).cast("long")
        micros = x * scale if scale else floor_div(x, 1000)
        return df.withColumn(ts, F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz"))
    return df.withColumn(ts, F.expr(f"try_to_timestamp(`{ts}`)").cast("timestamp_ntz"))


def load(spark: SparkSession, path: str, options: LoadOptions | None = None) -> Dataset:
    """A Dataset from a file: sliced, typed, projected and cut to a time window, all in one plan."""
    o = options or LoadOptions()
    csv = not path.rstrip("/").endswith(".parquet")
    df = read(spark, path, o.skip_rows if csv else 0)
    df = slice_rows(df, 0 if csv else o.skip_rows, o.n_rows)
    ts = time_column(df, o.time_column)
    if not any(is_numeric(f.dataType) for f in df.schema.fields if f.name != ts):
        raise ValueError("the table has no numeric column besides its time")
    df = normalise_time(keep_columns(df, o.columns, ts), ts, o.time_unit)
    df = df.where(F.col(ts) >= at(o.start)) if o.start is not None else df
    df = df.where(F.col(ts) <= at(o.end)) if o.end is not None else df
    if df.isEmpty():
        raise ValueError("no rows are left")
    return Dataset(df, ts)


# The sample files that may be served.
SAMPLES = ("ETTm1.csv", "ETTm2.csv", "ETTm1.parquet", "ETTm2.parquet")

# --- databases ----------------------------------------------------------------------------------


# Schemas of the database and its time-series extension that hold no user tables.
SYSTEM_SCHEMAS = [
    "pg_catalog", "information_schema", "_timescaledb_catalog", "_timescaledb_internal", "_timescaledb_config", "_timescaledb_cache", "timescaledb_information", "timescaledb_experimental",
]
HYPERTABLES = """select h.schema_name as table_schema, h.table_name as table_name, coalesce(c.reltuples::bigint, -1) as row_estimate from _timescaledb_catalog.hypertable h
    join pg_namespace n on n.nspname = h.schema_name join pg_class c on c.relnamespace = n.oid and c.relname = h.table_name"""
# Spark's types for the database's; all others are read as strings.
DB_TYPES = {
    "smallint": "smallint", "smallserial": "smallint", "integer": "int", "serial": "int", "bigint": "bigint", "bigserial": "bigint", "real": "float", "double precision": "double", "numeric": "double", "decimal": "double",
    "boolean": "boolean", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamp", "timestamptz": "timestamp", "timestamp": "timestamp", "date": "date",
}


def identifier(name: str) -> str:
    """A quoted identifier; only letters, digits, underscores and dots."""
    if not re.fullmatch(r"[A-Za-z0-9_.]+", name):
        raise ValueError(f"bad identifier {name!r}")
    return ".".join(f'"{p}"' for p in name.split("."))


@dataclass(frozen=True)
class Database:
    """A JDBC source; the driver's jar comes with the session."""

    url: str
    user: str | None = None
    password: str | None = None

    def __post_init__(self) -> None:
        if not self.url.startswith(("jdbc:postgresql:", "postgres")):
            raise ValueError("only Postgres URLs are known")

    def options(self, query: str) -> dict[str, str]:
        url = self.url if self.url.startswith("jdbc:") else re.sub(r"^postgres(ql)?://", "jdbc:postgresql://", self.url)
        return {"url": url, "query": query, **({"user": self.user} if self.user else {}), **({"password": self.password} if self.password else {})}

    def query(self, spark: SparkSession, text: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options(text)).load()

    def ping(self, spark: SparkSession) -> bool:
        return self.query(spark, "select 1 as one").head()[0] == 1

    def tables(self, spark: SparkSession) -> DataFrame:
        """table_schema, table_name, kind (hypertable or table), row_estimate: partitioned time tables first where there are any."""
        quoted = ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS)
        plain = self.query(spark, f"select table_schema, table_name from information_schema.tables where table_type = 'BASE TABLE' and table_schema not in ({quoted})")
        plain = plain.select("table_schema", "table_name", F.lit("table").alias("kind"), F.lit(None).cast("long").alias("row_estimate"))
        if not self.query(spark, "select 1 as one from pg_extension where extname = 'timescaledb'").head():
            return plain.distinct()
        hyper = self.query(spark, HYPERTABLES).select("table_schema", "table_name", F.lit("hypertable").alias("kind"), F.col("row_estimate").cast("long"))
        return hyper.union(plain.join(hyper, ["table_schema", "table_name"], "left_anti")).distinct()

    def columns(self, spark: SparkSession, schema: str, name: str) -> DataFrame:
        """column_name, data_type, nullable, ordinal_position, dtype (the Spark type that it is read as)."""
        identifier(schema), identifier(name)
        found = self.query(spark, f"select column_name, data_type, is_nullable, ordinal_position from information_schema.columns where table_schema = '{schema}' and table_name = '{name}'")
        dtype = F.element_at(F.create_map(*[F.lit(x) for pair in DB_TYPES.items() for x in pair]), F.col("data_type"))
        return found.select("column_name", "data_type", (F.col("is_nullable") == "YES").alias("nullable"), "ordinal_position", F.coalesce(dtype, F.lit("string")).alias("dtype"))


def table_query(schema: str, name: str, columns: list[str], ts: str, start: Any = None, end: Any = None, limit: int = LIMITS.table_rows) -> str:
    """The statement that loads a slice of a table, with its filters for the database to apply."""
    from ..functions.columns import instant

    names = ", ".join(identifier(c) for c in dict.fromkeys([ts, *columns]))
    bounds = [f"{identifier(ts)} {op} timestamp '{instant(v).isoformat(' ')}'" for op, v in ((">=", start), ("<=", end)) if v is not None]
    where = f" where {' and '.join(bounds)}" if bounds else ""
    return f"select {names} from {identifier(f'{schema}.{name}')}{where} order by {identifier(ts)} limit {int(limit)}"


def load_table(spark: SparkSession, db: Database, schema: str, name: str, columns: list[str] | None = None, ts: str | None = None, **bounds: Any) -> Dataset:
    """A slice of a table; without columns all of them, without ts the first that is a time."""
    known = db.columns(spark, schema, name).orderBy("ordinal_position").collect()
    wanted = [r for r in known if not columns or r.column_name in columns]
    if not wanted:
        raise ValueError("none of the columns is in the table")
    ts = ts or next((r.column_name for r in [*wanted, *known] if r["dtype"] in ("timestamp", "date")), None)
    if ts is None:
        raise ValueError("the table has no time column")
    rows = db.query(spark, table_query(schema, name, [r.column_name for r in wanted], ts, **bounds))
    # What the source reads as another type than planned becomes null where it does not fit.
    plan = {r.column_name: r["dtype"] for r in known}
    fitted = [F.expr(f"try_cast(`{c}` as {plan.get(c, 'string')})").alias(c) for c in rows.columns]
    return Dataset(normalise_time(rows.select(*fitted), ts), ts)


def sample_path(name: str, folder: str) -> str:
    """The path of a built-in sample file; other names are refused."""
    if name not in SAMPLES:
        raise ValueError(f"no sample dataset is called {name!r}")
    return f"{folder.rstrip('/')}/{name}"
