"""The event table: schema, validation, and the binding of the `events` test table to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the event model.
TYPES = ("raw", "compressed", "aggregated", "synthetic", "timeout", "internal")
STATUSES = ("active", "inactive")
REFERENCE_TYPES = ("child", "parent", "cross")
#: Text of an attribute that compressed events disagree on.
MULTIPLE = "[multiple values]"
#: Host of events that the engine itself makes.
ENGINE_HOST = "engine"

HISTORY = T.ArrayType(
    T.StructType(
        [
            T.StructField("rule", T.StructType([T.StructField("groupname", T.StringType()), T.StructField("rulename", T.StringType())])),
            T.StructField("host", T.StringType()),
            T.StructField("timestamp", T.LongType()),
            T.StructField("fields", T.ArrayType(T.StringType())),
            T.StructField("reason", T.StringType()),
        ]
    )
)
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType(), False),
        T.StructField("host", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("creation", T.LongType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("local", T.BooleanType()),
        T.StructField("forwarded", T.BooleanType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("references", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("history", HISTORY),
    ]
)
#: Fields that leave the engine: all but the bookkeeping of forwarding.
PUBLIC_FIELDS = tuple(f.name for f in EVENT_SCHEMA if f.name != "forwarded")


def effective_count(kind: Column | str = "type", count: Column | str = "count") -> Column:
    """How many raw events a row stands for: its count if it is a compressed event, else 1."""
    kind, count = (F.col(c) if isinstance(c, str) else c for c in (kind, count))
    return F.when(kind == "compressed", count).otherwise(F.lit(1)).cast("long")


def event_id(*parts: Column) -> Column:
    """A deterministic id: SHA-256 over the parts, so that a retried task makes the same id again."""
    return F.sha2(F.concat_ws("/", *parts), 256)


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def with_defaults(df: DataFrame, now: Column | None = None) -> DataFrame:
    """The full event schema from any subset of its columns (name and host at least). now: time of missing creation and arrival."""
    if missing := {"name", "host"} - set(df.columns):
        raise ValueError(f"an event needs {sorted(missing)}")
    if unknown := set(df.columns) - {f.name for f in EVENT_SCHEMA}:
        raise ValueError(f"not fields of an event: {sorted(unknown)}")
    now = F.unix_timestamp() if now is None else now
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    columns = {
        "name": F.col("name"),
        "host": F.col("host"),
        "description": F.coalesce(has("description"), F.lit("-")),
        "type": F.coalesce(has("type"), F.lit("raw")),
        "status": F.coalesce(has("status"), F.lit("active")),
        "count": has("count"),
        "creation": F.coalesce(has("creation"), now),
        "arrival": F.coalesce(has("arrival"), now),
        "local": F.coalesce(has("local"), F.lit(False)),
        "forwarded": F.coalesce(has("forwarded"), F.lit(False)),
        "attributes": F.coalesce(has("attributes"), F.create_map().cast("map<string,string>")),
        "references": F.coalesce(has("references"), F.create_map().cast("map<string,array<string>>")),
        "history": F.coalesce(has("history"), F.array().cast(HISTORY)),
    }
    columns["id"] = F.coalesce(has("id"), event_id(columns["host"], columns["name"], columns["creation"].cast("string")))
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])


def problems() -> Column:
    """Why a row is not a valid event: an array of reasons, empty if it is one."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    return F.array_compact(
        F.array(
            F.when(blank("name"), F.lit("name missing")),
            F.when(blank("host"), F.lit("host missing")),
            F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), F.lit("unknown type")),
            F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("unknown status")),
            F.when((F.col("type") == "compressed") & F.col("count").isNull(), F.lit("count missing")),
            F.when((F.col("type") != "compressed") & F.col("count").isNotNull(), F.lit("count unexpected")),
        )
    )


def validated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    checked = df.withColumn("reasons", problems())
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test table `events` as events. Narrow: attributes hold k and log, references and history are left to the operators."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    arrival = F.unix_seconds(F.col("ts").cast("timestamp"))
    k = F.regexp_extract("props", r"(\d+)", 1)
    user = F.col("user_id")
    host = F.concat(F.lit("host-"), F.expr("user_id div 4").cast("string"), F.lit("-"), (user % 4 + 1).cast("string"))
    return raw.select(
        n.cast("string").alias("id"),
        F.upper("event_type").alias("name"),
        host.alias("host"),
        F.lit("-").alias("description"),
        F.when(n % 7 == 0, "compressed").otherwise("raw").alias("type"),
        F.when(n % 10 == 0, "inactive").otherwise("active").alias("status"),
        F.when(n % 7 == 0, n % 5 + 2).alias("count"),
        (arrival - k.cast("long")).alias("creation"),
        arrival.alias("arrival"),
        (n % 11 == 0).alias("local"),
        (n % 13 == 0).alias("forwarded"),
        F.create_map(F.lit("k"), k, F.lit("log"), log_line(raw, arrival, k)).alias("attributes"),
    )


def log_line(raw: DataFrame, arrival: Column, k: Column) -> Column:
    """A syslog-style line for a row of `events`: errors and signups read like logins, the rest like requests."""
    user = F.col("user_id").cast("string")
    when = F.date_format(F.timestamp_seconds(arrival), "MMM dd HH:mm:ss")
    login = lambda what: F.concat(F.lit("sshd[10"), k, F.lit(f"]: {what} password for u"), user, F.lit(" from 10.0.0."), user, F.lit(" port "), k)
    body = F.when(F.col("event_type") == "error", login("Failed")).when(F.col("event_type") == "signup", login("Accepted"))
    return F.concat(when, F.lit(" server-"), user, F.lit(" "), body.otherwise(F.concat(F.lit("app: "), F.col("event_type"), F.lit(" took "), k, F.lit("ms"))))


#: The same binding in DuckDB SQL, as a common table expression.
EVENT_SQL = r"""e0 AS (SELECT *, epoch_us(ts) // 1000000 AS at_, regexp_extract(props, '(\d+)', 1) AS k_ FROM events),
e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id AS n, upper(event_type) AS name, 'host-' || (user_id // 4) || '-' || (user_id % 4 + 1) AS host,
  CASE WHEN event_id % 7 = 0 THEN 'compressed' ELSE 'raw' END AS type, CASE WHEN event_id % 10 = 0 THEN 'inactive' ELSE 'active' END AS status,
  CASE WHEN event_id % 7 = 0 THEN event_id % 5 + 2 END AS count, at_ - CAST(k_ AS BIGINT) AS creation, at_ AS arrival,
  event_id % 11 = 0 AS local, event_id % 13 = 0 AS forwarded, k_ AS k, user_id,
  strftime(ts, '%b %d %H:%M:%S') || ' server-' || user_id || ' ' || CASE event_type
    WHEN 'error' THEN 'sshd[10' || k_ || ']: Failed password for u' || user_id || ' from 10.0.0.' || user_id || ' port ' || k_
    WHEN 'signup' THEN 'sshd[10' || k_ || ']: Accepted password for u' || user_id || ' from 10.0.0.' || user_id || ' port ' || k_
    ELSE 'app: ' || event_type || ' took ' || k_ || 'ms' END AS log
  FROM e0)"""
