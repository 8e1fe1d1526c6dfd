from eventweir.functions.schema import EVENT_SCHEMA, with_defaults


def events(spark, rows, now=100):
    """Events from dicts of some of their fields."""
    from pyspark.sql import functions as F

    fields = [f for f in EVENT_SCHEMA if any(f.name in r for r in rows) or f.name in ("name", "host")]
    data = [tuple(r.get(f.name, {"name": "A", "host": "x"}.get(f.name)) for f in fields) for r in rows]
    from pyspark.sql import types as T

    return with_defaults(spark.createDataFrame(data, T.StructType([T.StructField(f.name, f.dataType) for f in fields])), F.lit(now).cast("long"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())
