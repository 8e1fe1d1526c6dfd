"""Queries: compression, counters, balance, rates, digests, audit trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.functions import schema
from eventweir.functions.schema import EVENT_SQL, MULTIPLE, event_view
from eventweir.operators import actions
from eventweir.operators import contexts as X
from eventweir.operators import reports as B
from eventweir.queries import query
from eventweir.queries.filters import LINE
from eventweir.queries.windows import anchor_sql
from eventweir.sources import writers

E = f"WITH RECURSIVE {EVENT_SQL}"
DAY = 86400
AGREE = "CASE WHEN min({0}) = max({0}) THEN min({0}) ELSE {1} END"


def merged(rows: str, keys: str) -> str:
    """Compressed events of the groups of rows, in SQL."""
    agree = lambda c, d: AGREE.format(c, d)
    return f"""SELECT {keys}, CASE WHEN count(*) > 1 THEN 'compressed' ELSE min(type) END AS type, CASE WHEN count(*) > 1 THEN CAST(sum(CASE WHEN type = 'compressed' THEN count ELSE 1 END) AS BIGINT) ELSE min(count) END AS count,
{agree('status', "'active'")} AS status, min(creation) AS creation, min(arrival) AS arrival, {agree('k', f"'{MULTIPLE}'")} AS k FROM {rows} GROUP BY {keys}"""


def compressible(df):
    return df.where(~F.col("forwarded"))


@query(f"{E}, c AS (SELECT * FROM e WHERE NOT forwarded) {merged('c', 'name')}")
def compress_by_name(spark, d):
    out = actions.compress(compressible(event_view(spark, d)), ["name"], ["k"])
    return out.select("name", "type", "count", "status", "creation", "arrival", P.attribute("k").alias("k"))


SUBJECT = "NOT forwarded AND status = ''active'' AND name = ''ERROR''".replace("''", "'")


@query(f"{E}, {anchor_sql('host', 2 * DAY, SUBJECT)}, c AS (SELECT o.*, w.s AS win_start FROM o JOIN w ON w.host = o.host AND o.arrival BETWEEN w.s AND w.s + {2 * DAY}) {merged('c', 'name, host, win_start')}")
def compress_windows(spark, d):
    rows = compressible(event_view(spark, d)).where((F.col("status") == "active") & P.event_name("ERROR"))
    out = actions.compress(X.anchored(rows, ["host"], 2 * DAY), ["name", "host", "win_start"], ["k"])
    return out.select("name", "host", "win_start", "type", "count", "status", "creation", "arrival", P.attribute("k").alias("k"))


@query(f"""{E}, a AS (SELECT host, 'k' AS attribute, k AS v FROM e UNION ALL SELECT host, 'log', log FROM e UNION ALL SELECT host, 'first', 'same' FROM e WHERE name = 'SIGNUP')
SELECT host, attribute, CASE WHEN min(v) = max(v) THEN min(v) ELSE '{MULTIPLE}' END AS value FROM a GROUP BY host, attribute""")
def compress_attributes(spark, d):
    more = F.when(P.event_name("SIGNUP"), F.map_concat("attributes", F.create_map(F.lit("first"), F.lit("same")))).otherwise(F.col("attributes"))
    return actions.merged_attributes(event_view(spark, d).withColumn("attributes", more), ["host"])


REFERRED = """r AS (SELECT *, 'u' || (n % 20) AS child, CASE WHEN n % 3 = 0 THEN 'c' || (n % 50) END AS cross_, CASE WHEN name = 'SIGNUP' AND n % 2 = 0 THEN 'd' ELSE '-' END AS description FROM e),
c AS (SELECT * FROM r WHERE NOT forwarded AND n % 17 <> 0), g AS (SELECT name, host, count(*) AS rows_ FROM c GROUP BY ALL)"""


def full_events(spark, d):
    """The events with references, history and a few descriptions; every 17th one is in a context."""
    n = F.col("id").cast("long")
    rows = event_view(spark, d).withColumn("references", F.create_map(F.lit("child"), F.array(F.concat(F.lit("u"), (n % 20).cast("string"))), F.lit("cross"), F.when(n % 3 == 0, F.array(F.concat(F.lit("c"), (n % 50).cast("string")))).otherwise(F.array().cast("array<string>"))))
    rows = rows.withColumn("history", F.array().cast(schema.HISTORY)).withColumn("description", F.when(P.event_name("SIGNUP") & (n % 2 == 0), "d").otherwise("-"))
    return rows, actions.compressible() & (n % 17 != 0)


@query(f"""{E}, {REFERRED}, m AS (SELECT name, host, list_sort(list(DISTINCT child)) AS child, list_sort(list(DISTINCT cross_) FILTER (cross_ IS NOT NULL)) AS cross_, CAST(sum(CASE WHEN type = 'compressed' THEN count ELSE 1 END) AS BIGINT) AS count,
min(creation) AS creation, {AGREE.format("description", "''")} AS description, {AGREE.format("local", "false")} AS local FROM c GROUP BY ALL HAVING count(*) > 1)
SELECT name, host, 'compressed' AS type, array_to_string(child, ',') AS child, coalesce(array_to_string(cross_, ','), '') AS cross_refs, count, creation, description, local FROM m
UNION ALL SELECT name, host, type, child, coalesce(cross_, ''), coalesce(count, 0), creation, description, local FROM r WHERE forwarded OR n % 17 = 0
UNION ALL SELECT name, host, type, child, coalesce(cross_, ''), coalesce(count, 0), creation, description, local FROM c JOIN g USING (name, host) WHERE rows_ = 1""")
def compress_references(spark, d):
    rows, where = full_events(spark, d)
    out = actions.compress_events(rows, ["name", "host"], where)
    refs = lambda t: F.coalesce(F.array_join(F.try_element_at("references", F.lit(t)), ","), F.lit(""))
    return out.select("name", "host", "type", refs("child").alias("child"), refs("cross").alias("cross_refs"), F.coalesce("count", F.lit(0)).alias("count"), "creation", "description", "local")


@query(f"""{E}, {REFERRED}, a AS (SELECT name, host, 'k' AS attribute, k AS v FROM c UNION ALL SELECT name, host, 'log', log FROM c UNION ALL SELECT name, host, 'odd', child FROM c WHERE n % 2 = 1)
SELECT name, host, attribute, CASE WHEN min(v) = max(v) THEN min(v) ELSE '{MULTIPLE}' END AS value FROM a JOIN g USING (name, host) WHERE rows_ > 1 GROUP BY name, host, attribute""")
def compress_all_attributes(spark, d):
    rows, where = full_events(spark, d)
    odd = F.when(F.col("id").cast("long") % 2 == 1, F.map_concat("attributes", F.create_map(F.lit("odd"), F.try_element_at("references", F.lit("child"))[0]))).otherwise(F.col("attributes"))
    out = actions.compress_events(rows.withColumn("attributes", odd), ["name", "host"], where)
    return out.where("type = 'compressed' and size(history) = 0 and not id rlike '^[0-9]+$'").select("name", "host", F.explode("attributes").alias("attribute", "value"))


WEIGHT = "CAST(sum(CASE WHEN type = 'compressed' THEN count ELSE 1 END) AS BIGINT)"


@query(f"{E} SELECT name, count(*) AS total, count(CASE WHEN status = 'active' THEN 1 END) AS active, {WEIGHT} AS weighted FROM e GROUP BY name")
def event_counters(spark, d):
    return B.counters(event_view(spark, d), "name")


@query(f"{E} SELECT type, status, count(*) AS n FROM e GROUP BY ALL")
def counts_by_type_status(spark, d):
    return event_view(spark, d).groupBy("type", "status").agg(F.count("*").alias("n"))


FATE = "CASE WHEN n % 10 = 0 THEN 'dropped' WHEN n % 7 = 0 THEN 'compressed' WHEN n % 11 = 0 THEN 'waiting' WHEN n % 13 = 0 THEN 'delayed' ELSE 'output' END"


@query(
    f"""{E}, b AS (SELECT 'input' AS disposition, {FATE} AS fate FROM e UNION ALL SELECT DISTINCT 'new', 'output' FROM e GROUP BY name)
SELECT count(CASE WHEN disposition = 'input' THEN 1 END) AS input, count(CASE WHEN disposition = 'new' THEN 1 END) AS new, count(CASE WHEN fate = 'waiting' THEN 1 END) AS waiting, count(CASE WHEN fate = 'delayed' THEN 1 END) AS delayed,
count(CASE WHEN fate = 'dropped' THEN 1 END) AS dropped, count(CASE WHEN fate = 'compressed' THEN 1 END) AS compressed, count(CASE WHEN fate = 'output' THEN 1 END) AS output, count(CASE WHEN disposition IN ('input', 'new') THEN 1 END) - count(CASE WHEN fate IN ('waiting', 'delayed', 'dropped', 'compressed', 'output') THEN 1 END) AS difference FROM (SELECT * FROM b)""".replace("SELECT DISTINCT 'new', 'output' FROM e GROUP BY name", "SELECT 'new', 'output' FROM (SELECT name FROM e WHERE n % 7 = 0 AND n % 10 <> 0 GROUP BY name)")
)
def event_balance(spark, d):
    n = F.col("id").cast("long")
    fate = F.when(n % 10 == 0, "dropped").when(n % 7 == 0, "compressed").when(n % 11 == 0, "waiting").when(n % 13 == 0, "delayed").otherwise("output")
    rows = event_view(spark, d).select("name", F.lit("input").alias("disposition"), fate.alias("fate"))
    made = rows.where("fate = 'compressed'").select("name").distinct().select("name", F.lit("new").alias("disposition"), F.lit("output").alias("fate"))
    return B.balance(rows.unionByName(made))


@query(f"{E} SELECT name, arrival // 60 * 60 AS minute, count(*) AS n FROM e GROUP BY ALL")
def rate_per_minute(spark, d):
    return B.per_minute(event_view(spark, d), "name")


@query(f"{E} SELECT name, count(*) AS n, count(*) / ((max(arrival) - min(arrival)) / 60) AS per_minute FROM e GROUP BY name")
def processing_rate(spark, d):
    return B.rate(event_view(spark, d), "name")


@query(f"{E} SELECT id, CAST(0 AS BIGINT) AS position, 'auth' AS groupname, 'quiet' AS rulename, arrival AS timestamp, 'status' AS fields FROM e WHERE name = 'ERROR' AND status = 'active' UNION ALL SELECT id, CAST(CASE WHEN status = 'active' THEN 1 ELSE 0 END AS BIGINT), 'auth', 'quiet', arrival, 'local' FROM e WHERE name = 'ERROR' AND NOT local")
def event_history(spark, d):
    rows = event_view(spark, d).withColumn("history", F.array().cast(schema.HISTORY))
    out = B.trail(actions.modify(rows, P.event_name("ERROR"), "auth", "quiet", status="inactive", local=True))
    return out.select("id", F.col("position").cast("long").alias("position"), "groupname", "rulename", "timestamp", "fields")


@query(f"{E} SELECT host, arrival // {7 * DAY} AS week, count(*) AS events, 'Errors on ' || host || chr(10) || string_agg({LINE}, chr(10) ORDER BY creation, id) AS body FROM e WHERE name = 'ERROR' GROUP BY host, arrival // {7 * DAY}")
def alert_digest(spark, d):
    rows = event_view(spark, d).where(P.event_name("ERROR")).withColumn("week", F.floor(F.col("arrival") / (7 * DAY)))
    return B.digest(rows, ["host", "week"], writers.line(), F.concat(F.lit("Errors on "), F.col("host")))
