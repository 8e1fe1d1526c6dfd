"""Queries: counts, sequences, patterns, contexts and horizons."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventweir.functions import predicates as P
from eventweir.functions.schema import EVENT_SQL, event_view
from eventweir.operators import conditions as C
from eventweir.operators import contexts as X
from eventweir.operators import horizons as H
from eventweir.operators.frames import compared
from eventweir.queries import query

E = f"WITH RECURSIVE {EVENT_SQL}"
DAY = 86400
ERROR_SQL = "name = 'ERROR'"


def q(name: str) -> F.Column:
    return P.event_name(name)


ERRORS = f"count(CASE WHEN name = 'ERROR' THEN 1 END) OVER (PARTITION BY host ORDER BY arrival RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)"


def counted(op: str, threshold: int):
    def run(spark, d):
        rows = C.count_sliding(event_view(spark, d), q("ERROR"), ["host"], DAY)
        return rows.where(q("ERROR") & compared(F.col("n"), threshold, op)).select("id", "host", "arrival", "n")

    run.__name__ = f"count_{op}_sliding"
    sign = {"ge": ">=", "eq": "=", "le": "<="}[op]
    query(f"{E} SELECT id, host, arrival, n FROM (SELECT id, host, arrival, name, {ERRORS} AS n FROM e) WHERE name = 'ERROR' AND n {sign} {threshold}")(run)
    return run


count_ge_sliding, count_eq_sliding, count_le_sliding = counted("ge", 2), counted("eq", 2), counted("le", 1)


@query(f"{E} SELECT id, count(*) OVER (PARTITION BY host ORDER BY arrival RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n FROM e")
def count_same_host(spark, d):
    return C.count_sliding(event_view(spark, d), F.lit(True), ["host"], DAY).select("id", "n")


@query(f"{E} SELECT host, count(CASE WHEN name = 'ERROR' THEN 1 END) AS n, count(CASE WHEN name = 'ERROR' THEN 1 END) >= 5 AS hit FROM e GROUP BY host")
def count_threshold_by_host(spark, d):
    return C.count_by(event_view(spark, d), q("ERROR"), ["host"], 5)


@query(
    f"""{E} SELECT t.id, EXISTS (SELECT 1 FROM e a, e b, e c WHERE a.host = t.host AND b.host = t.host AND c.host = t.host AND a.name = 'ERROR' AND b.name = 'CLICK' AND c.name = 'VIEW'
AND a.arrival >= t.arrival - {2 * DAY} AND a.arrival < b.arrival AND b.arrival < c.arrival AND c.arrival <= t.arrival) AS hit FROM e t WHERE t.name = 'PURCHASE'"""
)
def sequence_any_sliding(spark, d):
    rows = C.sequence_any_sliding(event_view(spark, d), [q("ERROR"), q("CLICK"), q("VIEW")], ["host"], 2 * DAY)
    return rows.where(q("PURCHASE")).select("id", "hit")


@query(
    f"""{E} SELECT host, arrival // {DAY} AS day, coalesce(max(CASE WHEN name = 'VIEW' THEN creation END) < min(CASE WHEN name = 'CLICK' THEN creation END), false) AS hit FROM e GROUP BY ALL"""
)
def sequence_all_by_host(spark, d):
    rows = event_view(spark, d).withColumn("day", F.floor(F.col("arrival") / DAY))
    return C.sequence_all_by(rows, [q("VIEW"), q("CLICK")], ["host", "day"])


@query(
    f"""{E} SELECT host, arrival // {DAY} AS day, coalesce(count(CASE WHEN name = 'VIEW' THEN 1 END) > 0 AND count(CASE WHEN name = 'CLICK' THEN 1 END) > 0
AND max(CASE WHEN name IN ('VIEW', 'CLICK') THEN creation END) - min(CASE WHEN name IN ('VIEW', 'CLICK') THEN creation END) <= 21600, false) AS hit FROM e GROUP BY ALL"""
)
def within_all_by_host(spark, d):
    rows = event_view(spark, d).withColumn("day", F.floor(F.col("arrival") / DAY))
    return C.within_all_by(rows, [q("VIEW"), q("CLICK")], ["host", "day"], 21600)


@query(
    f"""{E} SELECT h.host, EXISTS (SELECT 1 FROM e a, e b, e c WHERE a.host = h.host AND b.host = h.host AND c.host = h.host AND a.name = 'ERROR' AND b.name = 'PURCHASE' AND c.name = 'SIGNUP'
AND greatest(a.creation, b.creation, c.creation) - least(a.creation, b.creation, c.creation) <= 43200) AS hit FROM (SELECT DISTINCT host FROM e) h"""
)
def within_any_by_host(spark, d):
    return C.within_any_by(event_view(spark, d), [q("ERROR"), q("PURCHASE"), q("SIGNUP")], ["host"], 43200)


SEEN = f"x.host = t.host AND x.arrival BETWEEN t.arrival - {DAY} AND t.arrival"


@query(
    f"""{E} SELECT t.id, coalesce(max(CASE WHEN x.name = 'VIEW' THEN x.creation END) < min(CASE WHEN x.name = 'CLICK' THEN x.creation END), false) AS hit
FROM e t JOIN e x ON {SEEN} WHERE t.name = 'PURCHASE' GROUP BY t.id"""
)
def sequence_all_sliding(spark, d):
    rows = C.sequence_all_sliding(event_view(spark, d), [q("VIEW"), q("CLICK")], ["host"], DAY, sort="creation")
    return rows.where(q("PURCHASE")).select("id", "hit")


@query(
    f"""{E} SELECT t.id, coalesce(count(CASE WHEN x.name = 'VIEW' THEN 1 END) > 0 AND count(CASE WHEN x.name = 'CLICK' THEN 1 END) > 0
AND max(CASE WHEN x.name IN ('VIEW', 'CLICK') THEN x.creation END) - min(CASE WHEN x.name IN ('VIEW', 'CLICK') THEN x.creation END) <= 21600, false) AS hit
FROM e t JOIN e x ON {SEEN} WHERE t.name = 'PURCHASE' GROUP BY t.id"""
)
def within_all_sliding(spark, d):
    rows = C.within_all_sliding(event_view(spark, d), [q("VIEW"), q("CLICK")], ["host"], DAY, 21600, sort="creation")
    return rows.where(q("PURCHASE")).select("id", "hit")


@query(
    f"""{E} SELECT h.host, EXISTS (SELECT 1 FROM e a, e b, e c WHERE a.host = h.host AND b.host = h.host AND c.host = h.host AND a.name = 'ERROR' AND b.name = 'SIGNUP' AND c.name = 'ERROR'
AND a.creation < b.creation AND b.creation < c.creation AND a.arrival // {30 * DAY} = h.month AND b.arrival // {30 * DAY} = h.month AND c.arrival // {30 * DAY} = h.month) AS hit, h.month FROM (SELECT DISTINCT host, arrival // {30 * DAY} AS month FROM e) h"""
)
def sequence_any_by_host(spark, d):
    rows = event_view(spark, d).withColumn("month", F.floor(F.col("arrival") / (30 * DAY)))
    return C.sequence_any_by(rows, [q("ERROR"), q("SIGNUP"), q("ERROR")], ["host", "month"])


# minutes, and all hosts together: creation, up to 100 seconds before arrival, decides what is seen and in which order
AXES = "x.status = t.status AND x.arrival <= t.arrival AND x.creation + {0} >= t.arrival"


@query(
    f"""{E} SELECT t.id, EXISTS (SELECT 1 FROM e x, e y WHERE {AXES.format(900)} AND {AXES.replace("x.", "y.").format(900)} AND x.name = 'VIEW' AND y.name = 'CLICK' AND x.creation < y.creation) AS hit
FROM e t WHERE t.name = 'PURCHASE'"""
)
def sequence_two_axes(spark, d):
    rows = C.sequence_two_axes(event_view(spark, d), [q("VIEW"), q("CLICK")], ["status"], 900, source="creation")
    return rows.where(q("PURCHASE")).select("id", "hit")


@query(
    f"""{E} SELECT t.id, EXISTS (SELECT 1 FROM e x, e y WHERE {AXES.format(1800)} AND {AXES.replace("x.", "y.").format(1800)} AND x.name = 'VIEW' AND y.name = 'CLICK' AND abs(x.creation - y.creation) <= 120) AS hit
FROM e t WHERE t.name = 'PURCHASE'"""
)
def within_two_axes(spark, d):
    rows = C.within_two_axes(event_view(spark, d), [q("VIEW"), q("CLICK")], ["status"], 1800, 120, source="creation")
    return rows.where(q("PURCHASE")).select("id", "hit")


ALPHABET = (("p", "PURCHASE"), ("e", "ERROR"), ("s", "SIGNUP"), ("c", "CLICK"), ("v", "VIEW"))
SYMBOL = "CASE name WHEN 'PURCHASE' THEN 'p' WHEN 'ERROR' THEN 'e' WHEN 'SIGNUP' THEN 's' WHEN 'CLICK' THEN 'c' ELSE 'v' END"
NUMBER = "CASE name WHEN 'PURCHASE' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'SIGNUP' THEN 2 WHEN 'CLICK' THEN 3 ELSE 4 END"


@query(f"{E} SELECT host, day, symbols, regexp_matches(symbols, 'v.?c') AS matched FROM (SELECT host, arrival // {7 * DAY} AS day, string_agg({SYMBOL}, '' ORDER BY creation, {NUMBER}, id) AS symbols FROM e GROUP BY ALL)")
def pattern_string_by_host(spark, d):
    rows = event_view(spark, d).withColumn("day", F.floor(F.col("arrival") / (7 * DAY)))
    return C.pattern_by(rows, [(s, q(n)) for s, n in ALPHABET], "v.?c", ["host", "day"])


@query(
    f"""{E} SELECT t.id, string_agg({SYMBOL.replace("name", "x.name")}, '' ORDER BY x.arrival, {NUMBER.replace("name", "x.name")}, x.id) AS symbols, regexp_matches(string_agg({SYMBOL.replace("name", "x.name")}, '' ORDER BY x.arrival, {NUMBER.replace("name", "x.name")}, x.id), 'e.*p') AS matched
FROM e t JOIN e x ON x.host = t.host AND x.arrival BETWEEN t.arrival - {DAY} AND t.arrival WHERE t.name = 'PURCHASE' GROUP BY t.id"""
)
def pattern_match(spark, d):
    rows = C.pattern_sliding(event_view(spark, d), [(s, q(n)) for s, n in ALPHABET], "e.*p", ["host"], DAY)
    return rows.where(q("PURCHASE")).select("id", "symbols", "matched")


@query(
    f"""{E} SELECT t.id, coalesce(string_agg({SYMBOL.replace("name", "x.name")}, '' ORDER BY x.creation, {NUMBER.replace("name", "x.name")}, x.id), '') AS symbols, coalesce(regexp_matches(string_agg({SYMBOL.replace("name", "x.name")}, '' ORDER BY x.creation, {NUMBER.replace("name", "x.name")}, x.id), 'v.?c'), false) AS matched
FROM e t LEFT JOIN e x ON {AXES.format(900)} WHERE t.name = 'PURCHASE' GROUP BY t.id"""
)
def pattern_two_axes(spark, d):
    rows = event_view(spark, d).select("id", "name", "status", "creation", "arrival")
    return C.pattern_two_axes(rows, [(s, q(n)) for s, n in ALPHABET], "v.?c", ["status"], 900, source="creation", asked=q("PURCHASE")).select("id", "symbols", "matched")


SYMBOLS = f"""string_agg({SYMBOL.replace("name", "x.name")}, '' ORDER BY x.{{0}}, {NUMBER.replace("name", "x.name")}, x.id)"""


@query(f"""{E} SELECT t.id, regexp_matches({SYMBOLS.format("arrival")}, 'e[cv]+(s|p)') AS matched FROM e t JOIN e x ON x.host = t.host AND x.arrival BETWEEN t.arrival - {DAY} AND t.arrival GROUP BY t.id""")
def pattern_dfa(spark, d):
    """Every row's frame against a pattern, without a row's string."""
    return C.pattern_dfa(event_view(spark, d), [(s, q(n)) for s, n in ALPHABET], "e[cv]+(s|p)", ["host"], DAY).select("id", "matched")


@query(f"""{E} SELECT t.id, coalesce(regexp_matches({SYMBOLS.format("creation")}, 'v.?c$'), false) AS matched FROM e t LEFT JOIN e x ON {AXES.format(900)} GROUP BY t.id""")
def pattern_dfa_two_axes(spark, d):
    return C.pattern_dfa(event_view(spark, d), [(s, q(n)) for s, n in ALPHABET], "v.?c$", ["status"], 900, sort="creation", source="creation").select("id", "matched")


@query(f"{E} SELECT t.id, count(DISTINCT x.k) AS n FROM e t JOIN e x ON x.host = t.host AND x.arrival BETWEEN t.arrival - {3 * DAY} AND t.arrival AND x.name IN ('VIEW', 'CLICK') GROUP BY t.id UNION ALL SELECT t.id, 0 FROM e t WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.host = t.host AND x.arrival BETWEEN t.arrival - {3 * DAY} AND t.arrival AND x.name IN ('VIEW', 'CLICK'))")
def count_unique_sliding(spark, d):
    """How many distinct k the views and clicks of each row's frame have."""
    rows = C.count_unique_sliding(event_view(spark, d), q("VIEW") | q("CLICK"), P.attribute("k"), ["host"], 3 * DAY)
    return rows.select("id", "n")


@query(f"""{E} SELECT t.id, coalesce(max(CASE WHEN x.name = 'ERROR' THEN x.creation END) < min(CASE WHEN x.name = 'SIGNUP' THEN x.creation END), false) AS hit FROM e t LEFT JOIN e x ON {AXES.format(900)} GROUP BY t.id""")
def sequence_all_two_axes(spark, d):
    rows = C.sequence_two_axes(event_view(spark, d), [q("ERROR"), q("SIGNUP")], ["status"], 900, "all", source="creation")
    return rows.select("id", "hit")


@query(f"""{E} SELECT t.id, coalesce(count(CASE WHEN x.name = 'ERROR' THEN 1 END) > 0 AND count(CASE WHEN x.name = 'SIGNUP' THEN 1 END) > 0 AND max(x.creation) - min(x.creation) <= 600, false) AS hit FROM e t LEFT JOIN e x ON {AXES.format(1800)} AND x.name IN ('ERROR', 'SIGNUP') GROUP BY t.id""")
def within_all_two_axes(spark, d):
    rows = C.within_two_axes(event_view(spark, d), [q("ERROR"), q("SIGNUP")], ["status"], 1800, 600, "all", source="creation")
    return rows.select("id", "hit")


def anchor_sql(keys: str, timeout: int, where: str = "true") -> str:
    """Windows (keys.., s) by recursion: the next one begins at the first event after s + timeout."""
    same = " AND ".join(f"x.{k} = a.{k}" for k in keys.split(", "))
    of = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""o AS (SELECT * FROM e WHERE {where}), a AS (SELECT {keys}, min(arrival) AS s FROM o GROUP BY {keys} UNION ALL
SELECT {of}, min(x.arrival) AS s FROM a JOIN o x ON {same} AND x.arrival > a.s + {timeout} GROUP BY {of}, a.s), w AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY s) - 1 AS seq FROM (SELECT DISTINCT * FROM a))"""


ANCHORED = f"{E}, {anchor_sql('host', DAY)}, r AS (SELECT e.*, w.seq AS win_seq, w.s AS win_start FROM e JOIN w ON w.host = e.host AND e.arrival BETWEEN w.s AND w.s + {DAY})"


@query(f"{ANCHORED} SELECT id, host, win_seq, win_start FROM r")
def anchored_windows(spark, d):
    return X.anchored(event_view(spark, d), ["host"], DAY).select("id", "host", "win_seq", "win_start").withColumn("win_seq", F.col("win_seq").cast("long"))


@query(f"{E}, {anchor_sql('name', 3600)}, r AS (SELECT e.*, w.seq AS win_seq, w.s AS win_start FROM e JOIN w ON w.name = e.name AND e.arrival BETWEEN w.s AND w.s + 3600) SELECT name, win_start, count(*) AS events FROM r GROUP BY ALL")
def anchored_windows_by_name(spark, d):
    return X.anchored(event_view(spark, d), ["name"], 3600).groupBy("name", "win_start").agg(F.count("*").alias("events"))


@query(f"{E}, f AS (SELECT host, min(arrival) AS a FROM e GROUP BY host) SELECT id, (arrival - a) // {DAY + 1} AS win_seq, a + (arrival - a) // {DAY + 1} * {DAY + 1} AS win_start FROM e JOIN f USING (host)")
def repeating_windows(spark, d):
    return X.repeating(event_view(spark, d), ["host"], DAY).select("id", "win_seq", "win_start")


SESSIONS = f"""{E}, g AS (SELECT *, CASE WHEN arrival - lag(arrival) OVER (PARTITION BY host ORDER BY arrival) > {DAY // 2} THEN 1 ELSE 0 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY arrival RANGE UNBOUNDED PRECEDING) AS seq FROM g)"""


@query(f"{SESSIONS} SELECT host, CAST(seq AS BIGINT) AS win_seq, min(arrival) AS win_start, count(*) AS events FROM s GROUP BY ALL")
def session_windows(spark, d):
    return X.sessions(event_view(spark, d), ["host"], DAY // 2).groupBy("host", "win_seq", "win_start").agg(F.count("*").alias("events"))


@query(
    f"""{ANCHORED}, c AS (SELECT *, sum(CASE WHEN name = 'SIGNUP' THEN 1 ELSE 0 END) OVER (PARTITION BY host, win_seq ORDER BY arrival, id ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT id, CAST(sum(CASE name WHEN 'SIGNUP' THEN 3 WHEN 'ERROR' THEN 2 WHEN 'VIEW' THEN -1 ELSE 0 END) OVER (PARTITION BY host, win_seq, run ORDER BY arrival, id ROWS UNBOUNDED PRECEDING) + CASE WHEN run = 0 THEN 1 ELSE 0 END AS BIGINT) AS counter FROM c"""
)
def context_counter_running(spark, d):
    rows = X.anchored(event_view(spark, d), ["host"], DAY)
    op = F.when(q("SIGNUP"), "set").when(q("ERROR"), "inc").when(q("VIEW"), "dec")
    value = F.when(q("SIGNUP"), 3).when(q("ERROR"), 2).otherwise(1)
    return X.counter(rows, ["host", "win_seq"], op, value, initial=1).select("id", "counter")


OPENED = f"{E}, {anchor_sql('host', DAY, ERROR_SQL)}, r AS (SELECT e.*, w.s AS context_start FROM e LEFT JOIN w ON w.host = e.host AND e.arrival BETWEEN w.s AND w.s + {DAY})"


@query(f"{OPENED} SELECT id, context_start FROM r WHERE context_start IS NOT NULL")
def context_active(spark, d):
    return X.open_at(event_view(spark, d), q("ERROR"), ["host"], DAY).where("context_start is not null").select("id", "context_start")


@query(f"{OPENED} SELECT id FROM r WHERE context_start IS NULL")
def context_inactive(spark, d):
    return X.open_at(event_view(spark, d), q("ERROR"), ["host"], DAY).where("context_start is null").select("id")


@query(
    f"""{OPENED} SELECT id, CASE WHEN context_start IS NOT NULL THEN count(CASE WHEN name = 'VIEW' THEN 1 END) OVER (PARTITION BY host, context_start ORDER BY arrival RANGE UNBOUNDED PRECEDING) END AS counter,
coalesce(CASE WHEN context_start IS NOT NULL THEN count(CASE WHEN name = 'VIEW' THEN 1 END) OVER (PARTITION BY host, context_start ORDER BY arrival RANGE UNBOUNDED PRECEDING) END >= 2, false) AS hit FROM r"""
)
def context_counter_check(spark, d):
    return X.counter_at(event_view(spark, d), q("ERROR"), q("VIEW"), ["host"], DAY, 2, "ge").select("id", "counter", "hit")


@query(f"{OPENED} SELECT host, context_start, id FROM r WHERE context_start IS NOT NULL AND name IN ('VIEW', 'CLICK')")
def associate_context(spark, d):
    rows = X.open_at(event_view(spark, d), q("ERROR"), ["host"], DAY)
    return rows.where(F.col("context_start").isNotNull() & (q("VIEW") | q("CLICK"))).select("host", "context_start", "id")


@query(f"{ANCHORED} SELECT host, win_start + {DAY + 1} AS creation, count(*) AS context_counter, string_agg(id, ',' ORDER BY id) AS children FROM r GROUP BY host, win_start")
def context_timeouts(spark, d):
    opened = X.contexts(X.anchored(event_view(spark, d), ["host"], DAY), ["host"], DAY)
    fired = X.timeouts(opened.withColumnRenamed("host", "key"), ["key"], "CE:TIMEOUT")
    return fired.select(F.col("key").alias("host"), "creation", F.try_element_at("attributes", F.lit("context_counter")).cast("long").alias("context_counter"), F.array_join(F.try_element_at("references", F.lit("child")), ",").alias("children"))


@query(f"{ANCHORED} SELECT CAST(win_start // {7 * DAY} AS BIGINT) AS week, count(*) AS contexts, sum(n)::BIGINT AS events, count(CASE WHEN s + {DAY} < 1705000000 THEN 1 END) AS stale FROM (SELECT host, win_start, win_start AS s, count(*) AS n FROM r GROUP BY ALL) GROUP BY week")
def contexts_by_group(spark, d):
    opened = X.contexts(X.anchored(event_view(spark, d), ["host"], DAY), ["host"], DAY)
    return opened.groupBy(F.floor(F.col("start") / (7 * DAY)).alias("week")).agg(F.count("*").alias("contexts"), F.sum("counter").alias("events"), F.count_if(F.col("end") < 1705000000).alias("stale"))


@query(f"{E} SELECT t.id, t.host, t.arrival FROM e t WHERE name = 'ERROR' AND NOT EXISTS (SELECT 1 FROM e c WHERE c.host = t.host AND c.name = 'VIEW' AND c.arrival > t.arrival AND c.arrival <= t.arrival + {DAY // 2})")
def missing_followup(spark, d):
    return X.missing_followup(event_view(spark, d), q("ERROR"), q("VIEW"), ["host"], DAY // 2).select("id", "host", "arrival")


def horizons() -> list[H.Horizon]:
    return [
        H.Horizon("compress", "errors", q("ERROR"), 300, delay=True),
        H.Horizon("count", "same host", P.event_status("active"), 3600),
        H.Horizon("sequence", "views", q("VIEW") & P.event_attribute("k", "50", "ge"), 7200, "creation"),
    ]


HORIZON_SQL = """h AS (SELECT *, greatest(creation, arrival, CASE WHEN name = 'ERROR' THEN arrival + 300 ELSE arrival END) AS delay_time FROM e),
h2 AS (SELECT *, greatest(delay_time, CASE WHEN status = 'active' THEN arrival + 3600 ELSE arrival END, CASE WHEN name = 'VIEW' AND CAST(k AS BIGINT) >= 50 THEN creation + 7200 ELSE arrival END) AS cache_time FROM h)"""


@query(f"{E}, {HORIZON_SQL} SELECT id, delay_time, cache_time FROM h2")
def delay_cache_horizon(spark, d):
    return H.delay_and_cache_time(event_view(spark, d), horizons()).select("id", "delay_time", "cache_time")


OCCUPANCY = f'{E}, {HORIZON_SQL}, st AS (SELECT "at", sum(dd) AS dd FROM (SELECT arrival AS "at", 1 AS dd FROM h2 UNION ALL SELECT cache_time + 1, -1 FROM h2) GROUP BY "at" HAVING sum(dd) <> 0), oc AS (SELECT "at", CAST(sum(dd) OVER (ORDER BY "at") AS BIGINT) AS held FROM st)'


@query(f'{OCCUPANCY} SELECT "at", held FROM oc')
def cache_occupancy(spark, d):
    return H.occupancy(H.delay_and_cache_time(event_view(spark, d), horizons()))


@query(
    f"""{OCCUPANCY}, ov AS (SELECT "at" FROM oc WHERE held > 12), al AS (SELECT min("at") AS s FROM ov UNION ALL SELECT (SELECT min("at") FROM ov WHERE "at" > al.s + 3600) FROM al WHERE s IS NOT NULL)
SELECT s AS "at" FROM al WHERE s IS NOT NULL"""
)
def occupancy_alerts(spark, d):
    held = H.occupancy(H.delay_and_cache_time(event_view(spark, d), horizons()))
    over = held.where("held > 12").withColumn("all", F.lit(0))
    return X.anchored(over, ["all"], 3600, "at", block=6 * 3600).select(F.col("win_start").alias("at")).distinct()


@query(f"{E}, {HORIZON_SQL} SELECT id, delay_time FROM h2 WHERE NOT local ORDER BY delay_time, creation, id")
def forward_order(spark, d):
    rows = H.delay_and_cache_time(event_view(spark, d), horizons()).where(~F.col("local"))
    return H.forward_order(rows).select("id", "delay_time")


@query(f"{E}, {HORIZON_SQL} SELECT id, delay_time FROM h2 WHERE delay_time < 1705000000 AND n % 3 <> 0 AND NOT forwarded")
def unaccounted_delay(spark, d):
    n = F.col("id").cast("long")
    one = F.array(F.struct(F.lit("g").alias("group"), F.lit("c").alias("name")))
    rows = H.delay_and_cache_time(event_view(spark, d), horizons()).withColumn("delay_contexts", F.when(n % 3 == 0, one).otherwise(F.filter(one, lambda c: F.lit(False))))
    return H.unaccounted(rows, 1705000000).select("id", "delay_time")


@query(
    f"""{E}, m AS (SELECT DISTINCT name, 'arrival' AS time_source, true AS delay, 'compress' AS rule, 'errors' AS query, CAST(300 AS BIGINT) AS max_age FROM e WHERE name = 'ERROR' UNION ALL
SELECT DISTINCT name, 'arrival', false, 'count', 'same host', 3600 FROM e WHERE status = 'active' UNION ALL SELECT DISTINCT name, 'creation', false, 'sequence', 'views', 7200 FROM e WHERE name = 'VIEW' AND CAST(k AS BIGINT) >= 50) SELECT * FROM m"""
)
def max_horizon_by_name(spark, d):
    return H.longest(horizons(), event_view(spark, d))
