"""URL filters by a temporal list join, with DataFrame functions only.

A dated list has events: on a day an entry is added to the block or allow list, or
removed. Each entry's events become validity intervals [from, until). An entry's key is
a domain, or a host's end with the start of a path; its shape is its number of labels
and of path segments. A capture asks, for each shape that the list holds, about the end
of its host and the start of its path of that shape; these keys are joined with the
entries whose interval holds the day of fetching. The active entry with the longest key
decides; at equal length allow beats block.

URLs that were fetched several times on one day are asked once. Intervals are
broadcast up to `MOST_BROADCAST` rows, else the join shuffles, where AQE can split
hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, cut, table

MOST_BROADCAST = 200_000
EVENTS = "key string, action string, day date"
_FAR = "9999-12-31"
def intervals(events: DataFrame) -> DataFrame:
    """(key, action, since, until) from events (key, action, day): action is block, allow or remove.

    An event holds until the next one of its key; of several on one day the
    strongest counts (allow, then block, then remove). Events without key or day
    are left aside."""
    rank = F.when(F.col("action") == "allow", 0).when(F.col("action") == "block", 1).otherwise(2)
    clean = events.where("key is not null and day is not null").select(F.translate("key", UPPER, LOWER).alias("key"), "day", rank.alias("rank"))
    daily = clean.groupBy("key", "day").agg(F.min("rank").alias("rank"))
    until = F.lead("day", 1).over(Window.partitionBy("key").orderBy("day"))
    spans = daily.select("key", "rank", F.col("day").alias("since"), F.coalesce(until, F.lit(_FAR).cast("date")).alias("until"))
    return spans.where("rank < 2").select("key", F.when(F.col("rank") == 0, "allow").otherwise("block").alias("action"), "since", "until")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host without port, user and final dot, and the path, of an http(s) URL; empty for others."""
    low = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(low, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1), UPPER, LOWER)
    return F.regexp_replace(host, r"\.+$", ""), F.regexp_extract(low, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def shapes_of(spans: DataFrame) -> list[tuple[int, int]]:
    """The (labels, path segments) of the list's keys: a few small numbers, however long the list is."""
    parts = F.split("key", "/")
    shape = spans.select(F.size(F.split(parts[0], r"\.")).alias("labels"), (F.size(parts) - 1).alias("segments"))
    return sorted(map(tuple, shape.distinct().collect()))


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The ends of a host with the starts of a path of whole segments, in the given shapes as far as host and path reach."""
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    out = []
    for n, k in shapes:
        end = F.array_join(F.slice(labels, -n, n), ".")
        key = F.concat(end, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")) if k else end
        out.append(F.when((host != "") & (F.size(labels) >= n) & (F.size(parts) >= k), key))
    return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<string>")


def judge(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """`captures` with host, n_active, entry, action and blocked, by the entries active on the day of each capture.

    Null or malformed URLs and null days match nothing and are not blocked. Repeated
    rows are judged each. Columns of `captures` with the names of the result are
    replaced."""
    if not {url_col, day_col} <= set(captures.columns):
        raise ValueError(f"captures need the columns {url_col} and {day_col}")
    made = ["host", "n_active", "entry", "action", "blocked"]
    kept = [c for c in captures.columns if c not in made]
    spans = cut(intervals(events))
    near = F.broadcast(spans) if spans.count() <= MOST_BROADCAST else spans
    asked = captures.select(F.col(url_col).alias("_url"), F.col(day_col).cast("date").alias("_day")).where("_url is not null and _day is not null").distinct()
    host, path = host_and_path(F.col("_url"))
    keyed = asked.select("_url", "_day", F.explode(keys_of(host, path, shapes_of(spans))).alias("key"))
    active = keyed.join(near, "key").where("since <= _day and _day < until")
    strength = F.struct(F.length("key").alias("n"), (F.col("action") == "allow").cast("int").alias("allow"), F.col("key").alias("key"), F.col("action").alias("action"))
    verdict = active.groupBy("_url", "_day").agg(F.count(F.lit(1)).alias("n_active"), F.max(strength).alias("top"))
    out = captures.select(*kept).join(verdict, (F.col(url_col) == F.col("_url")) & (F.col(day_col).cast("date") == F.col("_day")), "left")
    return out.select(
        *kept, host_and_path(F.col(url_col))[0].alias("host"), F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
        F.col("top.key").alias("entry"), F.col("top.action").alias("action"), F.coalesce(F.col("top.action") == "block", F.lit(False)).alias("blocked"),
    )


def dated_list(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list (key, action, day) for tables without one: events for hosts, domains and first path segments that occur in `pages`.

    An MD5 of the key tells whether a key is listed, on which days of 2024 it is blocked,
    allowed or removed, so the list grows with the table and SQL can make the same one."""
    host, path = host_and_path(F.col(url_col))
    labels, first = F.split(host, r"\."), F.get(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(0))
    domain = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), "."))
    keys = F.array(host, domain, F.get(F.reverse(labels), F.lit(0)), F.concat(host, F.lit("/"), first), F.concat(domain, F.lit("/"), first))
    listed = pages.select(F.explode(F.when(host != "", keys)).alias("key")).where("key is not null").distinct()
    part = lambda at: F.conv(F.substring(F.md5("key"), at, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    event = lambda action, n: F.struct(action.alias("action"), day(n).alias("day"))
    start, more = part(1) % 200, part(5) % 100
    kind = F.when(part(9) % 3 == 0, "allow").otherwise("block")
    events = F.array(event(kind, start), event(F.lit("remove"), start + 1 + more), event(F.when(kind == "allow", "block").otherwise("allow"), start + 1 + more + part(13) % 60))
    dated = listed.where(part(17) % 4 > 0).select("key", F.explode(F.slice(events, F.lit(1), 1 + part(21) % 3)).alias("e"))
    return dated.select("key", "e.action", "e.day")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` as captures against a dated list made from its hosts: page_id, day, host, n_active, entry, action, blocked.

    The table has no time of fetching, so page_id gives the day, a day of 2024; a null
    page_id has no day and is not blocked, nor is a null or malformed URL. Repeated rows
    are judged each; an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return judge(pages.select("page_id", "url", day.alias("day")), dated_list(pages)).drop("url")


def oracle_sql() -> str:
    """DuckDB SQL for `op5_url_filter`: an as-of join for every end of a host with every start of a path."""
    part = lambda at: f"CAST('0x' || substr(md5(key), {at}, 4) AS INTEGER)"
    kind = f"CASE WHEN {part(9)} % 3 = 0 THEN 'allow' ELSE 'block' END"
    other = f"CASE WHEN {part(9)} % 3 = 0 THEN 'block' ELSE 'allow' END"
    start, stop = f"{part(1)} % 200", f"{part(1)} % 200 + 1 + {part(5)} % 100"
    return f"""
WITH c AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
  rtrim(translate(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1), '{UPPER}', '{LOWER}'), '.') AS host,
  list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages),
s AS (SELECT *, string_split(host, '.') AS labels FROM c WHERE host <> ''),
w AS (SELECT host, parts[1] AS first, labels[-1] AS top, CASE WHEN len(labels) > 2 THEN array_to_string(labels[-2:], '.') END AS domain FROM s),
l AS (SELECT DISTINCT unnest([host, domain, top, host || '/' || first, domain || '/' || first]) AS key FROM w),
x AS (SELECT key, unnest([{{'n': 0, 'action': {kind}, 'day': {start}}}, {{'n': 1, 'action': 'remove', 'day': {stop}}}, {{'n': 2, 'action': {other}, 'day': {stop} + {part(13)} % 60}}]) AS e
      FROM l WHERE key IS NOT NULL AND {part(17)} % 4 > 0),
y AS (SELECT key, e.action AS action, DATE '2024-01-01' + CAST(e.day AS INTEGER) AS since FROM x WHERE e.n <= {part(21)} % 3),
e AS (SELECT key, since, min_by(action, CASE action WHEN 'allow' THEN 0 WHEN 'block' THEN 1 ELSE 2 END) AS action FROM y GROUP BY key, since),
h AS (SELECT r, day, parts, array_to_string(labels[i:], '.') AS suffix FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM s)),
k AS (SELECT DISTINCT r, day, CASE WHEN j = 0 THEN suffix ELSE suffix || '/' || array_to_string(parts[1:j], '/') END AS key
      FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS j FROM h)),
a AS (SELECT k.r, k.key, e.action FROM k ASOF JOIN e ON k.key = e.key AND k.day >= e.since),
t AS (SELECT r, count(*) AS n, max({{'n': length(key), 'allow': CASE action WHEN 'allow' THEN 1 ELSE 0 END, 'key': key, 'action': action}}) AS top
      FROM a WHERE action <> 'remove' GROUP BY r)
SELECT c.page_id, c.day, c.host, coalesce(t.n, 0) AS n_active, t.top.key AS entry, t.top.action AS action, coalesce(t.top.action = 'block', false) AS blocked
FROM c LEFT JOIN t USING (r)"""
