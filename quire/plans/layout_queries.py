"""Queries over boxes, jobs and conversations, and their SQL twins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import blocks as B
from quire.operators import geometry_joins as J
from quire.operators import layout as L
from quire.operators import quality as Q
from quire.operators import sequence as S
from quire.operators import stats as A
from quire.plans.registry import query
from quire.sources.views import V_RECT_SQL, table, v_block, v_job, v_rect
from quire.streaming import jobs as ST

_HIT = "a.x0 < b.x1 - {p} AND b.x0 < a.x1 - {p} AND a.top < b.bottom - {p} AND b.top < a.bottom - {p}"
_INSIDE = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)) / ((a.x1 - a.x0) * (a.bottom - a.top)) >= 0.7"


@query(
    "body_size_mode",
    f"""WITH {V_RECT_SQL}, w AS (SELECT page, round_even((x1 - x0) / 4, 0) AS v, sum(x0) AS w FROM v_rect GROUP BY 1, 2)
    SELECT page, CAST(arg_min(v, (-w, v)) AS DOUBLE) AS body_size FROM (SELECT page, v, w, row_number() OVER (PARTITION BY page ORDER BY w DESC, v) AS r FROM w) WHERE r = 1 GROUP BY page""".replace("CAST(arg_min(v, (-w, v)) AS DOUBLE)", "CAST(min(v) AS DOUBLE)"),
)
def body_size_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantised width with the greatest weight on each page."""
    return A.weighted_mode(v_rect(spark, sf_dir), ["page"], F.bround((F.col("x1") - F.col("x0")) / 4), F.col("x0"))


@query("overlap_pairs", f"WITH {V_RECT_SQL} SELECT a.page, a.rid AS rid_a, b.rid AS rid_b FROM v_rect a JOIN v_rect b ON a.page = b.page AND a.rid < b.rid AND {_HIT.format(p='0.5')}")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, J09."""
    return J.overlap_pairs(v_rect(spark, sf_dir))


@query("overlap_pages", f"WITH {V_RECT_SQL} SELECT a.page AS doc_id, 'editor' AS role, 'line_overlap' AS kind, CAST(count(*) AS VARCHAR) AS detail, 'shrink' AS param FROM v_rect a JOIN v_rect b ON a.page = b.page AND a.rid < b.rid AND {_HIT.format(p='0.5')} GROUP BY a.page")
def overlap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q07."""
    return Q.line_overlap(v_rect(spark, sf_dir))


@query("figure_overlaps", f"WITH {V_RECT_SQL} SELECT a.page, a.rid AS rid_a, b.rid AS rid_b FROM v_rect a JOIN v_rect b ON a.page = b.page AND a.kind <> 'R' AND b.kind = 'R' AND {_HIT.format(p='-2.0')}")
def figure_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines stand for figures."""
    r = v_rect(spark, sf_dir)
    return J.overlap_between(r.filter("kind <> 'R'"), r.filter("kind = 'R'"), -2.0)


@query("rule_crossings", f"WITH {V_RECT_SQL}, rules AS (SELECT page, rid, x0, x1, (top + bottom) / 2 - 0.5 AS top, (top + bottom) / 2 + 0.5 AS bottom FROM v_rect WHERE n = 1) SELECT a.page AS doc_id, 'producer' AS role, 'rule_overlap' AS kind, CAST(count(*) AS VARCHAR) AS detail, 'shrink' AS param FROM v_rect a JOIN rules b ON a.page = b.page AND a.n <> 1 AND {_HIT.format(p='0.0')} GROUP BY a.page")
def rule_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, Q09."""
    r = v_rect(spark, sf_dir)
    return Q.rule_overlap(r.filter("n <> 1"), r.filter("n = 1"))


@query("containment_counts", f"WITH {V_RECT_SQL} SELECT a.page, count(*) AS n FROM v_rect a JOIN v_rect b ON a.page = b.page AND a.rid <> b.rid AND {_INSIDE} GROUP BY a.page")
def containment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, J16."""
    r = v_rect(spark, sf_dir)
    return J.contained(r, r).groupBy("page").agg(F.count("*").alias("n"))


@query("covered_anti", f"WITH {V_RECT_SQL} SELECT page, count(*) AS n FROM v_rect a WHERE NOT EXISTS (SELECT 1 FROM v_rect b WHERE a.page = b.page AND a.rid <> b.rid AND {_INSIDE}) GROUP BY page")
def covered_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, J28, P29."""
    r = v_rect(spark, sf_dir)
    return J.uncovered(r, r).groupBy("page").agg(F.count("*").alias("n"))


@query(
    "nearest_below",
    f"""WITH {V_RECT_SQL}, p AS (SELECT a.page, a.rid, b.rid AS below, b.top - a.bottom AS gap, row_number() OVER (PARTITION BY a.page, a.rid ORDER BY b.top - a.bottom, b.rid) AS r
    FROM v_rect a JOIN v_rect b ON a.page = b.page AND b.top >= a.bottom AND least(a.x1, b.x1) > greatest(a.x0, b.x0)) SELECT page, rid, below, round(gap, 6) AS gap FROM p WHERE r = 1""",
)
def nearest_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18."""
    return J.nearest_below(v_rect(spark, sf_dir)).withColumn("gap", F.round("gap", 6))


@query("row_mates", f"""WITH {V_RECT_SQL}, p AS (SELECT a.page, a.rid, max(CASE WHEN b.kind = 'N' THEN 2 WHEN length(a.rid) <= 32 AND length(b.rid) <= 32 AND greatest(b.x0 - a.x1, a.x0 - b.x1) >= 12 THEN 1 ELSE 0 END) AS p
    FROM v_rect a JOIN v_rect b ON a.page = b.page AND a.rid <> b.rid AND greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)) >= 0.5 * least(a.bottom - a.top, b.bottom - b.top) AND greatest(b.x0 - a.x1, a.x0 - b.x1) >= 0 GROUP BY a.page, a.rid)
    SELECT page, rid, CASE WHEN p = 2 THEN 'cell' ELSE 'list' END AS record FROM p WHERE p > 0""")  # fmt: skip
def row_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08."""
    return J.row_mates(v_rect(spark, sf_dir))


@query(
    "merged_bands",
    f"""WITH {V_RECT_SQL}, m AS (SELECT *, max(bottom) OVER (PARTITION BY page ORDER BY top, bottom, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_rect),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR top > reach THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top, bottom, rid ROWS UNBOUNDED PRECEDING) AS band FROM m)
    SELECT page, CAST(band AS BIGINT) AS band, min(top) + 0.0 AS top, max(bottom) + 0.0 AS bottom, count(*) AS n FROM g GROUP BY page, band""",
)
def merged_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    return J.merged_bands(v_rect(spark, sf_dir)).withColumns({"top": F.col("top") + 0.0, "bottom": F.col("bottom") + 0.0})


@query(
    "reading_order",
    f"""WITH {V_RECT_SQL}, b AS (SELECT a.page, a.rid, a.col, a.top, (SELECT count(*) FROM v_rect f WHERE f.page = a.page AND f.col = 0 AND (f.top + f.bottom) / 2 < (a.top + a.bottom) / 2) AS band FROM v_rect a)
    SELECT page, rid, CAST(row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN col = 0 THEN 3 ELSE col END, top, rid) - 1 AS INTEGER) AS ord FROM b""",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W04."""
    return B.reading_order(v_rect(spark, sf_dir), ["page"]).select("page", "rid", F.col("ord").cast("int").alias("ord"))


@query(
    "x_histogram_gap",
    f"""WITH {V_RECT_SQL}, h AS (SELECT DISTINCT page, unnest(range(CAST(greatest(0, floor(x0 / 0.625)) AS INTEGER), CAST(least(119, floor(x1 / 0.625)) AS INTEGER) + 1)) AS bucket FROM v_rect WHERE x1 >= 0 AND x0 < 75),
    e AS (SELECT p.page, c.b AS bucket FROM (SELECT DISTINCT page FROM v_rect) p, (SELECT unnest(range(36, 85)) AS b) c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page = p.page AND h.bucket = c.b)),
    r AS (SELECT page, min(bucket) AS first, count(*) AS width FROM (SELECT *, bucket - row_number() OVER (PARTITION BY page ORDER BY bucket) AS run FROM e) GROUP BY page, run HAVING count(*) >= 2)
    SELECT page, CAST(first AS BIGINT) AS first, width FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY width DESC, first) AS k FROM r) WHERE k = 1""",
)
def x_histogram_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, T04."""
    return A.widest_gap(v_rect(spark, sf_dir), 0.0, 75.0)


@query(
    "column_vote",
    f"""WITH {V_RECT_SQL}, c AS (SELECT col AS page, count(*) AS total, count(*) FILTER (x1 <= 32) AS "left", count(*) FILTER (x0 >= 32) AS "right", count(*) FILTER (x1 > 32 AND x0 < 32) AS crossing FROM v_rect GROUP BY col)
    SELECT *, CAST(CASE WHEN total >= 8 AND "left" >= 0.25 * total AND "right" >= 0.25 * total AND crossing <= 0.25 * total THEN 2 ELSE 1 END AS INTEGER) AS columns FROM c""",
)
def column_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return A.column_vote(v_rect(spark, sf_dir).withColumn("page", F.col("col")), 32.0)


@query("left_edges", f"WITH {V_RECT_SQL} SELECT n AS page, CAST(round_even(x0, 0) AS DOUBLE) AS edge, count(*) AS n FROM v_rect GROUP BY 1, 2 HAVING count(*) >= 3")
def left_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return A.left_edges(v_rect(spark, sf_dir).withColumn("page", F.col("n")))


@query(
    "box_stats",
    f"""WITH {V_RECT_SQL} SELECT page, min(x0) + 0.0 AS x0, min(top) + 0.0 AS top, max(x1) + 0.0 AS x1, max(bottom) + 0.0 AS bottom, round(median(x1 - x0), 6) AS mid_width, round(list_sort(list(x0))[CAST(count(*) // 2 AS BIGINT) + 1], 6) AS upper, avg(CASE WHEN kind = 'N' THEN 1 ELSE 0 END) > 0.5 AS mostly_n FROM v_rect GROUP BY page""",
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02, A03, A04, A05."""
    return v_rect(spark, sf_dir).groupBy("page").agg(
        (F.min("x0") + 0.0).alias("x0"), (F.min("top") + 0.0).alias("top"), (F.max("x1") + 0.0).alias("x1"), (F.max("bottom") + 0.0).alias("bottom"),
        F.round(F.percentile(F.col("x1") - F.col("x0"), F.lit(0.5)), 6).alias("mid_width"), F.round(A.upper_median(F.col("x0")), 6).alias("upper"), A.majority(F.col("kind") == "N").alias("mostly_n"),
    )


@query("modal_kind", f"""WITH {V_RECT_SQL}, c AS (SELECT page, kind, count(*) AS n, min(rid) AS first FROM v_rect GROUP BY page, kind) SELECT page, kind FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def modal_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06."""
    return A.modal(v_rect(spark, sf_dir), ["page"], "kind", "rid")


@query("zone_rows", f"""WITH {V_RECT_SQL}, r AS (SELECT page, round_even(top / 6.0, 0) AS row, count(*) AS n FROM v_rect GROUP BY 1, 2 HAVING count(*) >= 2) SELECT page, count(*) AS n_rows FROM r GROUP BY page HAVING count(*) >= 2""")
def zone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return A.zone_rows(v_rect(spark, sf_dir))


@query(
    "size_steps",
    f"""WITH {V_RECT_SQL} SELECT rid, page, CAST(round_even(least(greatest(x0 * 0.5, 4), 42) * 4, 0) / 4 AS DOUBLE) AS quarter, CAST(CASE WHEN x0 < 26 - 3 AND x1 > 26 + 3 THEN 0 WHEN (x0 + x1) / 2 < 26 THEN 1 ELSE 2 END AS INTEGER) AS lane FROM v_rect""",
)
def size_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, P37."""
    r = v_rect(spark, sf_dir)
    return r.select("rid", "page", G.quarter_size(F.col("x0"), 0.5).alias("quarter"), G.column_of(F.col("x0"), F.col("x1"), F.lit(26.0), F.lit(1.0), F.lit(51.0)).alias("lane"))


@query(
    "lane_bands",
    f"""WITH {V_RECT_SQL}, l AS (SELECT page, rid, col AS lane, lag(col) OVER (PARTITION BY page ORDER BY rid) AS prev FROM v_rect)
    SELECT page, rid, CAST(sum(CASE WHEN prev IS NULL OR lane = 0 OR prev = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY rid ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS band FROM l""",
)
def lane_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17."""
    r = v_rect(spark, sf_dir).select("page", "rid", F.col("col").alias("lane"))
    return S.lane_bands(r, ["page"], "rid").select("page", "rid", "band")


@query("placed_lines")
def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of each document placed in a box of its own, forty to a page; no unit is lost, a line without text draws nothing."""
    top = (F.col("ord") % 40 * 20).cast("double")
    units = v_block(spark, sf_dir).select("doc_id", F.floor(F.col("ord") / 40).cast("int").alias("page"), F.col("ord").alias("uid"), F.lit(40.0).alias("x0"), F.lit(400.0).alias("x1"), top.alias("top"), (top + 12).alias("bottom"), F.lit(10.0).alias("size"), F.col("text").alias("target"))
    boxes = L.region_boxes(units, units.limit(0))
    placed = L.place_units(boxes).groupBy("doc_id", "uid").agg(F.count("*").alias("n_lines"), F.sum("nch").alias("drawn"), F.min("size").alias("size"))
    none = F.lit(0).cast("bigint")
    return units.select("doc_id", "uid").join(placed, ["doc_id", "uid"], "left").select("doc_id", "uid", F.coalesce("n_lines", none).alias("n_lines"), F.coalesce("drawn", none).alias("drawn"), "size")


@query("reflowed_pages")
def reflowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation poured over two columns."""
    conv = table(spark, sf_dir, "conversations")
    units = conv.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page"), F.col("turn").alias("uid"), F.col("turn").alias("ord"), F.lit(10.0).alias("size"), F.col("text").alias("target"))
    flow = L.reflow(units, columns=2)
    return flow.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("factor").alias("factor"), F.max("col").alias("columns"), F.bool_or("overflow").alias("overflow"))


@query(
    "lane_ranges",
    f"""WITH {V_RECT_SQL}, r AS (SELECT page % 100 AS page, col, x0, x1, x1 - x0 AS w, max(x1 - x0) OVER (PARTITION BY page % 100, col) AS most FROM v_rect),
    l AS (SELECT page, col, min(x0) AS x0, max(x1) AS x1 FROM r WHERE w >= 0.45 * most GROUP BY page, col),
    m AS (SELECT *, (max(CASE WHEN col = 1 THEN x1 END) OVER (PARTITION BY page) + min(CASE WHEN col = 2 THEN x0 END) OVER (PARTITION BY page)) / 2 AS mid FROM l)
    SELECT 0 AS doc_id, page, col, CASE WHEN col = 2 AND mid IS NOT NULL THEN greatest(x0, mid + 3) ELSE x0 END AS x0, CASE WHEN col = 1 AND mid IS NOT NULL THEN least(x1, mid - 3) ELSE x1 END AS x1 FROM m""",
)
def lane_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L01."""
    r = v_rect(spark, sf_dir).withColumn("doc_id", F.lit(0)).withColumn("page", F.col("page") % 100)
    return L.lanes(r)


@query("merged_boxes")
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page within 12 points merge."""
    return S.merge_boxes(v_rect(spark, sf_dir).withColumn("top", F.col("top").cast("double")), ["page"]).groupBy("page").agg(F.count("*").alias("boxes"), F.sum("n").alias("n"))


@query(
    "defect_summary",
    f"""WITH {V_RECT_SQL}, o AS (SELECT a.page, count(*) AS n FROM v_rect a JOIN v_rect b ON a.page = b.page AND a.rid < b.rid AND {_HIT.format(p='0.5')} GROUP BY a.page),
    f AS (SELECT a.page, count(*) AS n FROM v_rect a JOIN v_rect b ON a.page = b.page AND a.kind <> 'R' AND b.kind = 'R' AND {_HIT.format(p='-2.0')} GROUP BY a.page),
    d AS (SELECT page AS doc_id, 'editor' AS role, 'line_overlap' AS kind, CAST(n AS VARCHAR) AS detail FROM o UNION ALL SELECT page, 'editor', 'figure_overlap', CAST(n AS VARCHAR) FROM f)
    SELECT role, kind, count(*) AS pages, min(detail) AS first FROM d GROUP BY role, kind""",
)
def defect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q07, Q08, Q15."""
    r = v_rect(spark, sf_dir)
    both = Q.line_overlap(r).unionByName(Q.figure_overlap(r.filter("kind <> 'R'"), r.filter("kind = 'R'")))
    return both.groupBy("role", "kind").agg(F.count("*").alias("pages"), F.min("detail").alias("first"))


@query("recent_jobs", "SELECT event_id AS id, event_type AS status, ts AS created, user_id AS client, value, event_type = 'purchase' AS available FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty; the limit is the feature."""
    return ST.recent_jobs(v_job(spark, sf_dir))


@query("latest_state", "SELECT client, created, id, status FROM (SELECT user_id AS client, ts AS created, event_id AS id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST04."""
    return ST.latest_state(v_job(spark, sf_dir))


@query("ttl_sweep", "SELECT event_id AS id, event_type AS status, ts AS created FROM events WHERE event_type NOT IN ('queued', 'running') AND ts < (SELECT max(ts) FROM events) - INTERVAL 604800 SECOND")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST02: expired as of the newest event."""
    jobs = v_job(spark, sf_dir)
    now = jobs.agg(F.max("created")).first()[0] or datetime.datetime(1970, 1, 1)
    return ST.expired(jobs, now).select("id", "status", "created")


@query("job_totals", "SELECT user_id AS client, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'purchase') < 0.9 * count(*) AS low FROM events GROUP BY user_id")
def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return ST.job_totals(v_job(spark, sf_dir))


@query("merged_jobs", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'remote' ELSE event_type END AS status FROM events")
def merged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the events stand for local jobs, all of them for remote ones; local wins."""
    jobs = v_job(spark, sf_dir).select("id", "status")
    return ST.merged_jobs(jobs.filter("id % 3 <> 0"), jobs.withColumn("status", F.lit("remote")))


@query(
    "rate_windows",
    "SELECT user_id AS client, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS seen FROM events",
)
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain sliding count beside W16: events of a client in the 24 hours before each."""
    us = F.unix_micros(F.col("created").cast("timestamp"))
    w = Window.partitionBy("client").orderBy("us").rangeBetween(-24 * 3600 * 1_000_000, 0)
    return v_job(spark, sf_dir).withColumn("us", us).select("client", "id", F.count("*").over(w).alias("seen"))


@query(
    "rate_limited",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT user_id, event_id, k, [ts] AS log, TRUE AS ok FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN len(list_filter(s.log, lambda x: x >= e.ts - INTERVAL 24 HOUR)) < 3 THEN list_append(list_filter(s.log, lambda x: x >= e.ts - INTERVAL 24 HOUR), e.ts) ELSE list_filter(s.log, lambda x: x >= e.ts - INTERVAL 24 HOUR) END,
        len(list_filter(s.log, lambda x: x >= e.ts - INTERVAL 24 HOUR)) < 3 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT user_id AS client, event_id AS id, ok AS accepted FROM s""",
)
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests in 24 hours."""
    return S.rate_limit(v_job(spark, sf_dir), "client", "created", "id", 3, 24 * 3600)


@query("hourly_states", "SELECT date_trunc('hour', ts) AS hour, event_type AS status, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def hourly_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed stream: jobs an hour by state."""
    return v_job(spark, sf_dir).groupBy(F.date_trunc("hour", "created").cast("timestamp_ntz").alias("hour"), "status").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
