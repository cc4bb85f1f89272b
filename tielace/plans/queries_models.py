"""Queries over local models, structural transforms, event windows and products."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tielace.functions import expr
from tielace.operators import localmodel
from tielace.streaming import stages

from . import sinks
from .registry import query
from .views import POINTS, SIDE, points, table


def with_field(spark, sf):
    """Points with a made residual field: a quadratic one plus a little that hangs on sigma."""
    p = localmodel.normalised(points(spark, sf), SIDE, SIDE)
    return p.withColumns({"dx": F.col("u") * 2 - F.col("u") * F.col("v") + F.col("sigma") * 0.1, "dy": F.col("v") * F.col("v") + F.col("sigma") * 0.1})


_FIELD = f"{POINTS}, f AS (SELECT *, (2 * x / 512 - 1) * 2 - (2 * x / 512 - 1) * (2 * y / 512 - 1) + sigma * 0.1 AS dx, (2 * y / 512 - 1) * (2 * y / 512 - 1) + sigma * 0.1 AS dy FROM points)"


def _eliminated(ridge: float = 1e-3) -> str:
    """The ridge normal equations of each track, solved by Gauss-Jordan steps, one a table."""
    terms, right = [f"({t})" for t in localmodel.TERMS], ["dx", "dy"]
    cells = [(i, j) for i in range(6) for j in range(8)]
    first = ", ".join(f"sum({terms[i]} * {terms[j] if j < 6 else right[j - 6]}){f' + {ridge!r} * count(*)' if i == j and i else ''} AS a{i}{j}" for i, j in cells)
    steps = f"{_FIELD}, g AS (SELECT track, 2 * x / 512 - 1 AS u, 2 * y / 512 - 1 AS v, dx, dy FROM f), s0 AS (SELECT track, count(*) AS n, {first} FROM g GROUP BY track)"
    for k in range(6):
        made = ", ".join((f"a{k}{j} / a{k}{k}" if i == k else f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k}") + f" AS a{i}{j}" for i, j in cells)
        steps += f", s{k + 1} AS (SELECT track, n, {made} FROM s{k})"
    lists = ", ".join(f"[{', '.join(f'round(a{i}{j}, 6)' for i in range(6))}] AS {name}" for j, name in ((6, "cx"), (7, "cy")))
    return f"WITH {steps} SELECT track, n, {lists} FROM s6"


@query(_eliminated())
def quadratic_field(spark, sf):
    """Ridge quadratic by track."""
    return localmodel.quadratic(with_field(spark, sf), "track").select("track", "n", *[F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("cx", "cy")])


@query()
def spline_choice(spark, sf):
    """Smoothing by leave-one-out error over all points, each predicted from its nearest others, by track."""
    return localmodel.spline_choice(with_field(spark, sf), "track").select("track", "smoothing", "n", F.round("loocv", 6).alias("loocv"))


@query(f"""WITH {_FIELD} SELECT CAST(floor(y / 4) AS BIGINT) AS row, count(*) AS n, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy FROM f GROUP BY 1""")
def row_jitter(spark, sf):
    return localmodel.row_jitter(with_field(spark, sf), 4.0).select("row", "n", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


def wobbling(spark, sf):
    """Each track's points with residuals that follow a wave along the rows, of another length for each kind of track."""
    p = with_field(spark, sf).withColumn("row", F.floor(F.col("y") / 4).cast("double"))
    wave = F.sin(F.col("row") * (2 * math.pi / 32))
    return p.select(F.col("track").alias("group"), "tid", "row", (F.col("dx") * 0.01 + wave).alias("dx"), (F.col("dy") * 0.01).alias("dy"))


@query()
def jitter_spline(spark, sf):
    """Amplitude and period of each track's jitter by a spline along the rows; tests hold it against one least-squares solution and a known wave."""
    from tielace.operators import jitter

    shown = [F.round(c, 5).alias(c) for c in ("amplitude", "period", "rms_before", "rms_after")]
    return jitter.fit(wobbling(spark, sf)).select(F.col("group").alias("track"), "n_knots", "n_rows", *shown)


@query()
def jitter_removed(spark, sf):
    """What is left of each point's residual when the spline's value at its row is taken away."""
    from tielace.operators import jitter

    own = wobbling(spark, sf)
    left = jitter.at_rows(own, jitter.fit(own))
    return left.select("tid", F.round(F.col("dx") - F.col("jitter_x"), 5).alias("dx"), F.round(F.col("dy") - F.col("jitter_y"), 5).alias("dy"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf):
    """The streams' tumbling window on the table as a batch."""
    w = stages.tumbling(table(spark, sf, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    s = stages.sessions(table(spark, sf, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"""WITH {POINTS} SELECT tid AS id, round(y, 4) AS src_line, round(x, 4) AS src_sample, round(y * 0.5 + 3, 4) AS ref_line, round(x * 0.5 - 7, 4) AS ref_sample,
  round(x / 512 * 360 - 180, 6) AS src_lon, round(y / 512 * 180 - 90, 6) AS src_lat, round(CASE WHEN conf > 0.3 THEN x / 512 * 360 - 180 END, 6) AS ref_lon, round(CASE WHEN conf > 0.3 THEN y / 512 * 180 - 90 END, 6) AS ref_lat,
  round(conf, 4) AS conf, track, round(sigma, 6) AS sigma_x, round(CASE WHEN sigma > 0.1 THEN sigma * 2 END, 6) AS sigma_y, round(sigma * sigma / 10, 8) AS sigma_xy, round(sigma - 0.5, 4) AS residual_x, round(0.5 - conf, 4) AS residual_y,
  CAST(conf > 0.5 AS INTEGER) AS inlier, CAST(track = 'error' AS INTEGER) AS reseeded, CAST(least(greatest(floor(y * 8 / 512.0), 0), 7) * 8 + least(greatest(floor(x * 8 / 512.0), 0), 7) AS INTEGER) AS cell_id FROM points""")
def tiepoint_rows(spark, sf):
    """All columns of the tie-point table; not a number counts as unknown."""
    x, y, conf, sigma = (F.col(c) for c in ("x", "y", "conf", "sigma"))
    lon, lat = x / 512 * 360 - 180, y / 512 * 180 - 90
    unknown = F.lit(float("nan"))
    p = points(spark, sf).select(
        F.col("tid").alias("id"), y.alias("src_line"), x.alias("src_sample"), (y * 0.5 + 3).alias("ref_line"), (x * 0.5 - 7).alias("ref_sample"), lon.alias("src_lon"), lat.alias("src_lat"),
        F.when(conf > 0.3, lon).otherwise(unknown).alias("ref_lon"), F.when(conf > 0.3, lat).otherwise(unknown).alias("ref_lat"), "conf", "track", sigma.alias("sigma_x"), F.when(sigma > 0.1, sigma * 2).otherwise(unknown).alias("sigma_y"),
        (sigma * sigma / 10).alias("sigma_xy"), (sigma - 0.5).alias("residual_x"), (0.5 - conf).alias("residual_y"), (conf > 0.5).alias("inlier"), (F.col("track") == "error").alias("reseeded"), expr.cell_id(x, y, SIDE, SIDE, 8, 8).alias("cell_id"),
    )
    return sinks.tiepoint_rows(p)
