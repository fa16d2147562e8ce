"""Queries again by the ways that hold on long tracks and large groups, cut finely enough to run on small tables: the same SQL must hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, field, forecast, spectra, tracks, verify
from tidemark.plans import views
from tidemark.plans.registry import ORACLE_SQL, fq

#: Fixes in a range, so few that every track of the test tables is cut.
FEW = 12


def again(name: str, of: str) -> Callable:
    """Register a function of the fixes whose rows are those of another query."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable:
        fq(name)(f)
        ORACLE_SQL[name] = ORACLE_SQL[of]
        return f

    return keep


again("c8_legs_in_ranges", "c8_c9_c10_legs")(lambda f: tracks.legs(f, most_rows=FEW).select("buoy_id", "fix_id", "dx_deg", "dy_deg", "x_km", "y_km", "xy_km", "dt_s", "u", "v", "speed"))
again("c22_rolling_in_ranges", "c22_rolling_speed")(lambda f: tracks.rolling_mean(tracks.legs(f), "speed", "smooth", most_rows=FEW).select("buoy_id", "fix_id", "smooth"))
again("f2_trailing_in_ranges", "f2_trailing_velocity")(lambda f: forecast.trailing_velocity(tracks.legs(f, most_rows=FEW), 3, most_rows=FEW).select("buoy_id", "fix_id", "u_mean", "v_mean"))
again("i1_split_in_ranges", "i1_split_at_gaps")(lambda f: spectra.split_at_gaps(f, 72, most_rows=FEW).select("buoy_id", "fix_id", "segment"))
again("g2_asof_in_buckets", "g2_nearest_asof")(lambda f: asof.nearest(f, views.observed(f), ["buoy_id"], "ts", "seen_ts", ["reading"], 60, bucket_s=3600).select("buoy_id", "fix_id", F.col("reading")))

# -- quantiles by selection, with so few values at last that every group is parted
again("g12_by_selection", "g10_g11_g12_by_lead")(lambda f: verify.by_lead(verify.position_error(views.runs(f)), few=20).select("bin", F.coalesce("n", F.lit(0)).alias("n"), "rmse", "q30", "q90"))
again("b13_scale_by_selection", "b13_zonal_scale")(lambda f: field.zonal_scale(views.sampled_field(f), few=20))
