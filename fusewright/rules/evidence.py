"""Evidence for a trigger: events of a kind in the time up to it, near it, in its region or in its country.

Range joins meet in cells: of time as long as the window, of latitude as high as the radius, and of longitude as
wide as the radius reaches in that band. A trigger visits its neighbours, so the join is by equality and the box
only decides within cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KM_A_DEGREE = 111.0


def band_of(lat: Column, km: float) -> Column:
    return F.floor(lat / (km / KM_A_DEGREE)).cast("long")


def lon_cell(lon: Column, band: Column, km: float) -> Column:
    """Number of the cell in a band; cells are as wide as the radius reaches at the furthest latitude of it and its neighbours."""
    step = km / KM_A_DEGREE
    far = F.least(F.greatest(F.abs((band - 1) * step), F.abs((band + 2) * step)), F.lit(90.0))
    return F.floor(lon / (km / (KM_A_DEGREE * F.greatest(F.cos(F.radians(far)), F.lit(0.01))))).cast("long")


def in_box(lat: Column, lon: Column, other_lat: Column, other_lon: Column, km: float) -> Column:
    """Whether a point lies in the box around another, its borders included; longitudes don't wrap."""
    high = km / KM_A_DEGREE
    wide = F.lit(km) / (KM_A_DEGREE * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.01)))
    return other_lat.between(lat - high, lat + high) & other_lon.between(lon - wide, lon + wide)


def near(triggers: DataFrame, events: DataFrame, km: float, seconds: int, after: int = 0) -> DataFrame:
    """(trigger_id, event_id): events in the box around a trigger, not over `after` seconds after it and not over `seconds` before; itself too if it is one.

    Both have event_id, t, lat and lon; rows without coordinates have no place.
    """
    c = F.col
    cells = events.where("lat is not null and lon is not null").select("event_id", c("t").alias("e_t"), c("lat").alias("e_lat"), c("lon").alias("e_lon"), band_of(c("lat"), km).alias("band"), F.floor(c("t") / seconds).alias("time"))
    cells = cells.withColumn("cell", lon_cell(c("e_lon"), c("band"), km))
    around = triggers.where("lat is not null and lon is not null").select(
        c("event_id").alias("trigger_id"), "t", "lat", "lon", F.explode(F.array(*(band_of(c("lat"), km) + i for i in (-1, 0, 1)))).alias("band")
    )
    around = around.select("*", F.explode(F.array(*(lon_cell(c("lon"), c("band"), km) + i for i in (-1, 0, 1)))).alias("cell"))
    around = around.select("*", F.explode(F.sequence(F.floor((c("t") - seconds) / seconds), F.floor((c("t") + after) / seconds))).alias("time"))
    found = around.join(cells, ["band", "cell", "time"]).where(c("e_t").between(c("t") - seconds, c("t") + after))
    return found.where(in_box(c("lat"), c("lon"), c("e_lat"), c("e_lon"), km)).select("trigger_id", "event_id")


def alike(triggers: DataFrame, events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(trigger_id, event_id): events with the trigger's value of a column, not after it and not over `seconds` before."""
    c = F.col
    cells = events.where(c(key).isNotNull()).select("event_id", c("t").alias("e_t"), key, F.floor(c("t") / seconds).alias("time"))
    around = triggers.where(c(key).isNotNull()).select(c("event_id").alias("trigger_id"), "t", key, F.explode(F.array(*(F.floor(c("t") / seconds) - i for i in (0, 1)))).alias("time"))
    return around.join(cells, [key, "time"]).where(c("e_t").between(c("t") - seconds, c("t"))).select("trigger_id", "event_id")


def counted(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.groupBy("trigger_id").agg(F.count_distinct("event_id").alias(name))


def running_counts(events: DataFrame, key: str, kinds: dict[str, Column], seconds: int) -> DataFrame:
    """Each event with how many of each kind its key has in the `seconds` up to it, itself too.

    Counted by second and key first, then by prefix sums within cells of time that overlap by one window, so a key
    with a third of all events is spread over as many tasks as it has cells.
    """
    c = F.col
    per = events.where(c(key).isNotNull()).groupBy(key, "t").agg(*(F.sum(k.cast("long")).alias(n) for n, k in kinds.items()))
    length = 64 * seconds
    cell = F.floor(c("t") / length)
    # The last window of a cell also serves the next one.
    both = per.select("*", F.explode(F.when(c("t") % length >= length - seconds, F.array(cell, cell + 1)).otherwise(F.array(cell))).alias("cell"))
    over = W.partitionBy(key, "cell").orderBy("t").rangeBetween(-seconds, 0)
    out = both.select(key, "t", "cell", *(F.sum(n).over(over).alias(n) for n in kinds)).where(F.floor(c("t") / length) == c("cell")).drop("cell")
    return events.join(out, [key, "t"])
