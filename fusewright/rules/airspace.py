"""Flights and closed airspace: polygons with holes, circles of notices, and what they make of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: Degrees of the cells in which flights and zones meet.
CELL = 1.0


def ray_cast(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule over a ring of points (lat, lon), closed or not; fewer than three points hold nothing."""
    ahead = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, ahead, lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]))
    return (F.size(ring) >= 3) & (F.size(F.filter(crosses, lambda x: x)) % 2 == 1)


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """Inside the first ring and none of the others."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return ray_cast(lat, lon, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda r: ray_cast(lat, lon, r))


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 3440.065) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def in_zones(flights: DataFrame, zones: DataFrame) -> DataFrame:
    """(event_id, zone_id, kind): flights inside zones (zone_id, kind, rings: array of arrays of (lat, lon)).

    They meet in cells of a degree that the zone's box covers, so the join is by equality.
    """
    outer = F.get("rings", F.lit(0))
    edge = lambda f, k: f(F.transform(outer, lambda p: p[k]))
    boxes = zones.select("zone_id", "kind", "rings", *(edge(f, k).alias(f"{n}_{k}") for n, f in (("min", F.array_min), ("max", F.array_max)) for k in ("lat", "lon")))
    cells = boxes.withColumn("cy", F.explode(_cells(c("min_lat"), c("max_lat")))).withColumn("cx", F.explode(_cells(c("min_lon"), c("max_lon"))))
    at = flights.where("lat is not null and lon is not null").select("event_id", "lat", "lon", F.floor(c("lat") / CELL).alias("cy"), F.floor(c("lon") / CELL).alias("cx"))
    near = at.join(cells, ["cy", "cx"]).where(c("lat").between(c("min_lat"), c("max_lat")) & c("lon").between(c("min_lon"), c("max_lon")))
    return near.where(in_polygon(c("lat"), c("lon"), c("rings"))).select("event_id", "zone_id", "kind")


def in_notices(flights: DataFrame, notices: DataFrame) -> DataFrame:
    """(event_id, notice_id): flights within a notice's circle (lat, lon, radius_nm) while it holds: from start to end, a day without an end."""
    high = c("radius_nm") / 60.0
    wide = F.least(F.lit(180.0), high / F.greatest(F.cos(F.radians(F.least(F.abs(c("n_lat")) + high, F.lit(89.9)))), F.lit(0.01)))
    x = notices.select("notice_id", c("lat").alias("n_lat"), c("lon").alias("n_lon"), "radius_nm", "start", F.coalesce("end", c("start") + 86400).alias("end"))
    cells = x.withColumn("cy", F.explode(_cells(c("n_lat") - high, c("n_lat") + high))).withColumn("cx", F.explode(_cells(c("n_lon") - wide, c("n_lon") + wide)))
    at = flights.where("lat is not null and lon is not null").select("event_id", "t", "lat", "lon", F.floor(c("lat") / CELL).alias("cy"), F.floor(c("lon") / CELL).alias("cx"))
    near = at.join(cells, ["cy", "cx"]).where(c("t").between(c("start"), c("end")))
    return near.where(distance_nm(c("lat"), c("lon"), c("n_lat"), c("n_lon")) <= c("radius_nm")).select("event_id", "notice_id")


def annotated(flights: DataFrame, zones: DataFrame, notices: DataFrame) -> DataFrame:
    """Flights with the zones and notices they are in and tags for these; at least high severity in a prohibited zone, medium in a restricted one.

    Of several zones the strictest decides; a notice alone raises nothing.
    """
    z = in_zones(flights, zones).groupBy("event_id").agg(F.array_sort(F.collect_set("zone_id")).alias("zones"), F.max(F.when(c("kind") == "prohibited", 3).when(c("kind") == "restricted", 2).otherwise(0)).alias("by_zone"))
    n = in_notices(flights, notices).groupBy("event_id").agg(F.array_sort(F.collect_set("notice_id")).alias("notices"))
    none = F.array().cast("array<string>")
    x = flights.join(z, "event_id", "left").join(n, "event_id", "left").withColumns({"zones": F.coalesce("zones", none), "notices": F.coalesce("notices", none)})
    tags = F.array_compact(F.array(F.when(c("by_zone") == 3, "airspace-prohibited"), F.when(c("by_zone") == 2, "airspace-restricted"), F.when(F.size("notices") > 0, "notam-active")))
    return x.withColumns({"tags": F.array_union("tags", tags), "severity_rank": F.greatest("severity_rank", F.coalesce("by_zone", F.lit(0)))}).drop("by_zone")


#: Countries whose restricted and danger areas are watched.
WATCHED = "IL PS IR IQ SY LB YE SA AE QA BH OM KW TR UA RU BY KP CN TW MM LY SD SO ET GB FR DE PL GR RO BG FI NO SE LT LV EE".split()


def zones_of(rows: DataFrame) -> DataFrame:
    """(zone_id, name, kind, country, rings) of GeoJSON collections in a column `body`, for in_zones().

    Prohibited areas of any country, restricted and danger areas of those watched; polygons, and multipolygons with the
    rings of all parts after the first one's, as the index that this follows has them. Points are (longitude, latitude).
    """
    features = F.from_json(F.get_json_object("body", "$.features"), "array<string>")
    x = rows.select(F.explode(features).alias("f"))
    of = lambda p: F.get_json_object("f", p)
    ring = "array<array<array<double>>>"
    single = F.from_json(of("$.geometry.coordinates"), ring)
    several = F.flatten(F.from_json(of("$.geometry.coordinates"), f"array<{ring}>"))
    shape = of("$.geometry.type")
    rings = F.when(shape == "Polygon", single).when(shape == "MultiPolygon", several)
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon"))))
    kind = F.lower(of("$.properties.type"))
    kept = (kind == "prohibited") | (kind.isin("restricted", "danger") & of("$.properties.country").isin(WATCHED))
    x = x.where(kept).select(of("$.properties.designator").alias("zone_id"), of("$.properties.name").alias("name"), kind.alias("kind"), of("$.properties.country").alias("country"), points.alias("rings"))
    return x.where(F.size("rings") > 0)
