"""Geodesy and grids as SQL expressions (both dialects) and columns."""


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6371.0) -> str:
    """Great-circle distance: 2 R asin(sqrt(a))."""
    a = f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {radius} * asin(sqrt({a})))"


def in_box(lat1: str, lon1: str, lat2: str, lon2: str, km: float) -> str:
    """near(): a box of half-height r/111 degrees, widened by the cosine of the latitude; bounds included."""
    return f"(abs({lat2} - {lat1}) <= {km} / CAST(111 AS DOUBLE) AND abs({lon2} - {lon1}) <= {km} / (CAST(111 AS DOUBLE) * greatest(abs(cos(radians({lat1}))), CAST(0.01 AS DOUBLE))))"


def cell(x: str, degrees: int = 2) -> str:
    return f"CAST(floor({x} / {degrees}) AS BIGINT)"


def in_ring(lat: str, lon: str, ring: list[tuple[float, float]]) -> str:
    """Even-odd rule: an odd number of edges lies to the east; fewer than three corners hold nothing."""
    if len(ring) < 3:
        return "false"
    meets = [
        f"CASE WHEN ({y1} > {lat}) <> ({y2} > {lat}) AND {lon} < CAST({x2 - x1} AS DOUBLE) * ({lat} - {y1}) / {y2 - y1} + {x1} THEN 1 ELSE 0 END"
        for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True)
        if y1 != y2
    ]
    return f"(({' + '.join(meets) or '0'}) % 2 = 1)"


def in_polygon(lat: str, lon: str, rings: list[list[tuple[float, float]]]) -> str:
    """Inside the first ring and in none of the others, its holes."""
    return " AND ".join([in_ring(lat, lon, rings[0]), *(f"NOT {in_ring(lat, lon, r)}" for r in rings[1:])])
