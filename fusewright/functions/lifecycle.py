"""How a situation lives: its severity, certainty, patience and phase, from what is counted of its events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = ("info", "low", "medium", "high", "critical")
#: Half-life and grace in hours by which a fit fades, by event type.
FADING = {
    "conflict_event": (4.0, 1.0),
    "thermal_anomaly": (6.0, 1.5),
    "seismic_event": (8.0, 2.0),
    "gps_interference": (8.0, 2.0),
    "news_article": (24.0, 6.0),
    "geo_news": (24.0, 6.0),
    "internet_outage": (24.0, 6.0),
    "bgp_anomaly": (24.0, 6.0),
    "nuclear_event": (48.0, 12.0),
}
FADING_ELSE = (12.0, 3.0)
#: Kilometres within which events of a type belong together.
RADIUS = {"conflict_event": 50.0, "thermal_anomaly": 25.0, "gps_interference": 300.0, "seismic_event": 100.0, "news_article": 100.0, "geo_news": 100.0}
RADIUS_ELSE = 150.0


def severity_rank(severity: Column) -> Column:
    """0 for info and what is none, to 4 for critical; case doesn't count."""
    out = F.when(F.lower(severity) == RANKS[4], 4)
    for i in (3, 2, 1):
        out = out.when(F.lower(severity) == RANKS[i], i)
    return out.otherwise(0)


def severity_label(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANKS)), F.greatest(F.least(rank, F.lit(4)), F.lit(0)).cast("int") + 1)


def half_round(x: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def ewma_decay(seconds: Column, half_life: float) -> Column:
    return F.exp(F.lit(-0.693) * seconds / F.lit(half_life))


def decayed_peak(peak: Column, minutes: Column, half_life: float = 30.0) -> Column:
    """A rate's peak after so many minutes, whole ones, none below 0."""
    return peak * F.pow(F.lit(0.5), F.greatest(F.floor(minutes), F.lit(0)) / F.lit(half_life))


def peak_rate(rate: Column, peak: Column, minutes: Column) -> Column:
    """The peak kept: the present rate where it is no less than the faded peak."""
    return F.greatest(rate, decayed_peak(peak, minutes))


def by_type(event_type: Column, table: dict, otherwise) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(event_type == k, v) if out is None else out.when(event_type == k, v)
    return out.otherwise(otherwise)


def faded(score: Column, event_type: Column, hours: Column) -> Column:
    """A score after so many hours without an event, rounded."""
    half, grace = (by_type(event_type, {k: v[i] for k, v in FADING.items()}, FADING_ELSE[i]) for i in (0, 1))
    return half_round(score * F.exp(F.lit(-0.693) / half * F.greatest(hours - grace, F.lit(0.0)))).cast("int")


def geo_radius_km(event_type: Column) -> Column:
    return by_type(event_type, RADIUS, RADIUS_ELSE)


def size_penalty(events: Column, divisor: float = 50.0) -> Column:
    return half_round(-F.log(1 + events / F.lit(divisor))).cast("int")


def certainty(sources: Column, events: Column, entities: Column, titled: Column) -> Column:
    """0.1 to 1, by S-curves of sources and events, by entities, and by a title from a model."""
    s = 0.4 / (1 + F.exp(-1.5 * (sources - 2)))
    n = 0.3 / (1 + F.exp(-0.3 * (events - 10)))
    e = 0.15 * (1 - F.exp(-0.5 * entities))
    return F.least(F.lit(1.0), 0.1 + s + n + e + F.when(titled, 0.05).otherwise(0.0))


def gap_tolerance(rank: Column, diversity: Column, peak: Column, minutes: Column) -> Column:
    """Hours without events that a situation bears: by severity, more while a burst is fresh and with more sources, at most 24; with one source at most 6."""
    base = F.when(rank == 4, 12.0).when(rank == 3, 8.0).when(rank == 2, 4.0).otherwise(2.0)
    active = F.greatest(F.lit(0.0), F.least(F.lit(3.0), decayed_peak(peak, minutes) / 5.0))
    sources = F.greatest(F.lit(1.0), F.least(F.lit(2.0), diversity / F.lit(2.0)))
    return F.when(diversity <= 1, F.least(base, F.lit(6.0))).otherwise(F.least(F.lit(24.0), base * (1 + active * 0.5) * (1 + (sources - 1) * 0.3)))


def next_phase(phase: Column, velocity: Column, peak: Column, rate: Column, diversity: Column, rank: Column, idle: Column, events: Column, tolerance: Column) -> Column:
    """The phase that follows from the present one and the counts, null where it stays. idle: hours since the last event."""
    signals = sum(((c).cast("int") for c in (velocity >= 5, diversity >= 3, rank >= 3, events >= 10, events >= 50)), F.lit(0))
    emerging = F.when(((events >= 3) & (diversity >= 2)) | (rank >= 3), "developing").when(idle > 6, "resolved")
    developing = F.when((signals >= 3) | (velocity >= 5), "active").when(idle > tolerance, "declining")
    active = F.when((peak > 0) & (rate < peak * 0.3), "declining").when(idle > tolerance * 0.5, "declining")
    declining = F.when((peak > 0) & (rate > peak * 0.7), "active").when(idle > tolerance * 1.5, "resolved")
    resolved = F.when(idle > tolerance * 3, "historical").when(velocity > 0, "developing")
    return F.when(phase == "emerging", emerging).when(phase == "developing", developing).when(phase == "active", active).when(phase == "declining", declining).when(phase == "resolved", resolved)


def recomputed_rank(phase: Column, conflict_source: Column, conflict_topic: Column, cyber_source: Column, disaster_topic: Column, events: Column, diversity: Column, child: Column, idle: Column, least: tuple = (5, 25, 40)) -> Column:
    """A situation's severity rank from scratch. least: events from which it may be medium, high, critical (numbers, or columns of percentiles)."""
    medium, high, critical = (x if isinstance(x, Column) else F.lit(x) for x in least)
    cap = F.when(disaster_topic & ~conflict_topic, 3).otherwise(4)
    live = phase.isin("developing", "active")
    rank = (
        F.when((phase == "active") & conflict_source & conflict_topic & (events >= critical) & (diversity >= 4), F.least(F.lit(4), cap))
        .when(live & conflict_topic & (events >= high) & (diversity >= 3), 3)
        .when(live & (cyber_source | disaster_topic) & (diversity >= 2) & (events >= high), 3)
        .when(live & (events >= critical) & (diversity >= 4), 3)
        .when((conflict_topic | cyber_source | disaster_topic) & (diversity >= 2), 2)
        .when((diversity >= 4) & (events >= medium), 2)
        .otherwise(1)
    )
    rank = F.when(child & (rank == 4), 3).otherwise(rank)
    return F.when(F.floor(idle) > 48, F.least(rank, F.lit(2))).otherwise(rank)


def stale(phase: Column, live_children: Column, signal_events: Column, events: Column, idle: Column, hours: float = 6.0) -> Column:
    """Whether a situation is to go: too long without an event, a quarter of it for many positions without news; not while it declines or has children that live."""
    after = F.when((signal_events == 0) & (events >= 20), hours / 4).otherwise(hours)
    return (phase != "declining") & ~live_children & (idle > after)
