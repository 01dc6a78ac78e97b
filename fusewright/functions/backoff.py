"""How long a source waits after a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusewright.sources.wire import parse_time

#: Seconds to wait where a server that limits requests doesn't say.
RETRY_SECONDS = 60


def retry_after(header: Column, reset: Column, now: Column) -> Column:
    """Seconds to wait after a limit: what Retry-After says, by number or date, else until the epoch of X-RateLimit-Reset, a second at least for times; else a minute."""
    at_least = lambda x: F.when(x.isNotNull(), F.greatest(x - now, F.lit(1)))
    given = F.when(F.trim(header).rlike("^[0-9]+$"), F.trim(header).try_cast("long"))
    return F.coalesce(given, at_least(F.unix_seconds(parse_time(header))), at_least(F.trim(reset).try_cast("long")), F.lit(RETRY_SECONDS)).cast("long")


def wait_seconds(kind: Column, failures: Column, retry: Column, dice: Column) -> Column:
    """Seconds until the next try: of a stream 10 doubled with each failure to 30 minutes, of a poll 30 doubled to 5 minutes; after a limit what
    the server asked for and 30 for each failure, 10 minutes at most. The first two have up to a quarter more, by dice from 0 to 1."""
    doubled = lambda base, steps, most: F.least(base * F.pow(F.lit(2.0), F.least(failures, F.lit(steps))), F.lit(float(most)))
    stream, poll = doubled(10, 8, 1800), doubled(30, 4, 300)
    return F.when(kind == "stream", stream * (1 + dice / 4)).when(kind == "limited", F.least(retry + 30 * failures, F.lit(600)).cast("double")).otherwise(poll * (1 + dice / 4))
