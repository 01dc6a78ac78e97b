"""One relational text, two engines: runs on Spark over the tables it names, or renders for the SQL check."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from fusewright.sources.events import AS_OF, CANONICAL

_TABLE = re.compile(r"\{(\w+)\}")
_EVENTS = re.compile(r"\bEV\b")
_EPOCH = re.compile(r"EPOCH\((\w+)\)")


#: Bounds on an event's time relative to AS_OF.
_BOUND = re.compile(r"\bt (>=|<|>) AS_OF(?: - (\d+))?")


def _bound(m: re.Match) -> str:
    """The bound on t, and the same on the stored column, which a scan can prune by."""
    at = AS_OF - int(m[2] or 0) + (m[1] == ">")
    sign = ">=" if m[1] == ">" else m[1]
    return f"(t {sign} {at} AND ts {sign} TIMESTAMP_NTZ '{datetime.fromtimestamp(at, UTC):%Y-%m-%d %H:%M:%S}')"


def expand(text: str) -> str:
    return _EVENTS.sub(lambda _: CANONICAL, _BOUND.sub(_bound, text).replace("AS_OF", str(AS_OF)))


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = _EPOCH.sub(r"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", expand(text))
    names = set(_TABLE.findall(text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def render(text: str) -> str:
    text = _EPOCH.sub(r"CAST(floor(epoch(\1)) AS BIGINT)", expand(text))
    return _TABLE.sub(r"\1", text.replace("TIMESTAMP_NTZ", "TIMESTAMP"))
