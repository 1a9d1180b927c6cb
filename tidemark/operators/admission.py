"""Who may do what, and how much of it: token buckets, storage, credentials; small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import fold

MILLI = 1000


def token_buckets(requests: DataFrame) -> DataFrame:
    """(bucket, place, admitted) of (bucket, place, at_micros, rate) requests, in order of place within each bucket.

    A bucket of ``rate`` a second holds one second of it and starts full; the clock moves
    only once a whole milli-token has accrued, so frequent polling loses nothing. A null
    rate is unlimited and leaves the bucket as it was, a rate of 0 admits nothing, a
    changed rate builds a new full bucket. Each bucket's requests stream past its (tokens, last, rate).
    """
    limited = requests.select("bucket", "place", "at_micros", "rate").where("rate IS NOT NULL")
    folded = fold(limited, ["bucket"], ["place"], ["at_micros", "rate"], "admitted boolean", lambda: (0, None, None), take_token)
    return folded.select("bucket", "place", "admitted").unionByName(requests.where("rate IS NULL").select("bucket", "place", F.lit(True).alias("admitted")))


def take_token(bucket: tuple, now: int, rate: int) -> tuple[tuple, tuple[bool]]:
    """The bucket (milli-tokens, last refill, rate) after a request at ``now``, and whether that is admitted."""
    tokens, last, old = bucket
    if last is None or old != rate:
        tokens, last = rate * MILLI, now
    elif (refill := max(0, now - last) * rate // MILLI) > 0:
        tokens, last = min(tokens + refill, rate * MILLI), now
    takes = tokens >= MILLI
    return (tokens - MILLI * takes, last, rate), (takes,)


def rate_share(limit: Column, nodes: Column) -> Column:
    """A node's part of a keyspace's rate: at least 1, but 0 stays 0 and unlimited stays unlimited."""
    return F.when(limit == 0, F.lit(0)).when(limit.isNotNull(), F.greatest(F.floor(limit / nodes), F.lit(1))).cast("long")


def authorize(
    requests: DataFrame, credentials: DataFrame, root_hash: str, refreshed_at: int | None = None,
    stale_after: int | None = None, enabled: bool = True,
) -> DataFrame:
    """``requests`` (request_id, header, keyspace_id, permission, now_millis) with a verdict.

    Off: all allowed. The root is always allowed. Credentials confirmed too long ago fail
    closed as ``unavailable``. An unknown secret is ``unauthenticated``; a known one must
    name the keyspace and the permission and be unexpired, else ``denied``.
    """
    secret = F.regexp_extract("header", r"^Bearer (.+)$", 1)
    rows = requests.withColumn("secret_hash", F.when(secret != "", F.sha2(secret, 256)))
    known = credentials.groupBy("secret_hash").agg(F.first(F.struct("keyspace_id", "permissions", "expires_at_millis")).alias("c"))
    rows = rows.join(known, "secret_hash", "left")
    stale = F.lit(False) if refreshed_at is None or stale_after is None else F.col("now_millis") - refreshed_at > stale_after
    fits = (F.col("c.keyspace_id") == F.col("keyspace_id")) & F.array_contains(F.split("c.permissions", ","), F.col("permission")) & F.coalesce(
        F.col("c.expires_at_millis") > F.col("now_millis"), F.lit(True),
    )
    verdict = F.when(F.lit(not enabled), "allowed").when(F.col("secret_hash").isNull(), "unauthenticated").when(F.col("secret_hash") == root_hash, "allowed").when(stale, "unavailable").when(F.col("c").isNull(), "unauthenticated").when(fits, "allowed").otherwise("denied")
    return rows.withColumn("verdict", verdict).drop("c")


def format_bytes(n: Column) -> Column:
    """One decimal, halves to even (of the quotients only .25 and .75 are halves, and exact)."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(
            n >= 1024**power,
            F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}")),
        ).otherwise(out)
    return out


def format_millis(millis: Column) -> Column:
    """ISO-8601 seconds in UTC; the session's time zone is UTC."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def blob_display(value: Column) -> Column:
    """Text where it is UTF-8, else base64 with a mark, in one line (Spark's breaks after 76 characters)."""
    line = F.replace(F.base64(value), F.lit("\r\n"), F.lit(""))
    return F.when(F.is_valid_utf8(value), F.decode(value, "UTF-8")).otherwise(F.concat(F.lit("base64:"), line))


# The units of durations, in milliseconds.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def parse_duration(text: Column) -> Column:
    """Milliseconds of a number and a unit (a bare 0 needs none); null for anything else."""
    clean = F.trim(text)
    unit = F.regexp_extract(clean, r"^\d+(ms|s|m|h|d)$", 1)
    scale = F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)
    return F.when(clean == "0", F.lit(0).cast("long")).when(unit != "", F.regexp_extract(clean, r"^(\d+)", 1).try_cast("long") * scale)
