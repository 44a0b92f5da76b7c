"""Mann-Kendall trend tests, plain and by season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import as_list, attach, durable, null_safe_join
from shoalwise.functions.columns import missing_as_null
from shoalwise.functions.tails import kendall_exact, normal_two_sided

BITS = 4
RADIX = 1 << BITS


def _clock(df: DataFrame, time: str):
    kind = df.schema[time].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(time)
    if isinstance(kind, T.TimestampNTZType):
        # a wall clock without a zone: its own fields
        at = F.col(time)
        minutes = (F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(time).cast("long")
    raise TypeError(f"{time} must be a date, timestamp or whole number")


def _signed(counts: str, below: str) -> str:
    """Sum over digits v of count_v * (below at smaller digits - below at larger ones)."""
    everything = " + ".join(f"{below}{u}" for u in range(RADIX))
    terms = []
    for v in range(RADIX):
        earlier = " + ".join(f"{below}{u}" for u in range(v)) or "0"
        terms.append(f"{counts}{v} * (2 * ({earlier}) + {below}{v} - ({everything}))")
    return " + ".join(terms)


def _score(rows: DataFrame, groups: list[str]) -> DataFrame:
    """S = sum over i < j of sign(x_j - x_i), per group, without forming pairs.

    Write the times in base 16.  Two times first differ in one digit: for every
    digit place, points that agree above it form a cell, and the place orders
    them.  S of a cell follows from running counts per digit in value order, so
    each point is repeated once per digit of the time range, not once per
    partner.  The value order is cut by range partitioning and the cuts are
    combined from their counts, so neither a long series nor a large cell ever
    sits in one task.
    """
    span = rows.agg(F.struct(F.min("__t").alias("lo"), F.max("__t").alias("hi")).alias("s")).scalar()
    timed = rows.withColumn("__span", span)
    places = F.length(F.hex(F.col("__span.hi") - F.col("__span.lo")))
    t = F.col("__t") - F.col("__span.lo")
    by_place = timed.select(
        *groups, "__x", t.alias("__t"), F.explode(F.sequence(F.lit(0), places - 1)).alias("__place")
    )
    cell = [*groups, "__place", "__cell"]
    digits = range(RADIX)
    counts = (
        by_place.withColumns(
            {
                "__cell": F.expr(f"shiftright(__t, {BITS} * (__place + 1))"),
                "__digit": F.expr(f"shiftright(__t, {BITS} * __place) & {RADIX - 1}"),
            }
        )
        .groupBy(*cell, "__x")
        .agg(*[F.expr(f"count_if(__digit = {v}) AS c{v}") for v in digits])
    )
    cut = counts.repartitionByRange(*cell, "__x").withColumn("__cut", F.spark_partition_id())

    def below(df: DataFrame, by: list[str], order: str) -> DataFrame:
        """Add the counts at strictly smaller positions."""
        over = f"PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return df.select("*", *[F.expr(f"coalesce(sum(c{v}) OVER ({over}), 0) AS b{v}") for v in digits])

    inside = (
        below(cut, [*cell, "__cut"], "__x")
        .groupBy(*cell, "__cut")
        .agg(F.expr(f"sum({_signed('c', 'b')}) AS __own"), *[F.expr(f"sum(c{v}) AS c{v}") for v in digits])
    )
    across = below(inside, cell, "__cut")
    return across.groupBy(*groups).agg(F.expr(f"sum(__own + {_signed('c', 'b')}) AS s"))


def _tied_groups(rows: DataFrame, tied: DataFrame, by: list[str], keys: list[str], most: int) -> DataFrame:
    """Per key its number of series, and the sizes of tied groups of those of at most ``most`` values at different times.

    Long series are left out before anything is collected.
    """
    short = tied.groupBy(*by).agg(F.sum("__c").alias("__size")).where(F.col("__size") <= most).select(*by)
    sizes = null_safe_join(tied, short, by).groupBy(*by).agg(F.sort_array(F.collect_list("__c")).alias("__sizes"))
    times = rows.groupBy(*by, "__t").agg(F.count(F.lit(1)).alias("__c")).groupBy(*by).agg(F.max("__c").alias("__same"))
    return (
        null_safe_join(times, sizes, by, "left")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__series"),
            F.collect_list(F.when(F.col("__same") == 1, F.col("__sizes"))).alias("__ties"),
        )
    )


def mann_kendall(
    df: DataFrame,
    keys: str | Sequence[str],
    time: str,
    value: str,
    season: str | None = None,
    continuity: bool = True,
    exact_up_to: int | None = None,
) -> DataFrame:
    """S, its variance, tau, Z and two-sided p per key; missing values are dropped.

    With ``season`` the test runs within each season and S, the variances and
    the tau denominators are summed.  Ties enter the variance and tau.

    ``exact_up_to`` adds ``exact_p``: the share of all orders of the values
    (of each season's, with ``season``) whose S is as far from 0, tied values
    included.  It is NULL where a series has more values than that, or values
    that share a time.
    """
    keys = as_list(keys)
    groups = [*keys, season] if season else keys
    rows = df.select(
        *groups, _clock(df, time).alias("__t"), missing_as_null(F.col(value).cast("double")).alias("__x")
    ).where(F.col("__x").isNotNull() & F.col("__t").isNotNull())
    # one constant group keeps the joins the same when there is no key
    by = groups or ["__all"]
    rows = rows if groups else rows.withColumn("__all", F.lit(1))
    # the series is read for its time range, its ties and its score
    rows = durable(rows)
    c = F.col("__c").cast("double")
    tied = rows.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c"))
    ties = (
        tied.groupBy(*by)
        .agg(
            F.sum("__c").alias("n"),
            F.sum(c * (c - 1) / 2).alias("__tied"),
            F.sum(c * (c - 1) * (2 * c + 5)).alias("__tied_var"),
        )
    )
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    parts = null_safe_join(ties, _score(rows, by), by, "left").withColumns(
        {
            "s": F.coalesce("s", F.lit(0)),
            "var_s": (n * (n - 1) * (2 * n + 5) - F.col("__tied_var")) / 18,
            "__denominator": F.sqrt(pairs * (pairs - F.col("__tied"))),
        }
    )
    if season:
        parts = parts.groupBy(*keys).agg(
            *[F.sum(v).alias(v) for v in ("n", "s", "var_s", "__denominator")]
        )
    s = F.col("s").cast("double")
    shifted = s - F.signum(s) if continuity else s
    tested = parts.withColumns(
        {
            "tau": F.try_divide(s, F.col("__denominator")),
            "z": F.try_divide(shifted, F.sqrt("var_s")),
        }
    )
    out = [*keys, "n", "s", "var_s", "tau", "z", normal_two_sided("z").alias("p")]
    if exact_up_to is not None:
        whole = keys if season else by
        tested = attach(tested, _tied_groups(rows, tied, by, whole, exact_up_to), whole)
        known = F.size("__ties") == F.col("__series")
        out.append(F.when(known, kendall_exact("__ties", "s")).alias("exact_p"))
    return tested.select(*out)
