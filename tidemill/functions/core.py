"""Column functions: times, calendars, severities, shares and probabilities.

Missing measures are NULL throughout; NaN and infinities become NULL where data
enters and again before an aggregate (``clean``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..specs import SEVERITIES

INF = float("inf")
FLOOR = 1e-6
KS_TERMS, KS_STOP = 100, 1e-12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """The value where it is finite, else NULL."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: clean(n) for n in names})


def lenient(c: str | Column) -> Column:
    """A number, or NULL where the text is none."""
    return clean(col(c).try_cast("double"))


def hours(c: str | Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_timestamp(col(c).cast("timestamp")) / 3600).cast("long")


def from_hours(c: str | Column) -> Column:
    return F.timestamp_seconds(col(c) * 3600)


def floor_to(c: str | Column, unit: str) -> Column:
    return F.date_trunc(unit, col(c).cast("timestamp"))


def ceil_to(c: str | Column, unit: str) -> Column:
    low = floor_to(c, unit)
    return F.when(low == col(c).cast("timestamp"), low).otherwise(low + F.expr(f"INTERVAL 1 {unit}"))


def parse_hour(c: str | Column) -> Column:
    """``yyyy-MM-ddTHH``, else an ISO time, read as UTC."""
    return F.coalesce(F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd'T'HH")), F.try_to_timestamp(col(c)))


def local_date(c: str | Column, timezone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(c).cast("timestamp"), timezone))


def published_at(target: str | Column, hour: int = 12) -> Column:
    """When the forecast for a target is taken as known: the day before at ``hour``."""
    return floor_to(target, "day") - F.expr("INTERVAL 1 DAY") + F.expr(f"INTERVAL {hour} HOURS")


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Hour, day of week (Monday 0), month and weekend flag of ``ts``."""
    t = F.col(ts).cast("timestamp")
    day = F.weekday(t)
    return df.withColumns({"hour": F.hour(t), "dayofweek": day, "month": F.month(t), "is_weekend": (day >= 5).cast("int")})


#: US federal holidays (fixed values): name, month, then a day, or the nth Monday or Thursday (0: the last), and first year
FIXED_DAYS = (("New Year", 1, 1, 0), ("Juneteenth", 6, 19, 2021), ("Independence Day", 7, 4, 0), ("Veterans Day", 11, 11, 0), ("Christmas", 12, 25, 0))
FLOATING_DAYS = (
    ("Martin Luther King Day", 1, "MON", 3, 1986),
    ("Washington's Birthday", 2, "MON", 3, 0),
    ("Memorial Day", 5, "MON", 0, 0),
    ("Labor Day", 9, "MON", 1, 0),
    ("Columbus Day", 10, "MON", 2, 0),
    ("Thanksgiving", 11, "THU", 4, 0),
)


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(holiday_date, holiday) as observed in the years from ``first`` to ``last``: eleven rows a year."""
    years = spark.range(first - 1, last + 2).select(F.col("id").cast("int").alias("y"))
    rows = []
    for name, month, day, since in FIXED_DAYS:
        d = F.make_date("y", F.lit(month), F.lit(day))
        on = F.weekday(d)
        # Saturdays are observed the day before, Sundays the day after.
        rows.append(F.when(F.col("y") >= since, F.struct(F.date_add(d, F.when(on == 5, -1).when(on == 6, 1).otherwise(0)).alias("holiday_date"), F.lit(name).alias("holiday"))))
    for name, month, weekday, nth, since in FLOATING_DAYS:
        start = F.make_date("y", F.lit(month), F.lit(1))
        if nth:
            d = F.date_add(F.next_day(F.date_add(start, -1), weekday), 7 * (nth - 1))
        else:
            d = F.next_day(F.date_add(F.last_day(start), -7), weekday)
        rows.append(F.when(F.col("y") >= since, F.struct(d.alias("holiday_date"), F.lit(name).alias("holiday"))))
    out = years.select(F.explode(F.array(*rows)).alias("h")).where("h is not null").select("h.*")
    return out.where(F.year("holiday_date").between(first, last))


def holiday_flag(df: DataFrame, ts: str, timezone: str, first: int = 1980, last: int = 2060) -> DataFrame:
    """``is_holiday``: the local day of ``ts`` is an observed holiday. The table has eleven rows a year, so it is broadcast."""
    days = F.broadcast(holidays(df.sparkSession, first, last).select(F.col("holiday_date").alias("__day"), F.lit(1).alias("is_holiday")).distinct())
    out = df.withColumn("__day", local_date(ts, timezone)).join(days, "__day", "left").drop("__day")
    return out.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))


def severity(value: str | Column, warn: float, alert: float) -> Column:
    return F.when(col(value) >= alert, F.lit("alert")).when(col(value) >= warn, F.lit("warn")).otherwise(F.lit("ok"))


def rank(c: str | Column) -> Column:
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        out = F.when(col(c) == s, i).otherwise(out)
    return out


def severity_of(c: str | Column) -> Column:
    """The severity of a rank."""
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), col(c).cast("int"))


def psi_term(expected: str | Column, actual: str | Column) -> Column:
    """(a - e) ln(a / e) of two shares, floored."""
    e, a = F.greatest(col(expected), F.lit(FLOOR)), F.greatest(col(actual), F.lit(FLOOR))
    return (a - e) * F.ln(a / e)


def ks_p_value(d: str | Column, n1: str | Column, n2: str | Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p value; 1 where a sample is empty or D is not positive."""
    n1, n2, d = col(n1).cast("double"), col(n2).cast("double"), col(d)
    n = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (n + 0.12 + 0.11 / n) * d

    def add(acc: Column, k: Column) -> Column:
        term = 2.0 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * lam * lam * k * k)
        done = acc["done"] | (F.abs(term) < KS_STOP)
        return F.struct((acc["sum"] + F.when(acc["done"], 0.0).otherwise(term)).alias("sum"), done.alias("done"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("done"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), start, add, lambda acc: acc["sum"])
    return F.when((n1 <= 0) | (n2 <= 0) | (d <= 0) | d.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def bin_label(lo: str | Column, hi: str | Column) -> Column:
    """``[lo, hi)`` to four significant digits, for display only."""

    def even(x: Column) -> Column:
        """``x``, but just below where it lies exactly between an even fourth digit and the next: ties go to the even one, as in C, not up."""
        places = 4 - F.floor(F.log10(F.abs(x)))
        digits = F.abs(x) * F.pow(F.lit(10.0), places)
        tie = (digits % 20 == 5) & (digits / F.pow(F.lit(10.0), places) == F.abs(x)) & (digits % F.pow(F.lit(5.0), F.greatest(places, F.lit(0))) == 0)
        return F.when(tie, F.signum(x) * (digits - 1) / F.pow(F.lit(10.0), places)).otherwise(x)

    def short(x: Column) -> Column:
        text = F.format_string("%.4g", even(x))
        bare = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
        return F.when(x == INF, F.lit("inf")).when(x == -INF, F.lit("-inf")).otherwise(bare)

    return F.concat(F.lit("["), short(col(lo)), F.lit(", "), short(col(hi)), F.lit(")"))
