"""Distribution statistics of many columns at once: quantile edges, histograms, PSI, KS, summaries.

Input is long: any key columns, ``column``, ``window`` (``reference`` or
``current``) and ``value``; or already ``counted``: one row per distinct value with
its number in both windows. Every statistic follows from these counts, which are
made once, with partial sums before the one shuffle of the rows, and is grouped by
the keys and column, so one job covers all columns of all series. Order statistics
are selected from cumulated counts (``placed``), so no task holds a column whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import INF, bin_label, clean, ks_p_value, psi_term, severity
from ..specs import Thresholds

SIDES = ("reference", "current")
#: quantiles that summaries show
SHOWN = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
#: ranges of values that one column is dealt into, if it has values enough
BUCKETS = 16
#: distinct values a range may hold before there are more ranges, and of how many values one is looked at to cut them
RANGE, SPARSE = 200_000, 1024
#: parts that a column's values are dealt into by hash until their ranges are known
PARTS = 64


def long_form(df: DataFrame, columns: list[str], keys: list[str], window: str = "window") -> DataFrame:
    """Columns to rows (keys, window, column, value), missing values dropped."""
    wide = df.select(*keys, F.col(window).alias("window"), *[clean(c).alias(c) for c in columns])
    return wide.unpivot([*keys, "window"], columns, "column", "value").where("value is not null")


def _is(side: str) -> Column:
    return F.col("window") == side


def counted(long: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(keys, by, column, value, n_reference, n_current): how often each value stands in the two windows."""
    if "n_reference" in long.columns:
        return long
    return long.groupBy(*keys, *by, "column", "value").agg(*[F.count_if(_is(s)).alias(f"n_{s}") for s in SIDES])


def _part() -> Column:
    return F.pmod(F.xxhash64("value"), F.lit(PARTS))


def _cuts(counts: DataFrame, group: list[str], buckets: int) -> DataFrame:
    """(group, parts, cuts, steps): the parts a column's values lie in, where its distinct values are cut into ranges of near equal numbers, and the steps to find a range by halving.

    The values looked at are chosen by their hash, so the cuts follow from the set of values
    alone: every evaluation of the plan has the same ones, in whatever order rows arrive.
    """
    found = counts.groupBy(*group).agg(
        F.count("*").alias("n_values"),
        F.array_sort(F.collect_list(F.when(F.xxhash64("value") % SPARSE == 0, F.col("value")))).alias("some"),
        F.collect_set(_part()).alias("parts"),
    )
    number = F.least(F.size("some") + 1, F.greatest(F.lit(buckets), F.ceil(F.col("n_values") / RANGE)))
    found = found.withColumn("number", number.cast("long"))
    place = lambda i: (i * F.size("some") / F.col("number")).cast("int")
    cuts = F.when(F.col("number") > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.col("number") - 1), lambda i: F.get("some", place(i)))).otherwise(F.array().cast("array<double>"))
    most = F.ceil(F.log2(F.col("number"))).cast("int")
    return found.select(*group, "parts", cuts.alias("cuts"), F.transform(F.sequence(most, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int")).alias("steps"))


def ranged(counts: DataFrame, group: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``counts`` with ``bucket``, the number of the value's range from 0, shuffled by range.

    A column's distinct values are cut into ranges of near equal numbers, ``buckets`` or as many
    as hold ``RANGE`` values each. Cuts meet the values part by part: joined by column alone,
    one task would sort a column whole wherever the join is not broadcast.
    """
    bucket = F.aggregate("steps", F.lit(0), lambda at, step: F.when(F.get("cuts", at + step - 1) <= F.col("value"), at + step).otherwise(at))
    cuts = _cuts(counts, group, buckets).withColumn("part", F.explode("parts"))
    rows = counts.withColumn("part", _part()).join(cuts, [*group, "part"])
    return rows.select(*group, "value", *[f"n_{s}" for s in SIDES], bucket.alias("bucket")).repartition(*group, "bucket")


def placed(counts: DataFrame, group: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``counts`` with ``c_reference`` and ``c_current``, the rows not above the value, and each column's totals.

    Every range is cumulated by itself and shifted by the ranges before it, so no task holds a
    column whole.
    """
    rows = ranged(counts, group, buckets)
    per = rows.groupBy(*group, "bucket").agg(
        *[F.sum(f"n_{s}").alias(f"b_{s}") for s in SIDES],
        *[F.sum(F.col("value") * F.col(f"n_{s}")).alias(f"v_{s}") for s in SIDES],
        F.count_if(F.col("n_reference") > 0).alias("b_levels"),
    )
    whole = Window.partitionBy(*group)
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    all_ = {s: F.sum(f"b_{s}").over(whole) for s in SIDES}
    per = per.select(
        *group,
        "bucket",
        *[F.coalesce(F.sum(f"b_{s}").over(before), F.lit(0)).alias(f"before_{s}") for s in SIDES],
        *[all_[s].alias(f"all_{s}") for s in SIDES],
        *[(F.sum(f"v_{s}").over(whole) / F.nullif(all_[s], F.lit(0))).alias(f"mean_{s}") for s in SIDES],
        F.sum("b_levels").over(whole).alias("n_levels"),
        (F.max("bucket").over(whole) + 1).alias("ranges"),
    )
    within = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"c_{s}": F.sum(f"n_{s}").over(within) for s in SIDES}).join(per, [*group, "bucket"])
    return run.withColumns({f"c_{s}": F.col(f"c_{s}") + F.col(f"before_{s}") for s in SIDES}).drop("bucket", *[f"before_{s}" for s in SIDES])


class _Quantiles:
    """Exact interpolated quantiles by selection: the values at the two ranks around each, found by the rows that cover them."""

    def __init__(self) -> None:
        self.aggregates: list[Column] = []

    def ask(self, side: str, p: float) -> str:
        """The quantile as SQL over the aggregates asked for so far; NULL for an empty side."""
        at, name = f"({p!r}D * (all_{side} - 1))", f"__{len(self.aggregates)}"
        for end, k in (("lo", f"floor({at})"), ("hi", f"ceil({at})")):
            self.aggregates.append(F.expr(f"max(CASE WHEN c_{side} - n_{side} <= {k} AND c_{side} > {k} THEN value END) AS {name}{end}"))
        return f"CASE WHEN {name}lo = {name}hi THEN {name}lo ELSE (ceil({at}) - {at}) * {name}lo + ({at} - floor({at})) * {name}hi END"


def described(long: DataFrame, keys: list[str], t: Thresholds = Thresholds(), bins: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row a column with all that its counted values tell: one aggregate over the cumulated values.

    n, mean and std of both windows, their quantiles (``SHOWN``), ``ks_d``, ``n_levels``,
    ``ranges`` (how many ``ranged`` cuts the column into),
    ``levels`` (the reference's, where these are at most ``max_categorical_levels``), and
    ``edges``: the reference's interpolated quantiles, equal ones collapsed, ends open.
    """
    group, bins = [*keys, "column"], bins or t.psi_bins
    run = placed(counted(long, keys), group, buckets)
    q, shown = _Quantiles(), {}
    at = [q.ask("reference", i / bins) for i in range(bins + 1)]
    for s in SIDES:
        shown |= {f"{s}_{name}": q.ask(s, p) for name, p in SHOWN.items()}
    off = lambda s: F.col("value") - F.col(f"mean_{s}")
    few = (F.col("n_levels") <= t.max_categorical_levels) & (F.col("n_reference") > 0)
    totals = ["n_levels", "ranges", *[f"{c}_{s}" for c in ("all", "mean") for s in SIDES]]
    found = run.groupBy(*group, *totals).agg(
        *q.aggregates,
        *[F.sum(off(s) * off(s) * F.col(f"n_{s}")).alias(f"square_{s}") for s in SIDES],
        F.max(F.abs(F.col("c_reference") / F.nullif("all_reference", F.lit(0)) - F.col("c_current") / F.nullif("all_current", F.lit(0)))).alias("gap"),
        F.array_sort(F.collect_set(F.when(few, F.col("value")))).alias("held"),
    )
    std = lambda s: F.when(F.col(f"all_{s}") == 1, 0.0).when(F.col(f"all_{s}") > 1, F.sqrt(F.col(f"square_{s}") / (F.col(f"all_{s}") - 1)))
    found = found.withColumn("q", F.expr(f"array_distinct(array({', '.join(at)}))"))
    inner = F.slice("q", 2, F.greatest(F.size("q") - 2, F.lit(0)))
    edges = F.when(F.size("q") >= 2, F.concat(F.array(F.lit(-INF)), inner, F.array(F.lit(INF)))).otherwise(F.array().cast("array<double>"))
    return found.select(
        *group,
        *[F.col(f"all_{s}").alias(f"n_{s}") for s in SIDES],
        *[F.col(f"mean_{s}") for s in SIDES],
        *[std(s).alias(f"std_{s}") for s in SIDES],
        *[F.expr(c).alias(name) for name, c in shown.items()],
        "n_levels",
        "ranges",
        F.when(F.col("n_levels").between(1, t.max_categorical_levels), F.col("held")).alias("levels"),
        F.when(F.col("n_levels") > 0, edges).alias("edges"),
        F.coalesce("gap", F.lit(0.0)).alias("ks_d"),
    )


def quantile_edges(long: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """``edges``: the reference's interpolated quantiles, equal ones collapsed, ends open."""
    return described(long, keys, bins=bins).where("edges is not null").select(*keys, "column", "edges")


def levels(long: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct reference values each column has."""
    return counted(long, keys).groupBy(*keys, "column").agg(F.count_if(F.col("n_reference") > 0).alias("n_levels")).where("n_levels > 0")


def binned(rows: DataFrame, plan: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``bin``, bins of each column with their bounds), by the levels and edges of ``described``.

    A column with levels has a bin for each, and bin 0 for values the reference lacks;
    any other has a bin between each two quantile edges. The bins' table has a few
    dozen rows a column. Rows of ``ranged`` meet the plan of the same counts range by range.
    """
    group = [*keys, "column"]
    each = [F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("bucket")] if "bucket" in rows.columns else []
    plan = plan.where("edges is not null").select(*group, "levels", F.when(F.col("levels").isNull(), F.col("edges")).alias("edges"), *(["ranges"] if each else []))
    rows = rows.join(plan.select(*group, "levels", "edges", *each), [*group, *(["bucket"] if each else [])]).drop("bucket")
    level = F.array_position("levels", F.col("value")).cast("int")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    number = F.size(F.filter(inner, lambda e: e <= F.col("value"))) + 1
    rows = rows.withColumn("bin", F.when(F.col("levels").isNotNull(), level).when(F.size("edges") >= 2, number)).drop("levels", "edges")
    spans = F.when(
        F.col("levels").isNotNull(),
        F.concat(
            F.array(F.struct(F.lit(0).alias("bin"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))),
            F.transform("levels", lambda x, i: F.struct((i + 1).alias("bin"), x.alias("lo"), x.alias("hi"))),
        ),
    ).otherwise(F.transform(F.slice("edges", 1, F.greatest(F.size("edges") - 1, F.lit(0))), lambda x, i: F.struct((i + 1).alias("bin"), x.alias("lo"), F.get("edges", i + 1).alias("hi"))))
    bins = plan.select(*group, F.col("levels").isNotNull().alias("categorical"), F.inline(spans))
    return rows.where("bin is not null"), bins


def histogram(long: DataFrame, keys: list[str], t: Thresholds = Thresholds(), plan: DataFrame | None = None) -> DataFrame:
    """Counts of both windows in every bin, zeros included; ``plan`` is what ``described`` gave, if that is there already."""
    counts = counted(long, keys)
    group = [*keys, "column"]
    rows, bins = binned(ranged(counts, group), described(counts, keys, t), keys) if plan is None else binned(counts, plan, keys)
    found = rows.groupBy(*group, "bin").agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in SIDES])
    out = bins.join(found, [*group, "bin"], "left")
    return out.withColumns({f"n_{s}": F.coalesce(f"n_{s}", F.lit(0).cast("long")) for s in SIDES})


def level_counts(long: DataFrame, keys: list[str], t: Thresholds = Thresholds()) -> DataFrame:
    """The histogram of categorical columns; bin 0 (``<unseen>``) takes current values the reference lacks."""
    h = histogram(long, keys, t).where("categorical")
    return h.withColumn("level", F.when(F.col("bin") == 0, F.lit("<unseen>")).otherwise(F.col("lo").cast("string")))


def psi_detail(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Shares and the PSI term of every bin."""
    w = Window.partitionBy(*keys, "column")
    out = counts
    for s in SIDES:
        out = out.withColumn(f"share_{s}", F.col(f"n_{s}") / F.greatest(F.sum(f"n_{s}").over(w), F.lit(1)))
    return out.withColumn("term", psi_term("share_reference", "share_current"))


def _with_psi(counts: DataFrame, plan: DataFrame, keys: list[str], t: Thresholds, detail: bool) -> DataFrame:
    """``plan`` with psi, psi_status, categorical and bins.

    Each column's bins come together as one array, absent ones with zeros, so terms need no
    further grouping: ``plan`` is met once by the values and once by their few counts.
    """
    group = [*keys, "column"]
    rows, _ = binned(ranged(counts, group), plan, keys)
    found = rows.groupBy(*group, "bin").agg(*[F.sum(f"n_{s}").alias(f"b_{s}") for s in SIDES])
    found = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct(*[f"b_{s}" for s in SIDES])))).alias("found"))
    cut = F.greatest(F.size("edges") - 1, F.lit(0))
    numbers = F.when(F.col("levels").isNotNull(), F.sequence(F.lit(0), F.size("levels"))).when(cut > 0, F.sequence(F.lit(1), cut))
    at = lambda b, s: F.coalesce(F.try_element_at("found", b)[f"b_{s}"], F.lit(0).cast("long"))
    out = plan.join(found, group, "left").withColumn("held", F.transform(numbers, lambda b: F.struct(b.alias("bin"), *[at(b, s).alias(f"n_{s}") for s in SIDES])))
    total = lambda s: F.greatest(F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x[f"n_{s}"]), F.lit(1))
    out = out.withColumns({f"total_{s}": total(s) for s in SIDES})
    share = lambda x, s: x[f"n_{s}"] / F.col(f"total_{s}")
    out = out.withColumn("terms", F.transform("held", lambda x: psi_term(share(x, "reference"), share(x, "current"))))
    out = out.withColumns(
        {
            "psi": F.when(F.size("held") > 0, F.aggregate("terms", F.lit(0.0), lambda a, x: a + x)),
            "categorical": F.when(F.size("held") > 0, F.col("levels").isNotNull()),
            "bins": F.when(F.size("held") > 0, F.size("held").cast("long")),
        }
    )
    if detail:
        low = lambda b: F.when(F.col("levels").isNull(), F.get("edges", b - 1)).otherwise(F.get("levels", b - 1))
        high = lambda b: F.when(F.col("levels").isNull(), F.get("edges", b)).otherwise(F.get("levels", b - 1))
        name = lambda b: F.when(F.col("levels").isNull(), bin_label(low(b), high(b))).otherwise(F.when(b == 0, F.lit("<unseen>")).otherwise(low(b).cast("string")))
        told = lambda x, i: F.struct(
            x["bin"].alias("bin"), name(x["bin"]).alias("label"), low(x["bin"]).alias("lo"), high(x["bin"]).alias("hi"), x["n_reference"].alias("n_reference"), x["n_current"].alias("n_current"),
            *[share(x, s).alias(f"share_{s}") for s in SIDES], F.get("terms", i).alias("term"),
        )
        out = out.withColumn("psi_bins", F.transform("held", told))
    ok = (F.col("n_reference") > 0) & (F.col("n_current") > 0) & F.col("psi").isNotNull()
    return out.withColumns({"psi": F.when(ok, F.col("psi")).otherwise(F.lit(0.0)), "psi_status": F.when(ok, F.lit("ok")).otherwise(F.lit("degenerate"))})


def psi(long: DataFrame, keys: list[str], t: Thresholds = Thresholds(), detail: bool = False) -> DataFrame:
    """psi, psi_status (``ok`` or ``degenerate``) and n of both windows for every column; 0 where a side is empty."""
    counts = counted(long, keys)
    out = _with_psi(counts, described(counts, keys, t), keys, t, detail)
    return out.select(*keys, "column", "n_reference", "n_current", "psi", "categorical", "bins", *(["psi_bins"] if detail else []), "psi_status")


def ks(long: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """ks_d (exact) and ks_p of the two windows for every column."""
    return described(long, keys, buckets=buckets).select(*keys, "column", "ks_d", ks_p_value("ks_d", "n_reference", "n_current").alias("ks_p"))


def _summary(plan: DataFrame) -> list[Column]:
    """n, mean, std and quantiles of both windows (4 places) and the shift of the rounded means."""
    out = []
    for s in SIDES:
        out += [F.col(f"n_{s}").alias(f"{s}_n"), *[F.round(f"{c}_{s}", 4).alias(f"{s}_{c}") for c in ("mean", "std")]]
        out += [F.round(f"{s}_{name}", 4).alias(f"{s}_{name}") for name in SHOWN]
    shift = F.round(F.round("mean_current", 4) - F.round("mean_reference", 4), 4)
    return [*out, shift.alias("mean_shift")]


def summarise(long: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, std, p05, p50, p95 of both windows (4 places) and the shift of the rounded means."""
    plan = described(long, keys)
    return plan.select(*keys, "column", *_summary(plan))


def compare_columns(long: DataFrame, keys: list[str], t: Thresholds = Thresholds(), deterministic: tuple[str, ...] = (), detail: bool = False) -> DataFrame:
    """PSI, KS and summary of every column with one severity.

    PSI decides; a KS p value below its line lifts ok to warn, never further; too
    few rows on either side give ok with ``insufficient_data``.
    """
    counts = counted(long, keys)
    out = _with_psi(counts, described(counts, keys, t), keys, t, detail).withColumn("ks_p", ks_p_value("ks_d", "n_reference", "n_current"))
    shown = ["n_reference", "n_current", "psi", "categorical", "bins", *(["psi_bins"] if detail else []), "psi_status", "ks_d", "ks_p"]
    out = out.select(*keys, "column", *shown, *_summary(out))
    few = F.least("n_reference", "n_current") < t.min_samples
    by_psi = severity("psi", t.psi_warn, t.psi_alert)
    lifted = F.when((by_psi == "ok") & (F.col("ks_p") < t.ks_p_alert), F.lit("warn")).otherwise(by_psi)
    return out.withColumns(
        {"insufficient_data": few, "severity": F.when(few, F.lit("ok")).otherwise(lifted), "deterministic": F.col("column").isin(list(deterministic)) if deterministic else F.lit(False)}
    )
