"""Status over time: forward fill, counts per period, transitions, restriction estimates.

Snapshots are first reduced to the last one per (site, agent, period). That aggregate combines
map-side, so a site with very many snapshots shrinks before the shuffle, and later windows see at
most one row per period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import dates, windows
from corpusaudit.operators import robots


def start_dates(snapshots: DataFrame, ts: str = "ts") -> DataFrame:
    return snapshots.groupBy("url").agg(F.min(ts).alias("start_date"))


def with_start_dates(urls: DataFrame, starts: DataFrame) -> DataFrame:
    """Start date of every URL; 1970-01-01 when unknown."""
    return urls.join(starts, "url", "left").withColumn(
        "start_date", F.coalesce("start_date", F.lit("1970-01-01").cast("timestamp"))
    )


def _first_period(start: Column, grid_start: Column, unit: str) -> Column:
    """First period that begins at or after the site's start (and in the grid)."""
    floor = F.date_trunc(unit, start)
    ceil = F.when(floor == start, floor).otherwise(floor + F.expr(f"interval 1 {unit}"))
    return F.greatest(ceil.cast("date"), grid_start)


LABELS = tuple(dict.fromkeys([*dims.STRICTNESS, *dims.STRICTNESS_DETAILED]))


def _position(status: Column, labels: Sequence[str] | None) -> Column:
    if labels is None:
        return status
    return F.array_position(F.array(*[F.lit(v) for v in labels]), status).cast("int")


def _label(position: Column, labels: Sequence[str] | None) -> Column:
    if labels is None:
        return position
    return F.get(F.array(*[F.lit(v) for v in labels]), position - 1)


def _moment(ts: str, tie: str | None) -> Column:
    """Time as a number; equal times are ordered by ``tie`` (a non-negative bigint)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    if tie is None:
        return micros
    scale = F.lit(str(10**19)).cast("decimal(20,0)")
    return micros.cast("decimal(17,0)") * scale + F.col(tie).cast("decimal(19,0)")


def last_per_period(
    snapshots: DataFrame,
    keys: Sequence[str],
    status: str,
    ts: str,
    unit: str,
    tie: str | None = None,
    labels: Sequence[str] | None = LABELS,
) -> DataFrame:
    """(keys, period, status) of the last snapshot in each period.

    With a known list of labels the aggregate works on numbers only and is a hash aggregate; with
    ``labels=None`` any text goes, by sorting.
    """
    latest = F.max_by(_position(F.col(status), labels), _moment(ts, tie))
    return (
        snapshots.groupBy(*keys, dates.period_start(F.col(ts), unit).alias("period"))
        .agg(latest.alias("_s"))
        .select(*keys, "period", _label(F.col("_s"), labels).alias("status"))
    )


def status_intervals(
    snapshots: DataFrame,
    sites: DataFrame,
    start: str,
    end: str,
    unit: str = "month",
    keys: Sequence[str] = ("url", "agent"),
    ts: str = "ts",
    status: str = "status",
    tie: str | None = None,
    default: str = "no_robots",
    labels: Sequence[str] | None = LABELS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(keys, carry, from, until, status): periods ``from <= p < until`` in which a status is the last known.

    ``carry`` names columns of ``sites`` to hand on.
    A site's periods start with the first one that begins at or after its start date; before the
    first snapshot the status is the default. Snapshots are reduced to one per period before the
    join with the sites; the window then sees at most one row per period and keeps the join's
    partitioning, so there is no range join and no second large shuffle.
    """
    keys = list(keys)
    step = F.expr(f"interval 1 {unit}")
    first, last = (F.date_trunc(unit, F.lit(d)).cast("date") for d in (start, end))
    stop = (last + step).cast("date")
    reduced = last_per_period(snapshots, keys, status, ts, unit, tie, labels)
    located = (
        reduced.join(sites.select("url", "start_date", *carry), "url")
        .withColumn("_p0", _first_period(F.col("start_date"), first, unit))
        .filter(F.col("_p0") <= last)
    )
    w = W.partitionBy(*keys).orderBy("period")
    following = F.least(F.coalesce(F.lead("period").over(w), stop), stop)
    piece = lambda a, b, v: F.struct(a.alias("from"), b.alias("until"), v.alias("status"))
    own = piece(F.greatest("period", "_p0"), F.col("_next"), F.col("status"))
    lead_in = piece(F.col("_p0"), F.least(F.col("period"), stop), F.lit(default))
    return (
        located.withColumn("_next", following)
        .withColumn("_opens", F.row_number().over(w) == 1)
        .select(*keys, *carry, F.inline(F.when(F.col("_opens"), F.array(lead_in, own)).otherwise(F.array(own))))
        .filter(F.col("from") < F.col("until"))
    )


def fill_intervals(intervals: DataFrame, unit: str = "month") -> DataFrame:
    """One row per period of each interval."""
    step = F.expr(f"interval 1 {unit}")
    rest = [c for c in intervals.columns if c not in ("from", "until", "status")]
    periods = F.sequence(F.col("from"), (F.col("until") - step).cast("date"), step)
    return intervals.select(*rest, F.explode(periods).alias("period"), "status")


def fill_periods(
    snapshots: DataFrame, sites: DataFrame, start: str, end: str, unit: str = "month", **options
) -> DataFrame:
    """(keys, period, status) for every period from the site's start: the last status known by its end.

    Sites without snapshots have no rows. Options as in :func:`status_intervals`.
    """
    return fill_intervals(status_intervals(snapshots, sites, start, end, unit, **options), unit)


def interval_counts(
    intervals: DataFrame, keys: Sequence[str], end: str, unit: str = "month", weight: str | None = None
) -> DataFrame:
    """(period, keys, count, tokens) of the rows whose interval covers the period.

    An interval counts +1 where it begins and -1 where it ends. The sums per change point are small;
    their running total, repeated up to the next change point, gives every period. The work grows
    with the changes, not with sites times periods.
    """
    keys = list(keys)
    step = F.expr(f"interval 1 {unit}")
    last = F.date_trunc(unit, F.lit(end)).cast("date")
    value = F.lit(0).cast("bigint") if weight is None else F.coalesce(F.col(weight), F.lit(0)).cast("bigint")
    change = lambda p, d: F.struct(p.alias("period"), F.lit(d).alias("_d"))
    deltas = (
        intervals.select(
            *keys, value.alias("_w"), F.inline(F.array(change(F.col("from"), 1), change(F.col("until"), -1)))
        )
        .filter(F.col("period") <= last)
        .groupBy(*keys, "period")
        .agg(F.sum("_d").alias("_n"), F.sum(F.col("_d") * F.col("_w")).alias("_t"))
    )
    w = W.partitionBy(*keys).orderBy("period")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    until = F.coalesce((F.lead("period").over(w) - step).cast("date"), last)
    return (
        deltas.withColumn("count", F.sum("_n").over(so_far))
        .withColumn("tokens", F.sum("_t").over(so_far))
        .withColumn("_until", until)
        .filter("count > 0")
        .select(F.explode(F.sequence("period", "_until", step)).alias("period"), *keys, "count", "tokens")
    )


def first_from_period(
    snapshots: DataFrame,
    start: str,
    end: str,
    unit: str = "month",
    keys: Sequence[str] = ("url", "agent"),
    ts: str = "ts",
    status: str = "status",
    tie: str | None = None,
) -> DataFrame:
    """(keys, period, status): the first status at or after the start of each period, if there is one."""
    keys = list(keys)
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    grid = (F.date_trunc(unit, F.lit(start)).cast("date"), F.date_trunc(unit, F.lit(end)).cast("date"))
    reduced = (
        snapshots.groupBy(*keys, dates.period_start(F.col(ts), unit).alias("period"))
        .agg(F.min_by(status, order).alias("status"))
        .withColumn("_tick", F.lit(False))
    )
    ticks = (
        reduced.select(*keys)
        .distinct()
        .select(
            *keys,
            F.explode(F.sequence(*grid, F.expr(f"interval 1 {unit}"))).alias("period"),
            F.lit(None).cast("string").alias("status"),
            F.lit(True).alias("_tick"),
        )
    )
    merged = (
        reduced.unionByName(ticks)
        .groupBy(*keys, "period")
        .agg(F.max("status").alias("status"), F.max("_tick").alias("_tick"))
    )
    onward = W.partitionBy(*keys).orderBy("period").rowsBetween(0, W.unboundedFollowing)
    return (
        merged.withColumn("status", F.first("status", ignorenulls=True).over(onward))
        .filter("_tick AND status IS NOT NULL")
        .select(*keys, "period", "status")
    )


def nearest_period(events: DataFrame, series: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """Values of the period nearest to each event's date (ties: the earlier one).

    ``series`` is one short series (period, values). The match is made on distinct dates, so the
    window handles at most one row per calendar day whatever the number of events.
    """
    packed = F.struct(F.col("period").alias("p"), *[F.col(v) for v in values])
    known = series.select(F.col("period").alias("_d"), packed.alias("_s"))
    asked = events.select(F.col(date).cast("date").alias("_d")).distinct()
    both = asked.withColumn("_s", F.lit(None).cast(known.schema["_s"].dataType)).unionByName(known)
    # a constant partition: the rows are distinct calendar days and period starts
    by_day = W.partitionBy(F.lit(0)).orderBy("_d")
    matched = (
        both.withColumn("_b", F.last("_s", True).over(by_day.rangeBetween(W.unboundedPreceding, 0)))
        .withColumn("_f", F.first("_s", True).over(by_day.rangeBetween(0, W.unboundedFollowing)))
        .filter(F.col("_s").isNull())
        .withColumn(
            "_n",
            F.when(F.col("_b").isNull(), F.col("_f"))
            .when(F.col("_f").isNull(), F.col("_b"))
            .when(F.datediff("_d", "_b.p") <= F.datediff("_f.p", "_d"), F.col("_b"))
            .otherwise(F.col("_f")),
        )
        .select("_d", F.col("_n.p").alias("period"), *[F.col(f"_n.{v}").alias(v) for v in values])
    )
    return events.withColumn("_d", F.col(date).cast("date")).join(matched, "_d", "left").drop("_d")


# --- counts --------------------------------------------------------------------------------------


def combined_intervals(intervals: DataFrame, order: Sequence[str] = tuple(dims.STRICTNESS)) -> DataFrame:
    """(url, agent, from, until, status): the strictest status over a URL's agents, as intervals.

    Statuses count +1 where an interval begins and -1 where it ends; between two changes of a URL the
    strictest status with a positive count holds. A URL has at most one row per period.
    """
    change = lambda p, d: F.struct(p.alias("period"), F.lit(d).alias("_d"))
    deltas = (
        intervals.select("url", "status", F.inline(F.array(change(F.col("from"), 1), change(F.col("until"), -1))))
        .groupBy("url", "period")
        .agg(*[F.sum(F.when(F.col("status") == s, F.col("_d")).otherwise(0)).alias(f"_{i}") for i, s in enumerate(order)])
    )
    w = W.partitionBy("url").orderBy("period")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    held = [F.when(F.sum(f"_{i}").over(so_far) > 0, F.lit(s)) for i, s in enumerate(order)]
    swept = deltas.select(
        "url", F.lit(dims.COMBINED_AGENT).alias("agent"), F.col("period").alias("from"), F.lead("period").over(w).alias("until"), F.coalesce(*reversed(held)).alias("status")
    )
    return swept.filter("status IS NOT NULL AND until IS NOT NULL")


def counts_with_combined_agent(intervals: DataFrame, tokens: DataFrame, end: str, unit: str = "month") -> DataFrame:
    """Counts and tokens per (period, agent, status) over intervals, the combined agent included."""
    both = intervals.select("url", "agent", "from", "until", "status").unionByName(combined_intervals(intervals))
    weighted = both.join(tokens.select("url", "tokens"), "url", "left")
    return interval_counts(weighted, ["agent", "status"], end, unit, "tokens")


def transitions_from_changes(intervals: DataFrame, end: str, unit: str = "month") -> DataFrame:
    """(period, agent, before, after, urls) from status intervals, without the filled table.

    A change lies on the border of two intervals; inside an interval every period but its first repeats the status.
    """
    w = W.partitionBy("url", "agent").orderBy("from")
    marked = intervals.withColumn("_before", F.lag("status").over(w)).withColumn("_end", F.lag("until").over(w))
    borders = (
        marked.filter(F.col("_end") == F.col("from"))
        .groupBy(F.col("from").alias("period"), "agent", F.col("_before").alias("before"), F.col("status").alias("after"))
        .agg(F.count("*").alias("urls"))
    )
    inside = intervals.withColumn("from", (F.col("from") + F.expr(f"interval 1 {unit}")).cast("date")).filter(F.col("from") < F.col("until"))
    same = interval_counts(inside, ["agent", "status"], end, unit)
    same = same.select("period", "agent", F.col("status").alias("before"), F.col("status").alias("after"), F.col("count").alias("urls"))
    return borders.unionByName(same).groupBy("period", "agent", "before", "after").agg(F.sum("urls").alias("urls"))


def period_counts_from_changes(
    snapshots: DataFrame,
    sites: DataFrame,
    start: str,
    end: str,
    unit: str = "month",
    tokens: DataFrame | None = None,
    **options,
) -> DataFrame:
    """(period, agent, status, count, tokens) of :func:`fill_periods`, without the filled table; unknown URLs weigh 0 tokens."""
    intervals = status_intervals(snapshots, sites, start, end, unit, **options)
    if tokens is not None:
        intervals = intervals.join(tokens.select("url", "tokens"), "url", "left")
    return interval_counts(
        intervals, ["agent", "status"], end, unit, "tokens" if tokens is not None else None
    )


def status_shares(counts: DataFrame, value: str, statuses: Sequence[str]) -> DataFrame:
    """Share of each status per (agent, period); statuses without rows get 0."""
    sums = counts.groupBy("agent", "period").agg(
        F.sum(F.when(F.col("status").isin(list(statuses)), F.col(value))).alias("_all"),
        *[F.sum(F.when(F.col("status") == s, F.col(value)).otherwise(0)).alias(f"_{i}") for i, s in enumerate(statuses)],
    )
    entries = [
        F.struct(F.lit(s).alias("status"), F.try_divide(F.col(f"_{i}"), F.col("_all")).alias("share"))
        for i, s in enumerate(statuses)
    ]
    return sums.select("agent", "period", F.inline(F.array(*entries)))


def restricted_share(counts: DataFrame, restrictive: Sequence[str] = ("all",)) -> DataFrame:
    """Share of tokens under a restrictive status per (period, agent)."""
    hit = F.when(F.col("status").isin(list(restrictive)), F.col("tokens")).otherwise(0)
    return counts.groupBy("period", "agent").agg(
        F.try_divide(F.sum(hit), F.sum("tokens")).alias("share")
    )


def latest_statuses(snapshots: DataFrame, keys: Sequence[str], ts: str, status: str, tie: str | None = None) -> DataFrame:
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    return snapshots.groupBy(*keys).agg(F.max_by(status, order).alias("status"))


def latest_strictest(snapshots: DataFrame, agents: Sequence[str], ts: str = "snap_date") -> DataFrame:
    """(url, status): the strictest status over some agents at the URL's last snapshot date."""
    chosen = snapshots.filter(F.col("agent").isin(list(agents)))
    per_date = chosen.groupBy("url", ts).agg(F.max(robots.strictness(F.col("status"))).alias("_r"))
    return per_date.groupBy("url").agg(F.max_by("_r", ts).alias("_r")).select(
        "url", robots.status_at(F.greatest("_r", F.lit(1))).alias("status")
    )


def snapshot_profile(snapshots: DataFrame, ts: str) -> DataFrame:
    return snapshots.agg(
        F.count_distinct("url").alias("urls"), F.min(ts).alias("earliest"), F.max(ts).alias("latest")
    )


# --- restriction of whole corpora ----------------------------------------------------------------


def split_counts(
    intervals: DataFrame, members: DataFrame, tokens: DataFrame, end: str, unit: str = "month"
) -> DataFrame:
    """(split, service, period, agent, status, count, tokens) in one job.

    ``members`` is (url, split, service), a URL once per service it belongs to and once for 'all'.
    """
    weighted = intervals.join(members, "url").join(tokens.select("url", "tokens"), "url", "left")
    return interval_counts(weighted, ["split", "service", "agent", "status"], end, unit, "tokens")


def service_list(services: Column) -> Column:
    """The services of a URL by their column-safe names, and 'all'."""
    cleaned = F.transform(F.coalesce(services, F.array().cast("array<string>")), lambda s: F.translate(s, "/-", "__"))
    return F.array_distinct(F.array_append(cleaned, F.lit("all")))


def services_with_all(sites: DataFrame, services: str = "services") -> DataFrame:
    """(url, service) for each listed service and once for 'all'."""
    return sites.select(
        *[c for c in sites.columns if c != services], F.explode(service_list(F.col(services))).alias("service")
    )


def token_fractions(urls: DataFrame, total_tokens: Column) -> DataFrame:
    """(service, head_frac, rand_frac): part of the head's and of the remaining tokens in a service.

    ``urls`` is (url, split, services, tokens), one row per URL. For service 'all' the fractions are those of head and rest in
    the whole corpus.
    """
    tokens = F.coalesce("tokens", F.lit(0))
    sums = urls.select("split", tokens.alias("tokens"), F.explode(service_list(F.col("services"))).alias("service")).groupBy("service").agg(
        F.sum(F.when(F.col("split") == "head", F.col("tokens")).otherwise(0)).alias("_h"),
        F.sum(F.when(F.col("split") == "rand", F.col("tokens")).otherwise(0)).alias("_r"),
    )
    head = head_tokens(urls)
    rest = total_tokens - head
    whole = F.col("service") == "all"
    return sums.select(
        "service",
        F.when(whole, F.try_divide(head, total_tokens)).otherwise(F.try_divide(F.col("_h"), head)).alias("head_frac"),
        F.when(whole, F.try_divide(rest, total_tokens)).otherwise(F.try_divide(F.col("_r"), rest)).alias("rand_frac"),
    )


def head_tokens(urls: DataFrame) -> Column:
    return urls.filter("split = 'head'").agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()


def restriction_estimate(
    intervals: DataFrame,
    urls: DataFrame,
    total_tokens: Column,
    restrictive: Sequence[str],
    end: str,
    unit: str = "month",
) -> DataFrame:
    """Restricted part of a corpus per (service, period), from status intervals of head and random URLs.

    ``intervals`` carry split, services and tokens of ``urls`` (one row per URL). One aggregate over their change points yields the
    tokens of head and random sample and the restricted part of both; running totals give every period. ``random`` and ``head`` are
    restricted fractions, the portions weigh them by :func:`token_fractions`, and ``full_corpus`` adds the portions.
    Periods are those between the first and the last of the random sample; one without URLs has no values.
    """
    step = F.expr(f"interval 1 {unit}")
    last = F.date_trunc(unit, F.lit(end)).cast("date")
    restricted = F.col("status").isin(list(restrictive))
    change = lambda p, d: F.struct(p.alias("period"), F.lit(d).alias("_d"))
    changes = intervals.select(
        "split",
        restricted.alias("_hit"),
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("_w"),
        F.explode(service_list(F.col("services"))).alias("service"),
        F.array(change(F.col("from"), 1), change(F.col("until"), -1)).alias("_ends"),
    ).select("split", "_hit", "_w", "service", F.inline("_ends"))

    def part(split: str, measure: Column, only: Column = F.lit(True)) -> Column:
        return F.sum(F.when((F.col("split") == split) & only, F.col("_d") * measure).otherwise(0))

    deltas = changes.filter(F.col("period") <= last).groupBy("service", "period").agg(
        part("rand", F.col("_w"), F.col("_hit")).alias("_rr"),
        part("rand", F.col("_w")).alias("_ra"),
        part("head", F.col("_w"), F.col("_hit")).alias("_hr"),
        part("head", F.col("_w")).alias("_ha"),
        part("rand", F.lit(1)).alias("_rn"),
    )
    series = W.partitionBy("service")
    so_far = series.orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    until = F.coalesce((F.lead("period").over(series.orderBy("period")) - step).cast("date"), last)
    totals = deltas.select("service", "period", until.alias("_until"), *[F.sum(c).over(so_far).alias(c) for c in ("_rr", "_ra", "_hr", "_ha", "_rn")])
    sampled = F.col("_rn") > 0
    spanned = (
        totals.withColumn("_a", F.min(F.when(sampled, F.col("period"))).over(series))
        .withColumn("_b", F.max(F.when(sampled, F.col("_until"))).over(series))
        .withColumn("period", F.explode(F.sequence("period", "_until", step)))
        .filter(F.col("period").between(F.col("_a"), F.col("_b")))
    )
    joined = spanned.join(token_fractions(urls, total_tokens), "service")
    random, head = F.try_divide(F.col("_rr"), F.col("_ra")), F.try_divide(F.col("_hr"), F.col("_ha"))
    return joined.select(
        "service",
        "period",
        random.alias("random"),
        head.alias("head"),
        (F.col("rand_frac") * random).alias("rand_portion"),
        (F.col("head_frac") * head).alias("head_portion"),
        (F.col("rand_frac") * random + F.col("head_frac") * head).alias("full_corpus"),
    )


def estimates_long(estimates: DataFrame, keep: Sequence[str]) -> DataFrame:
    return estimates.unpivot(
        ["period", *keep], ["head", "full_corpus"], "measure", "value"
    )


def mean_over_corpora(estimates: DataFrame, names: DataFrame) -> DataFrame:
    """Mean full-corpus estimate per (period, service), services renamed by (member, group)."""
    renamed = estimates.join(
        names.select(F.col("member").alias("service"), F.col("group").alias("_name")), "service", "left"
    ).withColumn("service", F.coalesce("_name", "service"))
    return renamed.groupBy("period", "service").agg(F.avg("full_corpus").alias("full_corpus"))


# --- snapshots of pages --------------------------------------------------------------------------


def drop_adjacent_duplicates(snapshots: DataFrame, ts: str, digest: str, tie: str | None = None) -> DataFrame:
    """Snapshots whose digest differs from the one before at the same URL; range partitions cut URLs of any size."""
    order = [ts, tie] if tie else [ts]
    seen = windows.previous_row_ranged(snapshots, ["url"], order, {"_before": digest})
    return seen.filter(~F.col(digest).eqNullSafe(F.col("_before"))).drop("_before")


def first_per_interval(
    snapshots: DataFrame, ts: str, digest: str, frequency: str, tie: str | None = None
) -> DataFrame:
    """The first snapshot of each (URL, interval, digest)."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    row = F.struct(*[F.col(c) for c in snapshots.columns])
    return (
        snapshots.groupBy("url", dates.interval_start(F.col(ts), frequency).alias("interval"), digest)
        .agg(F.min_by(row, order).alias("_row"))
        .select("interval", "_row.*")
    )


def change_counts(
    snapshots: DataFrame, ts: str, digest: str, start: str, end: str, frequency: str = "monthly"
) -> DataFrame:
    """(url, interval, changes): distinct contents per interval, 0 where there is no snapshot."""
    unit = dates.INTERVALS[frequency][0]
    inside = snapshots.filter(
        (F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    )
    counted = (
        inside.select("url", dates.period_start(F.col(ts), unit).alias("interval"), digest)
        .distinct()
        .groupBy("url", "interval")
        .agg(F.count("*").alias("changes"))
    )
    grid = snapshots.select("url").distinct().select(
        "url",
        F.explode(dates.period_grid(F.lit(start).cast("date"), F.lit(end).cast("date"), unit)).alias("interval"),
    )
    return grid.join(counted, ["url", "interval"], "left").withColumn(
        "changes", F.coalesce("changes", F.lit(0))
    )


def unchanged_series(changes: DataFrame) -> DataFrame:
    """URLs whose counts are all zero."""
    return changes.groupBy("url").agg(F.max("changes").alias("m")).filter("m = 0").select("url")


def farthest_per_year(snapshots: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Snapshots on the first and the last date of each (keys, year)."""
    per_year = snapshots.withColumn("year", F.year(date))
    ends = per_year.groupBy(*keys, "year").agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return (
        per_year.join(ends, [*keys, "year"])
        .filter((F.col(date) == F.col("_a")) | (F.col(date) == F.col("_b")))
        .drop("_a", "_b")
    )


def monthly_normalised(events: DataFrame, date: str) -> DataFrame:
    """(year, month, count, per_month): counts over the number of months seen in the year."""
    counts = events.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.count("*").alias("count")
    )
    months = counts.groupBy("year").agg(F.count("*").alias("_m"))
    return counts.join(months, "year").select(
        "year", "month", "count", (F.col("count") / F.col("_m")).alias("per_month")
    )


def merge_last_values(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Repeated rows of a key merged field by field; later present values win."""
    return rows.groupBy(key).agg(
        *[
            F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(c)
            for c in columns
        ]
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables, incoming ones replacing current ones of the same key."""
    kept = current.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)
