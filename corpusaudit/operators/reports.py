"""Cross-tabulations, shares, top lists, bins and collection tables.

Reports aggregate first and compute shares, ranks and pivots on the small result. Where NULL group
keys would appear they are dropped, as in the tables these reports reproduce.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit.functions import text as tx
from corpusaudit.functions import windows
from corpusaudit.session import ensure_checkpoint_dir


def counts(df: DataFrame, keys: Sequence[str], measure: str | None = None, out: str = "count") -> DataFrame:
    """Rows (or the sum of ``measure``) per key, NULL keys dropped."""
    value = F.count("*") if measure is None else F.coalesce(F.sum(measure), F.lit(0))
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(value.alias(out))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value, largest first, ties by value."""
    counted = windows.share_of_total(counts(df, [column]), "count", [], "pct")
    return counted.withColumn("pct", 100 * F.col("pct")).orderBy(F.desc("count"), column)


def counts_with_share(
    df: DataFrame, group: Sequence[str], label: str, measure: str | None = None
) -> DataFrame:
    """(group, label, count, pct): percentage of the label inside its group."""
    counted = counts(df, [*group, label], measure)
    return windows.share_of_total(counted, "count", list(group), "pct").withColumn(
        "pct", 100 * F.col("pct")
    )


def modality_measure(modality: Column, hours: Column, tokens: Column, timed: Sequence[str] = ("Speech", "Video")) -> Column:
    """Hours for timed media, tokens for text."""
    return F.when(modality.isin(list(timed)), hours).otherwise(tokens)


def counts_by_label(df: DataFrame, key: str, label: str, labels: Sequence[str]) -> DataFrame:
    """One row per key, one count column per label."""
    return df.groupBy(key).agg(*[F.count_if(F.col(label) == v).alias(v) for v in labels])


def crosstab(df: DataFrame, row: str, column: str, labels: Sequence[str], measure: str | None = None) -> DataFrame:
    """Row-normalised cross table in long form with every (row, label) pair present."""
    sums = counts(df, [row, column], measure, "value")
    return normalise_rows(complete_grid(sums, row, column, labels, "value"), row, "value")


def complete_grid(sums: DataFrame, row: str, column: str, labels: Sequence[str], value: str) -> DataFrame:
    """All rows times a fixed list of labels, missing cells 0."""
    grid = sums.select(row).distinct().select(
        row, F.explode(F.array(*[F.lit(v) for v in labels])).alias(column)
    )
    return grid.join(sums, [row, column], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def normalise_rows(long: DataFrame, row: str, value: str) -> DataFrame:
    return windows.share_of_total(long, value, [row], "share")


def cube_totals(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts per pair with row, column and grand totals; totals are labelled 'Total'."""
    label = lambda c: F.when(F.grouping(c) == 1, F.lit("Total")).otherwise(F.col(c))
    return (
        df.dropna(subset=[first, second])
        .cube(first, second)
        .agg(
            label(first).alias("_a"),
            label(second).alias("_b"),
            F.count("*").alias("count"),
        )
        .select(F.col("_a").alias(first), F.col("_b").alias(second), "count")
    )


def contingency(df: DataFrame, first: str, second: str, weight: str) -> DataFrame:
    """Counts and weights per pair with percentages of all counts and all weights."""
    cells = df.groupBy(first, second).agg(
        F.count("*").alias("count"), F.coalesce(F.sum(weight), F.lit(0)).alias("tokens")
    )
    total = cells.agg(F.struct(F.sum("count").alias("n"), F.sum("tokens").alias("t")).alias("s")).scalar()
    return cells.select(
        first,
        second,
        "count",
        "tokens",
        F.round(100 * F.try_divide(F.col("count"), total["n"]), 2).alias("pct"),
        F.round(100 * F.try_divide(F.col("tokens"), total["t"]), 2).alias("pct_tokens"),
    )


def conditional_pairs(statuses: DataFrame, group: str, restricted: Column, members: Sequence[str]) -> DataFrame:
    """P(second restricted | first restricted) over URLs, for ordered pairs of a fixed list of groups.

    One flag per group and URL replaces the self-join, so a URL is one row.
    """
    flags = statuses.groupBy("url").agg(
        *[F.bool_or(F.when(F.col(group) == m, restricted)).alias(f"m{i}") for i, m in enumerate(members)]
    )
    pairs = [(i, j) for i in range(len(members)) for j in range(len(members)) if i != j]
    sums = flags.agg(
        *[F.count_if(F.col(f"m{i}") & F.col(f"m{j}").isNotNull()).alias(f"a_{i}_{j}") for i, j in pairs],
        *[F.count_if(F.col(f"m{i}") & F.col(f"m{j}")).alias(f"b_{i}_{j}") for i, j in pairs],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(members[i]).alias("first"),
                F.lit(members[j]).alias("second"),
                F.col(f"a_{i}_{j}").alias("given"),
                F.col(f"b_{i}_{j}").alias("both"),
            )
            for i, j in pairs
        ]
    )
    return sums.select(F.inline(entries)).withColumn(
        "probability", F.try_divide(F.col("both"), F.col("given"))
    )


def area_shares(rows: DataFrame, modality: str, areas: str, size: str) -> DataFrame:
    """(modality, area, count, size, pct_count, pct_size): datasets and their size per area of a modality.

    ``areas`` is a list; a dataset counts once in each of its areas.
    """
    cells = (
        rows.select(modality, F.explode(areas).alias("area"), size)
        .dropna(subset=["area"])
        .groupBy(modality, "area")
        .agg(F.count("*").alias("count"), F.coalesce(F.sum(size), F.lit(0)).alias("size"))
    )
    by_count = windows.share_of_total(cells, "count", [modality], "pct_count")
    both = windows.share_of_total(by_count, "size", [modality], "pct_size")
    return both.withColumns({c: F.round(100 * F.col(c), 1) for c in ("pct_count", "pct_size")})


def group_tags(df: DataFrame, group: str, values: str, dictionary: DataFrame) -> DataFrame:
    """(group, tags): distinct mapped values over all rows of a group, de-duplicated as rows."""
    return (
        df.select(group, F.explode(values).alias("member"))
        .join(dictionary.select("member", F.col("group").alias("_tag")), "member", "left")
        .select(group, F.coalesce("_tag", "member").alias("_tag"))
        .distinct()
        .groupBy(group)
        .agg(F.sort_array(F.collect_set("_tag")).alias("tags"))
    )


# --- top lists -----------------------------------------------------------------------------------


def top_or_other(df: DataFrame, column: str, k: int, measure: str | None = None, other: str = "Other") -> DataFrame:
    """Replace values outside the ``k`` most frequent (or largest by measure) with one label."""
    ranked = counts(df, [column], measure).orderBy(F.desc("count"), column).limit(k)
    keep = ranked.select(column, F.lit(True).alias("_kept"))
    return (
        df.join(keep, column, "left")
        .withColumn(column, F.when(F.col("_kept"), F.col(column)).otherwise(F.lit(other)))
        .drop("_kept")
    )


def extremes(df: DataFrame, order: Sequence[Column], reverse: Sequence[Column], n: int) -> DataFrame:
    """The first and the last ``n`` rows of an order, each row once."""
    first = df.orderBy(*order).limit(n)
    last = df.orderBy(*reverse).limit(n)
    return first.unionByName(last).distinct()


def expand_lists(df: DataFrame, columns: Sequence[str], plain_again: Sequence[str] = ()) -> DataFrame:
    """Every combination of the items of several list-literal columns, one row each, without remarks in parentheses.

    Any text that is no list is its own item; a NULL stays one NULL; a row with an empty list has no combination. The lists are expanded
    one after the other inside the row, so nothing is shuffled. Rows of which no column of ``plain_again`` is a list come once more, as they
    are (the published table counts them twice).
    """
    out = df
    for c in columns:
        items = F.transform(tx.list_literal(F.col(c)), tx.without_parentheses)
        out = out.withColumn(c, F.explode(items))
    if not plain_again:
        return out
    listed = [F.coalesce(tx.is_list_literal(F.col(c)), F.lit(False)) for c in plain_again]
    return out.unionByName(df.filter(~F.greatest(*listed, F.lit(False))))


def expanded_counts(df: DataFrame, columns: Sequence[str], plain_again: Sequence[str] = ()) -> DataFrame:
    """(column, item, count): how often each item stands in the rows of :func:`expand_lists`.

    The combinations are not built: an item counts as often as the other lists of its row have combinations. One scan, one aggregate.
    """
    lists = {c: F.transform(tx.list_literal(F.col(c)), tx.without_parentheses) for c in columns}
    rows = df.select(*[v.alias(c) for c, v in lists.items()], F.struct(*[F.col(c) for c in columns]).alias("_raw"))
    size = {c: F.size(c).cast("bigint") for c in columns}

    def entry(name: str, item: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), item.alias("item"), n.alias("n"))

    def weighted(name: str) -> Column:
        others = reduce(lambda a, b: a * b, [size[o] for o in columns if o != name], F.lit(1).cast("bigint"))
        return F.transform(name, lambda x: entry(name, x, others))

    entries = [weighted(c) for c in columns]
    if plain_again:
        plain = ~F.greatest(*[F.coalesce(tx.is_list_literal(F.col(f"_raw.{c}")), F.lit(False)) for c in plain_again], F.lit(False))
        again = F.array(*[entry(c, F.col(f"_raw.{c}"), F.lit(1).cast("bigint")) for c in columns])
        entries.append(F.when(plain, again).otherwise(F.slice(again, 1, 0)))
    counted = rows.select(F.inline(F.concat(*entries))).filter("n > 0")
    return counted.groupBy("column", "item").agg(F.sum("n").alias("count"))


def in_order(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows sorted by a fixed order of labels, unknown ones last."""
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(column))
    return df.orderBy(F.when(position == 0, len(labels) + 1).otherwise(position), column)


def by_last_point(series: DataFrame, name: str, period: str, value: str) -> DataFrame:
    """Series names by their value at the last period, largest first."""
    return (
        series.groupBy(name)
        .agg(F.max_by(value, period).alias("last_value"))
        .orderBy(F.desc("last_value"), name)
    )


def group_permissiveness(df: DataFrame, group: str, label: str, permissive: Sequence[str]) -> DataFrame:
    """Share of permissive labels per group, least permissive first."""
    return (
        df.dropna(subset=[group])
        .groupBy(group)
        .agg(F.avg(F.coalesce(F.col(label).isin(list(permissive)), F.lit(False)).cast("int")).alias("share"))
        .orderBy("share", group)
    )


def label_shares_extremes(
    df: DataFrame, group: str, label: str, labels: Sequence[str], n: int = 8
) -> DataFrame:
    """Counts per group and label; the ``n`` groups with the largest and smallest share of the first label."""
    wide = counts_by_label(df.dropna(subset=[group]), group, label, labels)
    total = sum((F.col(v) for v in labels[1:]), F.col(labels[0]))
    shares = wide.withColumn("total", total).filter("total > 0").withColumn(
        "first_share", F.col(labels[0]) / F.col("total")
    )
    return extremes(
        shares, [F.desc("first_share"), F.asc(group)], [F.asc("first_share"), F.desc(group)], n
    )


def first_by_class(df: DataFrame, name: str, order: Column) -> DataFrame:
    """One row per name, the first in the order. An aggregate, so repeated names combine map-side."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(name).agg(F.min_by(row, order).alias("_row")).select("_row.*")


# --- bins and measures ---------------------------------------------------------------------------


def size_bucket(value: Column, bounds: Sequence[int | None]) -> Column:
    """Label ``low-high`` of the left-closed bin; NULL outside all bins. A last None is open-ended."""
    out = None
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        inside = (value >= low) if high is None else ((value >= low) & (value < high))
        label = F.lit(f"{low}-" if high is None else f"{low}-{high}")
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def bin_counts(df: DataFrame, value: Column, bounds: Sequence[int | None], by: Column | None = None) -> DataFrame:
    """(bin, count) with empty bins; ``by`` counts distinct values (e.g. collections) instead of rows."""
    labels = [f"{a}-" if b is None else f"{a}-{b}" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    rows = df.select(size_bucket(value, bounds).alias("bin"), (F.lit(1) if by is None else by).alias("_k"))
    if by is not None:
        rows = rows.distinct()
    counted = rows.agg(*[F.count_if(F.col("bin") == v).alias(f"b{i}") for i, v in enumerate(labels)])
    entries = [F.struct(F.lit(v).alias("bin"), F.col(f"b{i}").alias("count")) for i, v in enumerate(labels)]
    return counted.select(F.inline(F.array(*entries)))


def split_measure(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """``value`` divided by the number of rows of its group; counts are aggregated and joined back."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    return df.join(sizes, list(group), "left").withColumn(out, F.col(value) / F.col("_n")).drop("_n")


def midpoints(shares: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Middle of each segment of a stacked bar. Groups hold one row per label."""
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return shares.withColumn(
        "midpoint", F.coalesce(F.sum(value).over(before), F.lit(0)) + F.col(value) / 2
    )


def most_restrictive_in_group(df: DataFrame, group: str, label: str, order: Sequence[str]) -> DataFrame:
    """Give every row of a group the group's earliest label of the order (aggregate, then join back)."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(label))
    best = df.groupBy(group).agg(F.min(F.when(rank > 0, rank)).alias("_r"))
    name = F.get(F.array(*[F.lit(v) for v in order]), (F.col("_r") - 1).cast("int"))
    return df.drop(label).join(best, group, "left").withColumn(label, name).drop("_r")


def most_common_in_group(df: DataFrame, group: str, label: str) -> DataFrame:
    """Give every row of a group the group's most frequent label, ties by label."""
    tops = counts(df, [group, label]).groupBy(group).agg(
        F.min_by(label, F.struct(-F.col("count"), F.col(label))).alias("_l")
    )
    return df.drop(label).join(tops, group, "left").withColumnRenamed("_l", label)


def restrictive_label(df: DataFrame, group: str, label: str, order: Sequence[str]) -> DataFrame:
    """(group, label) with the earliest label of the order."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(label))
    return df.groupBy(group).agg(F.min_by(label, F.when(rank > 0, rank)).alias(label))


# --- collections ---------------------------------------------------------------------------------


def distinct_list(df: DataFrame, group: str, lists: Sequence[str]) -> DataFrame:
    """Number of distinct values of each list column per group; values are de-duplicated as rows."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("items")) for c in lists])
    pairs = (
        df.select(group, F.inline(fields))
        .select(group, "field", F.explode("items").alias("item"))
        .distinct()
    )
    return pairs.groupBy(group).agg(
        *[F.count_if(F.col("field") == c).alias(f"n_{c}") for c in lists]
    )


def collection_table(
    catalog: DataFrame, lists: Sequence[str], uses: Sequence[str], use: str, year: str
) -> DataFrame:
    """One row per collection: datasets, distinct list values, year or 'Mult.', use flags, synthetic share."""
    generated = (F.coalesce(F.size("model_generated"), F.lit(0)) > 0).cast("int")
    base = catalog.groupBy("collection").agg(
        F.count("*").alias("datasets"),
        F.when(F.min(year) == F.max(year), F.min(year).cast("string")).otherwise("Mult.").alias("year"),
        *[F.bool_or(F.col(use) == u).alias(f"has_{u.replace('-', '_')}") for u in uses],
        F.when(F.avg(generated) == 1, "all")
        .when(F.avg(generated) > 0, "some")
        .otherwise("none")
        .alias("synthetic"),
    )
    sizes = distinct_list(catalog, "collection", lists)
    return base.join(sizes, "collection", "left").fillna(0, [f"n_{c}" for c in lists])


def weighted_means(catalog: DataFrame, group: str, weight: str, values: Sequence[str]) -> DataFrame:
    return catalog.groupBy(group).agg(
        *[
            F.try_divide(F.sum(F.col(weight) * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))).alias(v)
            for v in values
        ]
    )


def license_list(pairs: DataFrame, group: str, drop: Sequence[str] = (), many: int = 3) -> DataFrame:
    """(group, licenses, label): all names joined; the label is 'Various' for more than ``many``, 'Unspecified' for none.

    Names are de-duplicated before they are collected; a list has at most as many as there are licenses.
    """
    named = pairs.select(group, F.when(~F.col("license").isin(list(drop)), F.col("license")).alias("license")).distinct()
    listed = named.filter("license IS NOT NULL").groupBy(group).agg(F.sort_array(F.collect_list("license")).alias("_l"))
    label = (
        F.when(F.col("_l").isNull(), "Unspecified")
        .when(F.size("_l") > many, "Various")
        .otherwise(F.array_join("_l", ", "))
    )
    names = F.coalesce(F.array_join("_l", ", "), F.lit(""))
    return pairs.select(group).distinct().join(listed, group, "left").select(group, names.alias("licenses"), label.alias("label"))


def license_frequency(pairs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Most used licenses, each name counted once per dataset name, with their classes."""
    used = pairs.select("name", "license").distinct().groupBy("license").agg(F.count("*").alias("count"))
    return used.join(classes, "license", "left").orderBy(F.desc("count"), "license").limit(n)


def flag_requirements(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Percentage of (name, license) pairs that ask for attribution and for share-alike."""
    rows = pairs.select("name", "license").distinct().join(classes, "license")
    asks = lambda c: F.round(100 * F.avg(F.when(F.col(c) == "0", 0).otherwise(1)), 2)
    return rows.agg(
        asks("attribution").alias("pct_attribution"), asks("share_alike").alias("pct_share_alike")
    )


def key_statistics(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    """(field, distinct values) over exploded list columns."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("items")) for c in lists])
    rows = df.select(F.inline(fields)).select("field", F.explode("items").alias("item"))
    return rows.distinct().groupBy("field").agg(F.count("*").alias("values"))


def language_kinds(codes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Distinct natural and programming languages; ``dimension`` is (code, language, kind)."""
    return (
        codes.join(dimension, "code", "left")
        .select(F.coalesce("language", "code").alias("language"), F.coalesce("kind", F.lit("natural")).alias("kind"))
        .distinct()
        .groupBy("kind")
        .agg(F.count("*").alias("languages"))
    )


def expand_members(df: DataFrame, key: str, column: str, dimension: DataFrame) -> DataFrame:
    """(key, ids): every name of a list becomes its ids (one name may have several)."""
    return (
        df.select(key, F.explode(column).alias("member"))
        .join(dimension.select("member", F.col("group").alias("_id")), "member")
        .select(key, "_id")
        .distinct()
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("_id")).alias("ids"))
    )


def one_hot(df: DataFrame, key: str, column: str, labels: Sequence[str], prefix: str) -> DataFrame:
    return df.select(
        key, *[F.array_contains(column, v).alias(f"{prefix}{v}") for v in labels]
    )


# --- joins ---------------------------------------------------------------------------------------


def outer_on_key(key: str, *parts: DataFrame) -> DataFrame:
    """Full outer join of several tables on one key column."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "outer")
    return out


def profile(key: str, *parts: DataFrame) -> DataFrame:
    """Union of all keys with each table's columns joined to it."""
    keys = parts[0].select(key)
    for part in parts[1:]:
        keys = keys.unionByName(part.select(key))
    out = keys.distinct()
    for part in parts:
        out = out.join(part, key, "left")
    return out


def stack_modalities(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of catalogs with different columns, each tagged with its modality."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("modality", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def split_keys(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row per key of an ``a|b|c`` list."""
    return df.select(
        *[c for c in df.columns if c != column], F.explode(F.split(column, "[|]")).alias(out)
    )


def top_ancestor(parents: DataFrame) -> DataFrame:
    """(member, top) for a table (member, parent): the last ancestor of every member.

    Each round replaces the parent by the parent's parent, so chains of length ``n`` take ``log2(n)``
    rounds. A round is written to the checkpoint folder, which keeps the plan from doubling. A chain cannot be
    longer than the table, so pointers that still move after log2(rows) rounds run in a circle: an error.
    """
    ensure_checkpoint_dir(parents.sparkSession)
    current = parents.select("member", F.coalesce("parent", "member").alias("top")).checkpoint()
    for _ in range(current.count().bit_length() + 2):
        up = current.select(F.col("member").alias("top"), F.col("top").alias("_next"))
        moved = (
            current.join(up, "top", "left")
            .select("member", F.coalesce("_next", "top").alias("_to"), "top")
            .checkpoint()
        )
        current = moved.select("member", F.col("_to").alias("top"))
        if moved.filter("_to <> top").isEmpty():
            return current
    raise ValueError("a member is its own ancestor")


def override_values(even: DataFrame, overrides: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values of a side table where it has the key, else the given ones."""
    side = overrides.select(*keys, F.col(value).alias("_v"))
    return even.join(side, list(keys), "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def range_lookup(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Join each point to the ranges that contain it (whole numbers), by buckets of a width that suits the range.

    The class of a range is the number of bits of its width, its buckets are 2**class wide, so it touches two at most
    however wide it is. Distinct points are tried once per class that occurs (at most 64). Points outside all
    ranges keep NULLs.
    """
    bits = F.length(F.bin(F.col(high).cast("bigint") - F.col(low).cast("bigint")))
    bucket = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), _k)")
    cells = ranges.filter(F.col(low) <= F.col(high)).withColumn("_k", bits)
    classes = cells.agg(F.collect_set("_k").alias("k")).scalar()
    cells = cells.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(low), bucket(high)))))
    tried = points.select(point).distinct().withColumn("_k", F.explode(classes)).withColumn("_bucket", bucket(point))
    hits = tried.join(
        cells,
        (tried["_k"] == cells["_k"]) & (tried["_bucket"] == cells["_bucket"]) & F.col(point).between(F.col(low), F.col(high)),
    ).drop("_bucket", "_k")
    return points.join(hits, point, "left")


def first_variant(wanted: DataFrame, known: DataFrame, variants: Column, key: str) -> DataFrame:
    """Match each row by the first of its alternative keys that exists.

    ``variants`` is an array of (variant, priority); ``known`` has column ``variant``.
    """
    tried = wanted.select(key, F.inline(variants))
    return (
        tried.join(known, "variant")
        .groupBy(key)
        .agg(F.min_by(F.struct("variant", "priority", *[c for c in known.columns if c != "variant"]), "priority").alias("_m"))
        .select(key, "_m.*")
    )
