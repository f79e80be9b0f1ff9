"""Open-data records: which district they belong to, coordinates, reference box, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.geo import plausible, with_wgs84
from terrasift.functions.text import split_list

MARGIN_DEG, LEAST_POINTS = 0.015, 4
SUFFIXES = ("區", "市", "鎮", "鄉")


def district_forms(districts: DataFrame) -> DataFrame:
    """Ways in which a district field may name each district: ``district, form, full``."""
    bare = F.expr("left(district, length(district) - 1)")
    full = [F.struct(F.concat(bare, F.lit(s)).alias("form"), F.lit(True).alias("full")) for s in SUFFIXES]
    return districts.select("district").distinct().select("district", F.inline(F.array(*full, F.struct(bare.alias("form"), F.lit(False).alias("full")))))


def match_district(rows: DataFrame, key: list[str], field: str, address: str, name: str, district: str, all_districts: DataFrame, loose: Column | None = None) -> DataFrame:
    """``rows`` with ``match_basis`` for one district: district_field, address, name_keyword or null.

    A district field that names another district rules the row out, whatever its
    address says. A full form may be the beginning of a field's part, the short form
    only the whole part. ``all_districts`` (column district) is a small closed list.
    """
    bare = district[:-1]
    own = [bare, *[bare + s for s in SUFFIXES]]
    parts = F.coalesce(split_list(F.col(field)), F.array().cast("array<string>"))
    forms = district_forms(all_districts).agg(F.collect_set("form").alias("forms"), F.collect_set(F.when(F.col("full"), F.col("form"))).alias("prefixes"))
    mine = F.exists(parts, lambda p: p.isin(*own) | _any_prefix(p, own[1:]))
    declared = F.exists(parts, lambda p: F.array_contains("forms", p) | F.exists("prefixes", lambda f: p.startswith(f)))
    by_address = F.coalesce(F.col(address).rlike(f"\\Q{bare}\\E[{''.join(SUFFIXES)}]"), F.lit(False))
    by_name = F.coalesce(F.col(name).contains(bare), F.lit(False)) & (loose if loose is not None else F.lit(True))
    basis = F.when(mine, "district_field").when(declared, F.lit(None)).when(by_address, "address").when(by_name, "name_keyword")
    return rows.crossJoin(F.broadcast(forms)).withColumn("match_basis", basis).drop("forms", "prefixes")


def match_districts(rows: DataFrame, key: list[str], field: str, address: str, name: str, districts: DataFrame) -> DataFrame:
    """``key, district, match_basis``: every district that a row belongs to, by the rules of ``match_district``.

    All districts at once: the pieces of a row's texts that may be a form of a district
    (as long as one and, but for names, ending in a district word) meet the forms in
    joins, so the work follows the texts and not rows times districts.
    """
    forms = district_forms(districts).select("district", "form", "full", F.length("form").alias("n"))
    sizes = forms.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    base = rows.select(*key, field, address, name).join(F.broadcast(sizes))  # one row

    def pieces(text: Column, at: Column) -> Column:
        """Parts of ``text`` from ``at`` (from 1) as long as some form."""
        return F.transform(F.sequence(F.col("least"), F.col("most")), lambda n: F.substr(text, at, n))

    def anywhere(text: Column) -> Column:
        places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
        return F.array_distinct(F.flatten(F.transform(places, lambda i: pieces(text, i))))

    parts = base.select(*key, "least", "most", F.explode(split_list(F.col(field))).alias("part"))
    begun = parts.select(*key, "part", F.explode(F.array_distinct(F.concat(F.array("part"), pieces(F.col("part"), F.lit(1))))).alias("form"))
    declared = begun.join(forms, "form").where("full or form = part").select(*key, "district").distinct()
    open_rows = base.join(declared.select(*key).distinct(), key, "left_anti")
    by_address = open_rows.select(*key, F.explode(anywhere(F.col(address))).alias("form")).join(forms.where("full"), "form").select(*key, "district", F.lit(1).alias("rank"))
    by_name = open_rows.select(*key, F.explode(anywhere(F.col(name))).alias("form")).join(forms.where("not full"), "form").select(*key, "district", F.lit(2).alias("rank"))
    found = declared.withColumn("rank", F.lit(0)).unionByName(by_address).unionByName(by_name).groupBy(*key, "district").agg(F.min("rank").alias("rank"))
    return found.select(*key, "district", F.element_at(F.array(*map(F.lit, ("district_field", "address", "name_keyword"))), F.col("rank") + 1).alias("match_basis"))


def _any_prefix(p: Column, forms: list[str]) -> Column:
    out = F.lit(False)
    for f in forms:
        out = out | p.startswith(f)
    return out


def with_coordinates(df: DataFrame, lon: Column, lat: Column, x: Column, y: Column, name: str) -> DataFrame:
    """``df`` with ``name``: struct<lon, lat, source>, the given coordinates if plausible, else the grid ones converted if plausible."""
    grid = F.col("_grid")
    found = (
        F.when(plausible(lon, lat), F.struct(lon.alias("lon"), lat.alias("lat"), F.lit("dataset_wgs84").alias("source")))
        .when(plausible(grid["lon"], grid["lat"]), F.struct(grid["lon"].alias("lon"), grid["lat"].alias("lat"), F.lit("twd97_converted").alias("source")))
        .otherwise(F.struct(F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("string").alias("source")))
    )
    return with_wgs84(df, x, y, "_grid").withColumn(name, found).drop("_grid")


def rank_value(points: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """Nearest-rank percentile by counts per distinct value, so that no group is gathered."""
    counts = points.groupBy(*group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*group).orderBy(value)
    ranked = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(*group))})
    rank = F.bround(F.lit(q) * (F.col("n") - 1), 0)
    return ranked.where((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)).select(*group, F.col(value).alias(name))


def reference_box(points: DataFrame, group: list[str], lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Per group the box of the 2nd to 98th percentile (nearest rank) of plausible points, widened; none below four points."""
    usable = points.where(plausible(F.col(lon), F.col(lat)))
    out = usable.groupBy(*group).agg(F.count("*").alias("n_points"))
    for name, col, q, sign in (("min_lon", lon, 0.02, -1), ("max_lon", lon, 0.98, 1), ("min_lat", lat, 0.02, -1), ("max_lat", lat, 0.98, 1)):
        side = rank_value(usable, group, col, q, name).withColumn(name, F.col(name) + sign * MARGIN_DEG)
        out = out.join(side, group)
    return out.where(F.col("n_points") >= LEAST_POINTS)


def adjudicate(rows: DataFrame, boxes: DataFrame, group: list[str], lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Loose matches against their group's box: ``verdict`` kept, unverified (no coordinates or no box) or rejected."""
    j = rows.join(boxes, group, "left")
    known = plausible(F.col(lon), F.col(lat)) & F.col("min_lon").isNotNull()
    within = F.col(lon).between(F.col("min_lon"), F.col("max_lon")) & F.col(lat).between(F.col("min_lat"), F.col("max_lat"))
    return j.withColumn("verdict", F.when(~known, "unverified").when(within, "kept").otherwise("rejected")).drop("min_lon", "max_lon", "min_lat", "max_lat", "n_points")


def slot_report(records: DataFrame, sources: DataFrame, survey_only: DataFrame) -> DataFrame:
    """Per (factor, item): records, sources, status, and whether a survey on site is needed.

    ``records``: factor, item. ``sources``: factor, item, status. ``survey_only``: factor, item, category.
    """
    slot = ["factor", "item"]
    r = records.groupBy(*slot).agg(F.count("*").alias("record_count"))
    s = sources.groupBy(*slot).agg(F.collect_set("status").alias("statuses"), F.count("*").alias("source_count"))
    g = survey_only.groupBy(*slot).agg(F.count("*").alias("gap_count"))
    j = s.join(r, slot, "full").join(g, slot, "full")
    n, st = F.coalesce("record_count", F.lit(0)), F.coalesce("statuses", F.array().cast("array<string>"))
    has = lambda x: F.array_contains(st, x)
    status = (
        F.when(n > 0, "ok").when(F.size(st) == 0, "no_open_data_source").when((F.size(st) == 1) & has("skipped_heavy"), "skipped_heavy")
        .when(has("error") & ~has("ok") & ~has("no_district_matches"), "error").otherwise("no_district_matches")
    )
    return j.select(
        *slot, n.alias("record_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"), status.alias("status"),
        ((n == 0) | F.col("gap_count").isNotNull() | has("error") | has("skipped_heavy")).alias("survey_required"),
    )


def source_shares(rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``source_key, n, with_address, share`` of every source, or of those that a plan names (none if it names none)."""
    held = rows if only is None else rows.where(F.col("source_key").isin(*only) if only else F.lit(False))
    g = held.groupBy("source_key").agg(F.count("*").alias("n"), F.count("address").alias("with_address"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("source_key", "n", "with_address", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def required_keys(rows: DataFrame, group: list[str], row: str, keys: list[str]) -> DataFrame:
    """Per source whether every row (map<string,string>) has all required keys."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.map_contains_key(row, k)
    return rows.groupBy(*group).agg(F.count("*").alias("n_rows"), F.bool_and(ok).alias("complete"))
