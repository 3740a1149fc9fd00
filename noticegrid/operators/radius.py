"""Searches against places: the radius join and what is counted from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions import geo
from noticegrid.functions.places import place_key
from noticegrid.operators.common import DEAL, PAIRS_PER_TASK, first_per_key, keep_keys, ranked_rows, split_hot_join, whole_join
from noticegrid.session import stage

# Circles that a task lists under their cells.
CIRCLES_PER_TASK = 1_000
# Points that a task lists under the areas whose searches may reach them.
POINTS_PER_TASK = 10_000


def within_radius(searches: DataFrame, points: DataFrame, *, reach: Column | None = None, rows_per_task: int = 4_000,
                  by: Sequence[str] | None = None, whole: bool = False, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Every (search, point) pair not farther apart than the search's radius.

    The grid has several levels. A search is listed under the cells its circle may touch, on the level
    that suits its radius; a point is listed under its cell of each level some search uses. So the join is an equality
    on the cell with the exact distance as a residual condition, and what meets a search lies within half a
    radius of its circle, whatever the radius. Each pair meets in exactly one cell. ``reach`` replaces the radius.
    ``by`` deals the pairs by these columns, for a further join on them. ``whole`` makes all pairs of a search in one task, where its id is its own
    and its points are not too many, and says by the columns ``DEAL`` in which; else these columns are missing.
    """
    reach = F.col("radius").cast("double") if reach is None else reach
    apart = geo.haversine_mi("_clat", "_clon", "lat", "lon")
    if whole and (pairs := _whole(searches, points, reach)) is not None:
        # the difference of latitudes is a cheap first test
        beside = F.abs(F.col("lat") - F.col("_clat")) <= F.degrees(F.col("_reach") / vocab.EARTH_RADIUS_MI) + geo.EDGE
        return pairs.where(beside & (apart <= F.col("_reach"))).withColumn("distance_mi", apart).drop("_clat", "_clon", "_reach")
    celled, placed = by_cell(searches, points, reach)
    pairs = split_hot_join(placed, celled, ["_cell"], rows_per_task, pairs_per_task, where=apart <= F.col("_reach"), by=by)
    return pairs.withColumn("distance_mi", apart).drop("_cell", "_clat", "_clon", "_reach")


def _whole(searches: DataFrame, points: DataFrame, reach: Column) -> DataFrame | None:
    """The candidates of ``within_radius`` with all of a search in one task: a search lies in one area, a point in all areas whose searches may reach it."""
    if not searches.groupBy("search_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return None
    centres = _centres(searches, reach).withColumn("_level", F.least(geo.grid_level("_reach") + 1, F.lit(geo.COARSEST)))
    levels = centres.groupBy("_level").agg(F.max("_reach").alias("_most")).agg(F.collect_list(F.struct("_level", "_most"))).scalar()
    placed = points.where("lat is not null and lon is not null")
    tasks = placed.count() // POINTS_PER_TASK
    around = (placed.repartition(tasks) if tasks > 1 else placed).withColumn("_levels", levels).select(
        "*", F.inline("_levels"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon")).withColumnsRenamed({"_level": "_at_level", "_most": "_reach"})
    listed = geo.with_cells(around, F.col("_at_level")).withColumnRenamed("_cell", "_area").drop("_levels", "_at_level", "_clat", "_clon", "_reach")
    return whole_join(centres.withColumn("_area", geo.cell_of("_clat", "_clon", "_level")).drop("_level"), listed)


def _centres(searches: DataFrame, reach: Column) -> DataFrame:
    centres = (searches.withColumnsRenamed({"lat": "_clat", "lon": "_clon", "city": "centre_city", "state": "centre_state"})
               .withColumn("_reach", reach).where("_clat is not null and _clon is not null and _reach >= 0"))
    # a circle is up to a thousand cells, so a small table of circles is many tasks
    tasks = centres.count() // CIRCLES_PER_TASK
    return centres.repartition(tasks) if tasks > 1 else centres


def _under_cells(points: DataFrame, centres: DataFrame, level: Column) -> DataFrame:
    """The points under their cell of each level some centre uses."""
    levels = centres.agg(F.collect_set(level).alias("_levels")).scalar()
    return (points.where("lat is not null and lon is not null").withColumn("_levels", levels)
            .withColumn("_level", F.explode("_levels")).withColumn("_cell", geo.cell_of("lat", "lon", "_level"))
            .drop("_levels", "_level"))


def by_cell(searches: DataFrame, points: DataFrame, reach: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The searches under the cells their circles may touch, and the points under their cells of the levels in use."""
    centres = _centres(searches, F.col("radius").cast("double") if reach is None else reach)
    level = geo.grid_level("_reach")
    return geo.with_cells(centres, level), _under_cells(points, centres, level)


def counts_within(searches: DataFrame, points: DataFrame, keys: Sequence[str], finer: int = 2, rows_per_task: int = 4_000) -> DataFrame:
    """How many points lie in each search's circle (keys, n), without a row for every pair; no row where there are none.

    Points are counted per cell of a finer level. Cells wholly inside a circle bring their count; only
    in the cells on its edge are points met one by one. The searches' keys are distinct.
    """
    centres = _centres(searches.select(*keys, "lat", "lon", "radius"), F.col("radius").cast("double")).drop("radius")
    level = F.greatest(geo.grid_level("_reach") - finer, F.lit(geo.FINEST)).cast("int")
    # written: a filter on _inside would take its whole geometry along and work it out again for each use
    cells = stage(geo.with_cells(centres, level, inside=True), "circle-cells")
    placed = _under_cells(points.select("lat", "lon"), centres, level)
    per_cell = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    whole = cells.where("_inside").select(*keys, "_cell").join(per_cell, "_cell").select(*keys, "n")
    edge = split_hot_join(placed, cells.where("not _inside").drop("_inside"), ["_cell"], rows_per_task)
    near = edge.where(geo.haversine_mi("_clat", "_clon", "lat", "lon") <= F.col("_reach")).select(*keys, F.lit(1).cast("long").alias("n"))
    return whole.unionByName(near).groupBy(*keys).agg(F.sum("n").alias("n"))


def trusted(portals: DataFrame, max_fail: int = vocab.MAX_FAIL) -> DataFrame:
    return portals.where(F.coalesce(F.col("fail_count"), F.lit(0)) < max_fail)


def trusted_towns(gazetteer: DataFrame, portals: DataFrame) -> DataFrame:
    return keep_keys(gazetteer.withColumn("city_key", place_key("city", "state")), trusted(portals), ["city_key"])


def towns_in_reach(searches: DataFrame, gazetteer: DataFrame, portals: DataFrame,
                   exclude: DataFrame | None = None) -> DataFrame:
    """Towns with a trusted page inside each search's radius, minus (search, town) already covered."""
    towns = trusted_towns(gazetteer, portals)
    if exclude is None:
        return within_radius(searches, towns)
    # a search takes along, to each of its cells, what it leaves out there; so the pairs need not be shuffled to be told apart
    celled, placed = by_cell(searches, towns)
    covered = exclude.select("search_id", "city_key").distinct().join(placed.select("city_key", "_cell").distinct(), "city_key")
    lists = covered.groupBy("search_id", "_cell").agg(F.collect_set("city_key").alias("_covered"))
    known = stage(celled.join(lists, ["search_id", "_cell"], "left"), "covered-cells")
    apart = geo.haversine_mi("_clat", "_clon", "lat", "lon")
    fresh = ~F.coalesce(F.array_contains("_covered", F.col("city_key")), F.lit(False))
    pairs = split_hot_join(placed, known, ["_cell"], where=(apart <= F.col("_reach")) & fresh)
    return pairs.withColumn("distance_mi", apart).drop("_cell", "_clat", "_clon", "_reach", "_covered")


def nearest_k(near: DataFrame, k: int | None = None) -> DataFrame:
    """Places per search by distance, ties by name; the first k on request. Where all places of a search are in one task, they are ranked there."""
    order = [F.round("distance_mi", 6), F.col("city"), F.col("state")]
    if k is None and set(DEAL) <= set(near.columns):
        inside = Window.partitionBy(*DEAL, "search_id").orderBy(*order)
        return near.withColumn("rank", F.row_number().over(inside).cast("long")).drop(*DEAL)
    return ranked_rows(near, ["search_id"], order, k, "rank")


def nearest_first(searches: DataFrame, points: DataFrame, k: int, steps: int = 4) -> tuple[DataFrame, DataFrame]:
    """The first k places per search by distance, and how many there are in all (search_id, n).

    Circles of an eighth, a quarter and half the radius are counted along; a search meets the points of the smallest that holds k only.
    """
    rings = searches.select("search_id", "lat", "lon", F.posexplode(F.array(*[F.col("radius") / 2.0 ** i for i in range(steps)])).alias("step", "radius"))
    counts = stage(counts_within(rings, points, ["search_id", "step"]), "ring-counts")
    enough = counts.where(F.col("n") >= k).groupBy("search_id").agg(F.max("step").alias("_step"))
    small = searches.join(enough, "search_id", "left").withColumn("radius", F.col("radius") / F.pow(F.lit(2.0), F.coalesce("_step", F.lit(0)))).drop("_step")
    return nearest_k(within_radius(small, points), k), counts.where("step = 0").select("search_id", "n")


def coverage(searches: DataFrame, gazetteer: DataFrame, portals: DataFrame) -> DataFrame:
    """Trusted towns per search (radius held to 5..250) with the eight nearest names."""
    held = searches.withColumn("radius", F.greatest(F.lit(5.0), F.least(F.col("radius").cast("double"), F.lit(250.0))))
    first, counts = nearest_first(held, trusted_towns(gazetteer, portals), 8)
    label = F.struct("rank", F.concat_ws(", ", "city", "state").alias("label"))
    names = first.groupBy("search_id").agg(F.array_sort(F.collect_list(label)).alias("_l"))
    return held.select("search_id", F.col("radius").cast("int").alias("radius")).join(counts, "search_id", "left").join(names, "search_id", "left").select(
        "search_id", "radius", F.coalesce("n", F.lit(0)).alias("agencies"), F.array_join(F.transform("_l", lambda x: x["label"]), "; ").alias("nearest"))


def metro_reach(metros: DataFrame, gazetteer: DataFrame, portals: DataFrame,
                near_mi: int = 50, far_mi: int = 125) -> DataFrame:
    """Agencies within a short and a long radius of each metro, counted by cells, with its tier."""
    both = metros.select("search_id", "lat", "lon", F.explode(F.array(F.lit(near_mi), F.lit(far_mi))).alias("radius"))
    found = counts_within(both.withColumn("reach_mi", F.col("radius")), trusted_towns(gazetteer, portals), ["search_id", "reach_mi"])
    counts = found.groupBy("search_id").agg(
        F.sum(F.when(F.col("reach_mi") == near_mi, F.col("n"))).alias("within_near"), F.sum(F.when(F.col("reach_mi") == far_mi, F.col("n"))).alias("within_far"))
    near_n = F.coalesce("within_near", F.lit(0))
    return metros.select("search_id").join(counts, "search_id", "left").select(
        "search_id", near_n.alias("within_near"), F.coalesce("within_far", F.lit(0)).alias("within_far"),
        F.when(near_n >= 20, F.lit(1)).when(near_n >= 15, F.lit(2)).otherwise(F.lit(3)).alias("tier"))


def sample_points(searches: DataFrame) -> DataFrame:
    """Compass points to look at around a search that knows no town nearby."""
    rings = searches.withColumn("_p", F.explode(geo.ring_points("lat", "lon", "radius")))
    return rings.select("search_id", "_p.ring", "_p.idx", "_p.bearing", "_p.distance",
                        F.col("_p.point.lat").alias("lat"), F.col("_p.point.lon").alias("lon"))


def prune_hits_by_area(hits: DataFrame, searches: DataFrame, domain_towns: DataFrame,
                       gazetteer: DataFrame) -> DataFrame:
    """Search hits without those on a known domain outside the radius; unknown domains stay."""
    from noticegrid.functions.urls import host_of
    known = (domain_towns.join(gazetteer.select(place_key("city", "state").alias("city_key"), "lat", "lon"), "city_key")
             .select("host", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")))
    located = hits.withColumn("host", host_of("url")).join(known, "host", "left")
    centres = searches.select("search_id", F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), "radius")
    far = geo.haversine_mi("_clat", "_clon", "_lat", "_lon") > F.col("radius")
    return (located.join(centres, "search_id").where(~F.coalesce(far, F.lit(False)))
            .drop("_lat", "_lon", "_clat", "_clon", "radius"))


def area_reasons(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """Per search: hits in all, and hits on a known domain outside its area."""
    both = hits.groupBy("search_id").agg(F.count(F.lit(1)).alias("hits")).join(
        kept.groupBy("search_id").agg(F.count(F.lit(1)).alias("_kept")), "search_id", "left")
    return both.select("search_id", "hits", (F.col("hits") - F.coalesce("_kept", F.lit(0))).alias("search_hit_out_of_area"))


def nearby_lead_sources(searches: DataFrame, sources: DataFrame,
                        margin_mi: float = vocab.LEAD_MARGIN_MI) -> DataFrame:
    return within_radius(searches, sources, reach=F.col("radius").cast("double") + margin_mi)


def with_fallback_point(rows: DataFrame, zips: DataFrame) -> DataFrame:
    """Own coordinates, else those of the ZIP code, else none."""
    z = first_per_key(zips, ["zip"], [F.col("lat"), F.col("lon")]).select(
        "zip", F.col("lat").alias("_zlat"), F.col("lon").alias("_zlon"))
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return (rows.join(z, "zip", "left")
            .withColumn("lat", F.when(own, F.col("lat")).otherwise(F.col("_zlat")))
            .withColumn("lon", F.when(own, F.col("lon")).otherwise(F.col("_zlon")))
            .drop("_zlat", "_zlon"))


def leads_in_radius(offered: DataFrame, searches: DataFrame, leads: DataFrame, zips: DataFrame, lead_id: str) -> DataFrame:
    """Leads already offered to a search, (search_id, lead_id), kept when in range or when they cannot be placed.

    Each lead is located once, whatever the number of searches it is offered to.
    """
    centres = searches.select("search_id", F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), F.col("radius").alias("_reach"))
    located = offered.join(with_fallback_point(leads, zips), lead_id).join(centres, "search_id")
    distance = geo.haversine_mi("_clat", "_clon", "lat", "lon")
    return located.where(F.coalesce(distance <= F.col("_reach"), F.lit(True))).drop("_clat", "_clon", "_reach")
