"""Where a bid is: name correction, candidate states, gazetteer look-up, fallback rules.

Everything that needs a join runs on distinct names; only the answer meets the bid rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import places
from noticegrid.functions.text import collapse, text
from noticegrid.operators.directory import states_for_org
from noticegrid.session import stage

NAME_KEY = ["_city", "_stated", "_dcity", "_dstate", "_cstate"]


def _variants(c):
    """A name and every form of it with one character left out."""
    return F.array_distinct(F.concat(
        F.array(F.col(c)),
        F.transform(F.sequence(F.lit(1), F.length(c)),
                    lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))))


def snap_city(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(city, state, snapped) for unknown names with exactly one known town one edit away.

    Names one edit apart share a form with at most one character left out, so candidates
    come from an equality join on (state, form).
    """
    known = gazetteer.select(F.lower("city").alias("_low"), F.col("city").alias("_canon"), F.upper("state").alias("state"))
    asked = (names.select(F.trim(text("city")).alias("city"), F.upper(F.trim(text("state"))).alias("state"))
             .where("city <> '' and state <> ''").distinct().withColumn("_ask", F.lower("city")))
    unknown = asked.join(known.select(F.col("_low").alias("_ask"), "state"), ["_ask", "state"], "left_anti")
    left = unknown.withColumn("_form", F.explode(_variants("_ask")))
    right = known.withColumn("_form", F.explode(_variants("_low")))
    near = (left.join(right, ["state", "_form"])
            .where(F.levenshtein(F.col("_ask"), F.col("_low"), 1) == 1)
            .select("city", "state", "_canon").distinct())
    return (near.groupBy("city", "state").agg(F.count(F.lit(1)).alias("_n"), F.min("_canon").alias("snapped"))
            .where("_n = 1").drop("_n"))


def resolve_names(requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Place each distinct name context: first candidate state that knows the name wins.

    A stated state is final; otherwise the state of the search town, then of the centre.
    """
    stated = F.col("_stated") != ""
    states = F.when(stated, F.array("_stated")).otherwise(F.array(F.upper("_dstate"), F.upper("_cstate")))
    candidates = requests.select("*", F.posexplode_outer(F.array_distinct(F.filter(states, lambda s: s != "")))
                                 .alias("_pos", "_st"))
    snaps = snap_city(candidates.select(F.col("_city").alias("city"), F.col("_st").alias("state")), gazetteer)
    named = (candidates.join(snaps.select(F.col("city").alias("_city"), F.col("state").alias("_st"), "snapped"),
                             ["_city", "_st"], "left")
             .groupBy(*NAME_KEY).agg(
                 F.min(F.when(F.col("snapped").isNotNull(), F.struct("_pos", "snapped"))).alias("_s"),
                 F.collect_list(F.struct("_pos", "_st")).alias("_cands")))
    tries = (named.withColumn("place_city", F.coalesce("_s.snapped", F.col("_city")))
             .select(*NAME_KEY, "place_city", F.col("_s").isNotNull().alias("corrected"), F.explode("_cands").alias("_c"))
             .select("*", F.posexplode(F.array_distinct(
                 F.array(collapse("place_city"), places.normalize_place("place_city")))).alias("_try", "_name")))
    points = gazetteer.select(places.place_key("city", "state").alias("_key"), "lat", "lon")
    hit = F.struct("_c._pos", "_try", F.col("_c._st").alias("st"), "lat", "lon")
    return (tries.withColumn("_key", places.place_key("_name", F.col("_c._st"))).join(points, "_key", "left")
            .groupBy(*NAME_KEY, "place_city", "corrected")
            .agg(F.min(F.when(F.col("lat").isNotNull(), hit)).alias("_hit"))
            .select(*NAME_KEY, "place_city", "corrected", F.col("_hit.st").alias("place_state"),
                    F.col("_hit.lat").alias("lat"), F.col("_hit.lon").alias("lon")))


def with_name_key(bids: DataFrame) -> DataFrame:
    raw = F.coalesce(F.nullif(F.col("city"), F.lit("")), F.nullif(F.col("default_city"), F.lit("")), F.lit(""))
    return bids.withColumn("_p", places.split_city_state(raw)).select(
        "*", F.col("_p.city").alias("_city"), F.col("_p.state").alias("_stated"),
        text("default_city").alias("_dcity"), text("default_state").alias("_dstate"),
        text("center_state").alias("_cstate")).drop("_p")


def place_bids(bids: DataFrame, gazetteer: DataFrame, registry: DataFrame) -> DataFrame:
    """Bids with place_city, place_state, lat, lon, drop_reason and the notes of corrections.

    A name no gazetteer knows is anchored to its search town only when it is an authority or
    that very town, and names no other state; a county registered in exactly one other state
    is dropped instead.
    """
    keyed = with_name_key(bids)
    requests = keyed.where("_city <> ''").select(*NAME_KEY).distinct()
    resolved = stage(resolve_names(stage(requests, "names"), gazetteer), "resolved")
    town = F.lower(F.trim("_dcity"))
    search_town = (town != "") & (F.lower(F.trim("place_city")) == town)
    home = F.upper(F.coalesce(F.nullif(F.col("_dstate"), F.lit("")), F.col("_cstate")))
    judged = resolved.withColumn("_home", home).withColumn("_search_town", search_town)
    doubtful = (F.col("lat").isNull() & (F.col("_stated") == "") & ~F.col("_search_town")
                & places.looks_like_authority("place_city") & places.county_shaped("place_city"))
    bodies = (states_for_org(judged.where(doubtful).select(F.col("place_city").alias("name")), registry)
              .groupBy("name").agg(F.count(F.lit(1)).alias("_states"), F.min("state").alias("_only")))
    judged = judged.join(bodies.withColumnRenamed("name", "place_city"), "place_city", "left").withColumn(
        "_elsewhere", F.coalesce(doubtful & (F.col("_states") == 1) & (F.col("_only") != F.col("_home")), F.lit(False)))
    anchorable = ((places.looks_like_authority("place_city") | F.col("_search_town"))
                  & ((F.col("_stated") == "") | (F.col("_stated") == F.col("_home"))))
    answers = judged.select(*NAME_KEY, "place_city", "corrected", "place_state", "lat", "lon", "_home", "_elsewhere",
                            anchorable.alias("_anchorable"))
    joined = keyed.join(answers, NAME_KEY, "left")
    found = F.col("lat").isNotNull()
    has_anchor = F.col("fallback_lat").isNotNull() & F.col("fallback_lon").isNotNull()
    anchored = ~found & ~F.col("_elsewhere") & F.col("_anchorable") & has_anchor
    reason = (F.when(F.col("_city") == "", F.lit("no_location"))
              .when(found, F.lit(None).cast("string"))
              .when(F.col("_elsewhere"), F.lit("authority_in_another_state"))
              .when(anchored, F.lit(None).cast("string"))
              .otherwise(F.lit("unresolvable_place")))
    return joined.select(
        *bids.columns, "place_city",
        F.when(found, F.col("place_state")).when(anchored, F.col("_home")).alias("place_state"),
        F.when(found, F.col("lat")).when(anchored, F.col("fallback_lat")).alias("lat"),
        F.when(found, F.col("lon")).when(anchored, F.col("fallback_lon")).alias("lon"),
        reason.alias("drop_reason"),
        F.coalesce("corrected", F.lit(False)).alias("city_name_corrected"),
        F.coalesce(anchored, F.lit(False)).alias("placed_by_search_town"))


def placement_funnel(placed: DataFrame) -> DataFrame:
    """Counts by drop reason and by note; notes are on rows that go on."""
    reasons = F.array(
        F.coalesce("drop_reason", F.lit("placed")),
        F.when(F.col("city_name_corrected"), F.lit("city_name_corrected")),
        F.when(F.col("placed_by_search_town"), F.lit("placed_by_search_town")))
    return (placed.select(F.explode(F.array_compact(reasons)).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def resolve_locations(searches: DataFrame, gazetteer: DataFrame, zips: DataFrame) -> DataFrame:
    """Search text to a centre: coordinates, else a ZIP, else 'City, ST', else 'City, State name'."""
    t = F.trim(text("location"))
    number = r"(-?\d{1,3}(?:\.\d+)?)"
    pair = rf"^{number},\s*{number}$"
    short, full = r"^(.*?),\s*([A-Za-z]{2})\b", r"^(.*?),\s*([A-Za-z][A-Za-z ]+)$"
    asked = searches.drop("lat", "lon", "city", "state").select(
        "*", F.regexp_extract(t, pair, 1).try_cast("double").alias("_tlat"),
        F.regexp_extract(t, pair, 2).try_cast("double").alias("_tlon"),
        F.regexp_extract(t, r"\b(\d{5})\b", 1).alias("zip"),
        places.place_key(F.trim(F.regexp_extract(t, short, 1)),
                         places.state_code(F.regexp_extract(t, short, 2), territories=False)).alias("_k1"),
        places.place_key(F.trim(F.regexp_extract(t, full, 1)), F.when(
            F.length(F.trim(F.regexp_extract(t, full, 2))) > 2,
            places.state_code(F.regexp_extract(t, full, 2), territories=False))).alias("_k2"))
    point = F.min(F.struct("lat", "lon", "city", "state"))  # one point per name and per ZIP, or a search would multiply
    points = gazetteer.groupBy(places.place_key("city", "state").alias("_k")).agg(point.alias("_p"))
    by_zip = zips.where("zip <> ''").groupBy("zip").agg(point.alias("_z"))
    asked = asked.withColumn("zip", F.nullif(F.col("zip"), F.lit("")))
    joined = (asked.join(by_zip, "zip", "left")
              .join(points.withColumnsRenamed({"_k": "_k1", "_p": "_p1"}), "_k1", "left")
              .join(points.withColumnsRenamed({"_k": "_k2", "_p": "_p2"}), "_k2", "left"))
    valid = F.col("_tlat").between(-90, 90) & F.col("_tlon").between(-180, 180)
    typed = F.when(valid, F.struct(F.col("_tlat").alias("lat"), F.col("_tlon").alias("lon"),
                                   F.lit("").alias("city"), F.lit("").alias("state")))
    return (joined.withColumn("_c", F.coalesce(typed, F.col("_z"), F.col("_p1"), F.col("_p2")))
            .select(*[c for c in searches.columns if c not in ("lat", "lon", "city", "state")], "_c.*"))
