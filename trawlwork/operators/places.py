"""Places near a point and their sites."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlwork.operators.content import find_menu_link
from trawlwork.plans.lineage import cut
from trawlwork.plans.skew import lookup_join
from trawlwork.settings import LOOKUP_RADIUS_M

_EARTH_RADIUS_M = 6371008.8


def distance_m(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    """Great-circle distance in metres (haversine)."""
    phi, phi0 = F.radians(lat), F.radians(F.lit(at_lat))
    half_lat = F.sin((phi - phi0) / 2)
    half_lon = F.sin(F.radians(lon - at_lon) / 2)
    a = half_lat * half_lat + F.cos(phi) * F.cos(phi0) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * _EARTH_RADIUS_M)


def places_nearby(
    places: DataFrame,
    lat: float,
    lon: float,
    types: list[str],
    radius_m: float = LOOKUP_RADIUS_M,
    keyword: str | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """``places`` within the radius, once per matching type (``searched_type``), plus ``distance_m``.

    A place found under two types is two rows unless ``dedupe`` is set; then it keeps its first type. The
    bounding box is a plain comparison of columns, so it reaches the scan.
    """
    reach = radius_m / 111_000.0
    box = F.col("lat").between(lat - reach, lat + reach)
    widest = min(90.0, abs(lat) + reach)
    if widest < 89.0:
        span = reach / cos(radians(widest))
        if abs(lon) + span < 180:
            box = box & F.col("lon").between(lon - span, lon + span)
    near = places.filter(box).withColumn("distance_m", distance_m(F.col("lat"), F.col("lon"), lat, lon))
    near = near.filter(F.col("distance_m") <= radius_m)
    if keyword:
        near = near.filter(F.contains(F.lower("name"), F.lit(keyword.lower())))
    wanted = F.array(*[F.lit(t) for t in types])
    matching = F.filter(wanted, lambda t: F.array_contains(F.col("types"), t))
    if dedupe:
        matching = F.slice(matching, 1, 1)
    return near.withColumn("searched_type", F.explode(matching))


def place_sites(places: DataFrame, details: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(found, dropped)``: places with a details URL and a site URL, and those lacking either.

    ``details(place_id, google_url)`` and ``listings(google_url, html)`` hold at most one row per key. The
    site is the menu link of the listing page, else its website link.
    """
    # Listing pages are parsed once and shrink to one address before they are joined.
    sites = cut(listings.select("google_url", find_menu_link(F.col("html")).alias("establishment_url")), "sites")
    located = cut(lookup_join(places, details.select("place_id", "google_url"), ["place_id"]), "located")
    joined = lookup_join(located, sites, ["google_url"])
    found = F.col("google_url").isNotNull() & F.col("establishment_url").isNotNull()
    return joined.filter(found), joined.filter(~found).select(*places.columns)
