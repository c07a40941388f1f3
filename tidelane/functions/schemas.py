"""Schemas of the clean tables, and the header names that raw files may use."""

from __future__ import annotations

from pyspark.sql import types as T

GEO_POINT = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "short": T.ShortType(), "int": T.IntegerType(), "bool": T.BooleanType(), "geo": GEO_POINT}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


TRAFFIC = _struct("link_id:long speed_mph:double travel_time_seconds:double timestamp_epoch_seconds:long borough:string borough_code:short link_name:string")
GARAGES = _struct(
    "license_number:string license_expiration_epoch_seconds:long license_creation_epoch_seconds:long business_name:string address_building:string "
    "address_street_name:string address_street_name_2:string address_city:string address_state:string address_zip:string contact_phone:string borough:string "
    "borough_code:short detail:string nta:string community_board:string council_district:string bin:string bbl:string census_tract:string location:geo has_location:bool"
)
BUILDINGS = _struct("bbl:string subgrade_level:int elevation_feet:double location:geo")

# Header names of the published files, by column.
TRAFFIC_ALIASES = {
    "link_id": ("link_id", "link id"),
    "speed": ("speed",),
    "travel_time": ("travel_time", "travel time"),
    "data_as_of": ("data_as_of", "timestamp", "datetime"),
    "borough": ("borough",),
    "link_name": ("link_name", "link name"),
}
TRAFFIC_REQUIRED = ("link_id", "speed", "travel_time", "data_as_of")
GARAGE_ALIASES = {
    "license_nbr": ("license_nbr", "license_number", "license number"),
    "lic_expir_dd": ("lic_expir_dd", "expiration_date"),
    "license_creation_date": ("license_creation_date", "initial_issuance_date"),
    "business_name": ("business_name", "entity_name", "name"),
    "address_building": ("address_building", "building_number"),
    "address_street_name": ("address_street_name", "street1"),
    "address_street_name_2": ("address_street_name_2", "street2"),
    "address_city": ("address_city", "city"),
    "address_state": ("address_state", "state"),
    "address_zip": ("address_zip", "zip_code"),
    "contact_phone": ("contact_phone",),
    "address_borough": ("address_borough", "borough"),
    "detail": ("detail", "details"),
    "nta": ("nta",),
    "community_board": ("community_board",),
    "council_district": ("council_district",),
    "bin": ("bin",),
    "bbl": ("bbl",),
    "census_tract": ("census_tract", "census_tract_2010"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng"),
}
BUILDING_ALIASES = {
    "bbl": ("bbl",),
    "subgrade_level": ("subgrade_level", "subgrade", "subgrade_ft"),
    "elevation_feet": ("elevation_feet", "elevation", "elevation_ft"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng"),
}

# Borough names and short names, by code.
BOROUGHS = {
    1: ("manhattan", "mn"),
    2: ("bronx", "bx"),
    3: ("brooklyn", "bk", "k"),
    4: ("queens", "qn", "q"),
    5: ("staten island", "si"),
}
