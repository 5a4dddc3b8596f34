"""Scalar functions on fare texts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Carrier codes with the patterns of their names and flight numbers, tried in order. Fixed values.
CARRIERS = [
    ("6E", r"(?i)\b(6E|indigo)\b"),
    ("AI", r"(?i)\b(AI\d|air\s*india(?!\s*express))\b"),
    ("IX", r"(?i)\b(IX\d|air\s*india\s*express)\b"),
    ("QP", r"(?i)\b(QP\d|akasa)\b"),
    ("SG", r"(?i)\b(SG\d|spice\s*jet|spicejet)\b"),
    ("UK", r"(?i)\b(UK\d|vistara)\b"),
]
CODES = r"(6E|AI|IX|QP|SG|UK)"
#: Some part of every text that one of these patterns finds: a cheap test before them.
HINT = re.compile("6E|AI|IX|QP|SG|UK|indigo|akasa|spice|vistara", re.IGNORECASE)
#: Carrier names as they are shown, the longer before the shorter. Fixed values.
SHOWN_NAMES = [("IX", "air india express"), ("AI", "air india"), ("6E", "indigo"), ("QP", "akasa"), ("SG", "spicejet"), ("UK", "vistara")]
#: How a price is marked, the codes, and how the two texts of the known layout are built. Fixed values.
FLIGHT_NO = rf"(?i)\b{CODES}[\s-]?(\d{{2,4}})\b"
PRICE = r"(?i)(?:₹|rs\.?|inr)\s*([\d,]{3,10})"
RUPEES = r"₹\s*([\d,]{3,10})"
#: Some part of every price that one of these two finds: a cheap test before them.
MARK = re.compile("₹|rs|inr", re.IGNORECASE)


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_inr(c: Column) -> Column:
    """A fare as decimal: rupee signs and thousands commas allowed, digits otherwise; else null."""
    s = F.trim(c)
    marked = F.regexp_extract(s, PRICE, 1)
    digits = F.trim(F.regexp_replace(F.when(marked != "", marked).otherwise(s), "[,₹]", ""))
    return F.when(digits.rlike(r"^\d+(\.\d+)?$"), digits).try_cast("decimal(12,2)")


def detect_carrier(c: Column) -> Column:
    """Code of the carrier that a text names, by name or flight number, else by a bare code; null if none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, pattern in CARRIERS:
        out = out.when(c.rlike(pattern), code)
    return out.otherwise(none_if_empty(F.regexp_extract(F.upper(c), rf"\b{CODES}\b", 1)))


def names_carrier(c: Column) -> Column:
    """Whether a text names any carrier, in one pass."""
    return c.rlike("|".join(pattern for _, pattern in CARRIERS) + rf"|\b{CODES}\b")


def carrier_shown(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in SHOWN_NAMES:
        out = out.when(low.contains(name), code)
    return out


def detect_flight_no(c: Column) -> Column:
    return none_if_empty(F.concat(F.upper(F.regexp_extract(c, FLIGHT_NO, 1)), F.regexp_extract(c, FLIGHT_NO, 2)))


def stops_of(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return F.when(low.isin("non-stop", "nonstop", "direct"), 0).otherwise(F.regexp_extract(low, r"(\d+)", 1).try_cast("int"))


def sd_parts(sd: Column) -> Column:
    """Stops, fare, seats and route of a bar-separated itinerary summary; null if it has another form."""
    # The summary's layout. Fixed value.
    p = r"^([^|]*)\|(\d+(?:\.\d+)?)\|([^|]*)\|([^|]*)"
    s = F.trim(sd)
    part = lambda k: F.regexp_extract(s, p, k)
    return F.when(s.rlike(p), F.struct(part(2).try_cast("decimal(12,2)").alias("total_fare"), stops_of(part(1)).alias("stops"), none_if_empty(F.trim(part(3))).alias("seats_left"), none_if_empty(F.trim(part(4))).alias("route")))


def segment_parts(key: Column) -> Column:
    """Route, carrier, flight number and departure of a segment key; null if it has another form."""
    # The key's layout. Fixed value.
    p = r"^([A-Z]{3})([A-Z]{3})([A-Za-z]{3})-(\d{1,2}[A-Za-z]{3}\d{4})(\d{2}:\d{2})(\d{2}:\d{2})\s*([A-Z0-9]{2})\s*(\d{1,4})$"
    s = F.trim(key)
    part = lambda k: F.regexp_extract(s, p, k)
    dep = F.try_to_timestamp(F.concat_ws(" ", part(4), part(5)), F.lit("dMMMyyyy HH:mm")).cast("timestamp_ntz")
    return F.when(s.rlike(p), F.struct(part(1).alias("origin"), part(2).alias("destination"), part(7).alias("carrier"), F.concat(part(7), part(8)).alias("flight_no"), dep.alias("dep_ts")))
