"""Search addresses and fare endpoints of the known sources, as expressions. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CITY_NAMES = {"DEL": "Delhi", "BOM": "Mumbai", "BLR": "Bengaluru", "HYD": "Hyderabad", "CCU": "Kolkata", "MAA": "Chennai", "AMD": "Ahmedabad", "PNQ": "Pune", "GAU": "Guwahati", "GOI": "Goa", "COK": "Kochi", "JAI": "Jaipur"}
ENDPOINTS = {"easemytrip": ["/airavail_lights/", "/airavail", "/airbus_new"], "cleartrip": ["/flights/results", "/air/search", "/fare", "/api/flights"]}


def city_name(code: Column) -> Column:
    out = F.when(F.lit(False), code)
    for k, v in CITY_NAMES.items():
        out = out.when(code == k, v)
    return out.otherwise(code)


def search_url(source: Column, origin: Column, destination: Column, dep_date: Column) -> Column:
    """The address of a source's result page for a cell; null for sources without a template."""
    day = F.date_format(dep_date, "dd/MM/yyyy")
    emt = F.concat(
        F.lit("https://flight.easemytrip.com/FlightList/Index?srch="), origin, F.lit("-"), city_name(origin), F.lit("-India|"), destination, F.lit("-"), city_name(destination), F.lit("-India|"), day,
        F.lit("&px=1-0-0&cbn=0&ar=undefined&isow=true&isdm=true&lang=en-us&IsDoubleSeat=false&CCODE=IN&curr=INR"),
    )
    ct = F.concat(F.lit("https://www.cleartrip.com/flights/results?adults=1&childs=0&infants=0&class=Economy&depart_date="), day, F.lit("&from="), origin, F.lit("&to="), destination, F.lit("&intl=n"))
    return F.when(source == "easemytrip", emt).when(source == "cleartrip", ct)


def is_fare_endpoint(source: Column, url: Column) -> Column:
    low = F.lower(url)
    out = F.lit(False)
    for name, parts in ENDPOINTS.items():
        for part in parts:
            out = out | ((source == name) & low.contains(part))
    return out
