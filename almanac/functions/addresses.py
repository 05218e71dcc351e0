"""Postal address parsing and administrative keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# State name, postal code, FIPS code.
STATES = (
    ("Alabama", "AL", "01"), ("Alaska", "AK", "02"), ("Arizona", "AZ", "04"), ("Arkansas", "AR", "05"),
    ("California", "CA", "06"), ("Colorado", "CO", "08"), ("Connecticut", "CT", "09"), ("Delaware", "DE", "10"),
    ("District of Columbia", "DC", "11"), ("Florida", "FL", "12"), ("Georgia", "GA", "13"), ("Hawaii", "HI", "15"),
    ("Idaho", "ID", "16"), ("Illinois", "IL", "17"), ("Indiana", "IN", "18"), ("Iowa", "IA", "19"),
    ("Kansas", "KS", "20"), ("Kentucky", "KY", "21"), ("Louisiana", "LA", "22"), ("Maine", "ME", "23"),
    ("Maryland", "MD", "24"), ("Massachusetts", "MA", "25"), ("Michigan", "MI", "26"), ("Minnesota", "MN", "27"),
    ("Mississippi", "MS", "28"), ("Missouri", "MO", "29"), ("Montana", "MT", "30"), ("Nebraska", "NE", "31"),
    ("Nevada", "NV", "32"), ("New Hampshire", "NH", "33"), ("New Jersey", "NJ", "34"), ("New Mexico", "NM", "35"),
    ("New York", "NY", "36"), ("North Carolina", "NC", "37"), ("North Dakota", "ND", "38"), ("Ohio", "OH", "39"),
    ("Oklahoma", "OK", "40"), ("Oregon", "OR", "41"), ("Pennsylvania", "PA", "42"), ("Rhode Island", "RI", "44"),
    ("South Carolina", "SC", "45"), ("South Dakota", "SD", "46"), ("Tennessee", "TN", "47"), ("Texas", "TX", "48"),
    ("Utah", "UT", "49"), ("Vermont", "VT", "50"), ("Virginia", "VA", "51"), ("Washington", "WA", "53"),
    ("West Virginia", "WV", "54"), ("Wisconsin", "WI", "55"), ("Wyoming", "WY", "56"),
)
NAME_TO_CODE = {n: c for n, c, _ in STATES}
FIPS_TO_CODE = {f: c for _, c, f in STATES}
PLACEHOLDER_ADDRESS = r"(?i)not\s*listed|defined|personal request|without walls|doesn"


def lookup(col: Column, mapping: Mapping[str, str]) -> Column:
    """Value of a small fixed map; null when absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[col]


def formatted_address(address: Column, names: Mapping[str, str] = NAME_TO_CODE) -> Column:
    """Struct (city, state) from ``Street, City, ST 12345, USA``; else from a full state name.

    State is null for an address that names no state, so foreign rows can be dropped.
    """
    short = F.regexp_replace(F.trim(address), r",?\s*USA\s*$", "")
    zip_rule = r",\s+([^,]+),\s+([A-Z]{2})\s+\d{5}(?:-\d{4})?$"
    code = F.nullif(F.regexp_extract(short, zip_rule, 2), F.lit(""))
    # Names are tried in the order of the map: the first contained one wins.
    named = F.get(F.filter(F.array(*map(F.lit, names)), lambda n: address.contains(n)), F.lit(0))
    city_named = F.trim(
        F.call_function("regexp_extract", address, F.concat(F.lit(r",\s+([^,]+),\s+"), named), F.lit(1))
    )
    return F.struct(
        F.when(code.isNotNull(), F.trim(F.regexp_extract(short, zip_rule, 1)))
        .when(named.isNotNull(), city_named)
        .alias("city"),
        F.coalesce(code, lookup(named, names)).alias("state"),
    )


_DIRECTORY = r",\s+([A-Za-z][A-Za-z .'`\-]*),\s+([A-Z]{2})(?:[,\s]|$)"


def directory_address(text: Column) -> Column:
    """Struct (city, state) of ``.., City, ST`` anywhere in the text; blanks when absent."""
    return F.struct(
        F.trim(F.regexp_extract(text, _DIRECTORY, 1)).alias("city"),
        F.regexp_extract(text, _DIRECTORY, 2).alias("state"),
    )


def name_place_hint(name: Column, codes: Sequence[str] = tuple(NAME_TO_CODE.values())) -> Column:
    """Struct (city, state) hinted by a name such as ``House of Springfield IL``."""
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    state = F.when(F.upper(last).isin(*codes), F.upper(last))
    body = F.when(state.isNotNull(), F.regexp_replace(F.trim(name), r"\S+$", "")).otherwise(name)
    city = F.regexp_extract(F.trim(body), r"(?i)\bof\s+(.+)$", 1)
    city = F.trim(F.regexp_replace(F.trim(city), ",+$", ""))
    return F.struct(F.nullif(city, F.lit("")).alias("city"), state.alias("state"))


def address_candidates(address: Column, city: Column, state: Column) -> Column:
    """Query strings for one address, strongest first, placeholders blanked, no repeats."""
    addr = F.when(address.rlike(PLACEHOLDER_ADDRESS), F.lit("")).otherwise(
        F.trim(F.regexp_replace(F.trim(F.coalesce(address, F.lit(""))), ",+$", ""))
    )
    addr = F.nullif(addr, F.lit(""))
    sep = F.lit(", ")
    tried = F.array(F.concat(addr, sep, city, sep, state), F.concat(addr, sep, state), addr)
    return F.array_distinct(F.filter(tried, lambda q: q.isNotNull()))


def district_id(state: Column, number: Column, from_fips: bool = False) -> Column:
    """``ST-n``; decimals are cut, an unreadable number is 0 (at-large)."""
    code = F.coalesce(lookup(state, FIPS_TO_CODE), state) if from_fips else F.upper(F.trim(state))
    n = F.coalesce(F.expr("cast(null as double)") if number is None else number.try_cast("double"), F.lit(0.0))
    return F.concat_ws("-", code, n.cast("bigint").cast("string"))


def tract_parts(geoid: Column) -> Column:
    """Struct of the 2+3+6 parts of an 11-character tract id and its county key."""
    return F.struct(
        F.substring(geoid, 1, 2).alias("state_fips"),
        F.substring(geoid, 3, 3).alias("county_fips"),
        F.substring(geoid, 6, 6).alias("tract"),
        F.substring(geoid, 1, 5).alias("county"),
    )


def tract_geoid(state: Column, county: Column, tract: Column) -> Column:
    return F.concat(F.lpad(state, 2, "0"), F.lpad(county, 3, "0"), F.lpad(tract, 6, "0"))
