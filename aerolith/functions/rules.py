"""Business rules as Column builders.

Branches are tried in order and a null test is not true, so null values fall to
the last branch unless ``null_label`` names another one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DELAY_THRESHOLD = 15
LONG_DELAY = 60
SHORT_HAUL_BELOW = 500
MEDIUM_HAUL_UP_TO = 1500
WEEKEND_CODES = (1, 7)
HIGH_WEATHER_ABOVE = 30
CODE_LENGTH = 2
AIRLINE_GROUPS = {
    "MAJOR": ["AA", "UA", "DL", "WN"],
    "LOW_COST": ["B6", "NK", "F9", "VX"],
}
AIRLINE_NAME_PATTERNS = {
    "American Airlines": "American Airlines",
    "United": "United Airlines",
    "Delta": "Delta Airlines",
}
REGION_STATES = {
    "WEST": ["CA", "OR", "WA"],
    "NORTHEAST": ["NY", "PA", "MA", "NJ"],
    "SOUTH": ["TX", "FL", "GA", "AL"],
    "MIDWEST": ["IL", "OH", "MI", "WI"],
}
CONTINENT_COUNTRIES = {
    "NORTH_AMERICA": ["USA", "CAN", "MEX"],
    "ASIA": ["IND", "CHN", "JPN", "SGP"],
    "EUROPE": ["FRA", "DEU", "ESP", "ITA", "NLD"],
}
LARGE_STATES = ["CA"]
MEDIUM_STATES = ["NY", "TX", "FL", "IL"]
HOME_COUNTRY = "USA"


def cases(branches: Iterable[tuple[Column, str | int]], otherwise: str | int,
          null_of: Column | None = None, null_label: str | int | None = None) -> Column:
    """CASE over (test, value) pairs, optionally with a value of its own for null input."""
    chain = F.when(null_of.isNull(), F.lit(null_label)) if null_label is not None else None
    for test, value in branches:
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return F.lit(otherwise) if chain is None else chain.otherwise(F.lit(otherwise))


def up_to(value: Column, bounds: Iterable[tuple[float, str]], otherwise: str,
          null_label: str | None = None) -> Column:
    """Label of the first inclusive upper bound the value does not exceed."""
    return cases([(value <= bound, label) for bound, label in bounds], otherwise, value, null_label)


def above(value: Column, bounds: Iterable[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first exclusive lower bound the value exceeds."""
    return cases([(value > bound, label) for bound, label in bounds], otherwise)


def group_of(value: Column, groups: dict[str, list], otherwise: str) -> Column:
    """Name of the first group whose list holds the value."""
    return cases([(value.isin(members), name) for name, members in groups.items()], otherwise)


def valid_if(test: Column) -> Column:
    """VALID when the test is true; INVALID when it is false or null."""
    return cases([(test, "VALID")], "INVALID")


def total_delay(departure: Column, arrival: Column) -> Column:
    return departure + arrival


def delay_category(total: Column, threshold: int = DELAY_THRESHOLD, long_above: int = LONG_DELAY,
                   null_label: str | None = None) -> Column:
    bounds = [(0, "NO_DELAY"), (threshold, "SHORT"), (long_above, "MEDIUM")]
    return up_to(total, bounds, "LONG", null_label)


def distance_category(distance: Column, short_below: int = SHORT_HAUL_BELOW,
                      medium_up_to: int = MEDIUM_HAUL_UP_TO) -> Column:
    return cases(
        [(distance < short_below, "SHORT_HAUL"),
         (distance.between(short_below, medium_up_to), "MEDIUM_HAUL")],
        "LONG_HAUL",
    )


def day_type(day_code: Column, weekend_codes: Iterable[int] = WEEKEND_CODES) -> Column:
    """The default codes follow the published rule; with ISO codes pass (6, 7)."""
    return cases([(day_code.isin(*weekend_codes), "WEEKEND")], "WEEKDAY")


def flight_status(cancelled: Column, diverted: Column) -> Column:
    return cases([(cancelled == 1, "CANCELLED"), (diverted == 1, "DIVERTED")], "COMPLETED")


def weather_impact(minutes: Column, high_above: int = HIGH_WEATHER_ABOVE) -> Column:
    return above(minutes, [(high_above, "WEATHER_HIGH"), (0, "WEATHER_LOW")], "NO_WEATHER_IMPACT")


def on_time_flag(total: Column) -> Column:
    return cases([(total <= 0, 1)], 0)


def airline_category(code: Column, groups: dict[str, list] | None = None) -> Column:
    return group_of(code, groups or AIRLINE_GROUPS, "REGIONAL")


def code_validation(code: Column, length: int = CODE_LENGTH) -> Column:
    return valid_if(F.length(code) == length)


def airport_region(state: Column, groups: dict[str, list] | None = None) -> Column:
    """States outside the lists are INTERNATIONAL too, as published."""
    return group_of(state, groups or REGION_STATES, "INTERNATIONAL")


def airport_continent(country: Column, groups: dict[str, list] | None = None) -> Column:
    return group_of(country, groups or CONTINENT_COUNTRIES, "OTHER")


def airport_size(state: Column, country: Column, large: list | None = None,
                 medium: list | None = None, home: str = HOME_COUNTRY) -> Column:
    return cases(
        [(state.isin(large or LARGE_STATES), "LARGE"),
         (state.isin(medium or MEDIUM_STATES), "MEDIUM"),
         (country != home, "INTERNATIONAL")],
        "REGIONAL",
    )


def location_validation(latitude: Column, longitude: Column, city: Column) -> Column:
    return valid_if(latitude.between(-90, 90) & longitude.between(-180, 180) & city.isNotNull())
