"""What a walker is told: instructions, times, distances, problems, counts, units. Column expressions over feet, metres and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrant.functions.geo import FEET_PER_METRE
from quadrant.functions.solar import HORIZON_DEG
from quadrant.functions.units import half_up, nice_feet, one_decimal, walk_label

WALK_M_PER_S, NAV_FEET_PER_S, REACH_M = 1.4, 4.6, 300.0
SQUARE_FEET, FEET = 10.7639, 3.28084

# Phrases of the kinds of turn.
PHRASES = {"depart": "Start walking", "straight": "Continue straight", "slight-left": "Bear left", "slight-right": "Bear right", "left": "Turn left", "right": "Turn right", "uturn": "Make a U-turn", "arrive": "Arrive at destination"}
# What is said when a position is of no use.
HOLD = "Press and hold the map to set a starting point instead."


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    """The value of a fixed table; ``default`` for other keys and null."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def instruction(kind: Column) -> Column:
    return lookup(kind, PHRASES, "Continue")


def walk_seconds(feet: Column) -> Column:
    return feet / FEET_PER_METRE / WALK_M_PER_S


def nav_eta(feet: Column) -> Column:
    """Minutes left while walking, at a second, brisker speed; below one it says so."""
    minutes = feet / NAV_FEET_PER_S / 60
    return F.when(minutes < 1, "< 1 min").otherwise(F.concat(half_up(minutes).cast("long").cast("string"), F.lit(" min")))


def clock(ts: Column) -> Column:
    """Hour without leading zero and minute with half of the day, in the session's zone."""
    return F.date_format(ts, "h:mm a")


def arrival(ts: Column, seconds: Column) -> Column:
    return clock(F.timestamp_micros((F.unix_micros(ts.cast("timestamp")) + half_up(seconds * 1_000_000)).cast("long")))


def route_summary(feet: Column, ts: Column) -> Column:
    """STRUCT<seconds, time, arrival, distance>."""
    seconds = walk_seconds(feet)
    return F.struct(seconds.alias("seconds"), walk_label(feet / FEET_PER_METRE).alias("time"), arrival(ts, seconds).alias("arrival"), nice_feet(feet).alias("distance"))


def reach_problem(metres: Column) -> Column:
    """Why a position cannot be walked from; null if it can."""
    miles = metres / 1000 * 0.621371
    away = F.when(miles >= 0.2, F.concat(one_decimal(miles), F.lit(" mi"))).otherwise(nice_feet(metres * FEET))
    unknown = metres.isNull() | F.isnan(metres) | (F.abs(metres) == float("inf"))
    far = F.concat(F.lit("You are about "), away, F.lit(f" from the campus paths — too far to walk from here. {HOLD}"))
    return F.when(unknown, f"Could not work out where you are on the map. {HOLD}").when(metres > REACH_M, far)


def location_problem(code: Column) -> Column:
    """What to say for a failed fix, by its code."""
    return F.when(code == 1, "Location is turned off for this site. Allow it in your browser, or press and hold the map to set a starting point.").when(code == 3, f"Locating timed out. {HOLD}").otherwise(f"Your device could not get a location fix. {HOLD}")


def counted(n: Column, word: str) -> Column:
    """Number and word, with an s unless there is one."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def count_text(buildings: Column, zones: Column, outside: Column) -> Column:
    """Counts that are not zero, joined by dots."""
    some = lambda n, text: F.when(n > 0, text)
    return F.concat_ws(" · ", some(buildings, counted(buildings, "building")), some(zones, counted(zones, "zone")), some(outside, F.concat(outside.cast("string"), F.lit(" outdoors"))))


def thousands(number: Column) -> Column:
    return F.format_number(half_up(number).cast("long"), 0)


def floor_area(square_metres: Column) -> Column:
    return F.concat(thousands(square_metres * SQUARE_FEET), F.lit(" sq ft"))


def height_text(metres: Column) -> Column:
    return F.concat(half_up(metres * FEET).cast("long").cast("string"), F.lit(" ft"))


def building_sub(inside: Column, official: Column, name: Column, square_metres: Column) -> Column:
    """What is inside, else the official name if it differs, else the floor area."""
    many = F.concat(counted(inside, "destination"), F.lit(" inside"))
    return F.when(inside > 0, many).when((official != "") & (official != name), official).otherwise(floor_area(square_metres))


def place_label(lon: Column, lat: Column) -> Column:
    """Latitude first, four decimals each."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.format_string("%.4f", lat), F.lit(", "), F.format_string("%.4f", lon)))


def detent(height: Column, velocity: Column, start: Column, stops: list[float], project_ms: float = 120.0, flick: float = 0.45) -> Column:
    """The stop nearest to where a drag would glide; a flick moves at least one stop from the one it began at."""
    ordered = sorted(set(stops))
    nearest = lambda h: F.array_min(F.array(*[F.struct(F.abs(F.lit(s) - h).alias("away"), F.lit(i).alias("i")) for i, s in enumerate(ordered)]))["i"]
    target, origin = nearest(height + velocity * project_ms), nearest(start)
    flicked = F.least(F.greatest(origin + F.when(velocity > 0, 1).otherwise(-1), F.lit(0)), F.lit(len(ordered) - 1))
    return F.get(F.array(*[F.lit(float(s)) for s in ordered]), F.when((F.abs(velocity) >= flick) & (target == origin), flicked).otherwise(target))


def framing_span(area: Column, half_width: Column, half_height: Column, margin: float, reach: float, least: float = 130.0, most: float = 800.0, least_area: float = 150.0) -> Column:
    """Metres across that a view of a thing takes: its larger half size, or that of a square of its area, with a margin, between bounds."""
    half = F.coalesce(F.greatest(half_width, half_height), F.sqrt(F.greatest(F.coalesce(area, F.lit(0.0)), F.lit(least_area))) / 2)
    return F.greatest(F.lit(least), F.least(F.lit(most), half * margin / reach))


def sun_height(elevation: Column, ramp: float = 12.0) -> Column:
    """0 at the horizon, 1 from ``ramp`` degrees above it on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (elevation - HORIZON_DEG) / ramp))


def sun_lights(elevation: Column, azimuth: Column) -> Column:
    """STRUCT<ambient, direct, shadow, azimuth, polar>: strengths of the lights and where the sun stands."""
    up = sun_height(elevation)
    polar = F.greatest(F.lit(1.0), F.least(F.lit(89.0), 90 - elevation))
    return F.struct((0.45 + 0.35 * up).alias("ambient"), (0.9 * up).alias("direct"), up.alias("shadow"), azimuth.alias("azimuth"), polar.alias("polar"))


def sun_azimuth(elevation: Column, hour_angle: Column, declination: Column, lat: Column) -> Column:
    """Degrees clockwise from north."""
    cos = (F.sin(F.radians(declination)) - F.sin(F.radians(elevation)) * F.sin(F.radians(lat))) / (F.cos(F.radians(elevation)) * F.cos(F.radians(lat)))
    east = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))))
    return F.when(hour_angle > 0, 360 - east).otherwise(east)


