"""Coercions, predicates and small formulas over columns. Dirty text never raises: it becomes null or the stated default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as true; graph files of older writers also have "t".
TRUE_TEXTS = ["true", "yes", "y", "on"]
LENIENT_TEXTS = ["true", "yes", "y", "on", "t"]
#: Words of a status that close a road, and of access that bar a truck.
CLOSED, BARRED = ["closed", "proposed", "under construction"], ["no", "private"]
#: Words of road names that do not tell roads apart.
NAME_STOP_WORDS = ["road", "rd", "street", "st", "avenue", "ave", "drive", "dr", "freeway", "motorway", "highway", "hwy", "tunnel", "bridge"]


def d(v: float) -> Column:
    return F.lit(float(v))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, d(low)), d(high)))


def number(x: Column, default: float) -> Column:
    v = x.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), v).otherwise(d(default))


def integer(x: Column, default: int) -> Column:
    v = x.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), F.floor(v)).try_cast("int"), F.lit(default))


def flag(x: Column, true_texts: list[str] | None = None) -> Column:
    """Truth of a number (finite and not 0) or of a text; anything else is false."""
    text = F.lower(F.trim(x.cast("string")))
    v = text.try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != d(float("inf")))
    return F.coalesce(F.when(v.isNotNull(), finite & (v != 0)).otherwise(text.isin(true_texts or TRUE_TEXTS)), F.lit(False))


def first_number(text: Column, default: float) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"[-+]?\d*\.?\d+", 0), F.lit("")).try_cast("double"), d(default))


def node_id(x: Column) -> Column:
    """'123.0' is the same id as '123'. Digits are never read as a double: ids of more than 15 of them would lose some."""
    text = F.trim(x.cast("string"))
    digits = F.nullif(F.regexp_extract(text, r"^([+-]?\d+)(\.0*)?$", 1), F.lit(""))
    v = text.try_cast("double")
    whole = v.isNotNull() & (v == F.floor(v)) & (F.abs(v) < d(1e15))
    return F.coalesce(digits.try_cast("decimal(38,0)").cast("string"), F.when(whole, v.try_cast("bigint").cast("string")).otherwise(text))


def edge_text(u: Column, v: Column, k: Column) -> Column:
    """Null where a part is missing: without it the text would be another edge's."""
    return F.concat(u, F.lit("_"), v, F.lit("_"), k)


def probability(z: Column) -> Column:
    """From an expectation in -1..1."""
    return clip((z + 1) / 2, 1e-9, 1)


def logistic(x: Column, bound: float = 30) -> Column:
    return 1 / (1 + F.exp(-clip(x, -bound, bound)))


def traffic_regime(ts: Column) -> tuple[Column, Column]:
    """(name, value) of the hour's traffic."""
    h = F.hour(ts)
    bands = [((h >= 6) & (h < 10), "AM_PEAK", 1.0), ((h >= 15) & (h < 19), "PM_PEAK", 0.9), ((h >= 10) & (h < 15), "MIDDAY_NORMAL", 0.4), ((h >= 19) & (h < 22), "EVENING_NORMAL", 0.2)]
    name, value = F.lit("OFF_PEAK_NIGHT"), d(0)
    for cond, n, v in reversed(bands):
        name, value = F.when(cond, n).otherwise(name), F.when(cond, d(v)).otherwise(value)
    return name, value


def calendar(ts: Column) -> tuple[Column, Column]:
    return F.weekday(ts) / d(6), (F.month(ts) - 1) / d(11)


def noise_sigma(tunnel: Column, multiplier: Column) -> Column:
    return F.when(tunnel, d(45)).otherwise(d(10)) * multiplier


def degradation(hdop: Column, satellites: Column) -> Column:
    return logistic(d(0.8) * (hdop - 2) + d(0.45) * (6 - satellites), 20)


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + d(180), d(360)) - d(180))


def bearing(dx: Column, dy: Column) -> Column:
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)) + d(360), d(360)))


def speed_mps(text: Column, default_kmh: float = 60) -> Column:
    """Metres a second of a speed limit text, miles an hour if it says so, 5 to 130 km/h."""
    kmh = first_number(text, default_kmh) * F.when(F.lower(text).contains("mph"), d(1.609344)).otherwise(d(1))
    return clip(kmh, 5, 130) / d(3.6)


def tunnel_edge(tunnel: Column, layer: Column) -> Column:
    return flag(tunnel) | (layer < 0)


def bridge_edge(bridge: Column, layer: Column) -> Column:
    return flag(bridge) | (layer > 0)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def text_of(*columns: Column) -> Column:
    """Lower-case trimmed texts joined by spaces; missing ones are left out."""
    return F.trim(F.concat_ws(" ", *[F.nullif(F.lower(F.trim(c)), F.lit("")) for c in columns]))


def text_of_all(values: Column) -> Column:
    """text_of for an array."""
    return F.array_join(F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != "")), " ")


def first_present(*values: Column) -> Column:
    """The first value that is there; arrays are searched in order, and so are arrays of arrays."""
    every = F.flatten(F.array(*values))
    return F.get(F.filter(every, lambda v: v.isNotNull() & (F.lower(F.trim(v)) != "nan")), F.lit(0))


def any_flag(values: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: flag(v)), F.lit(False))


def all_numbers(values: Column) -> Column:
    """The first number of each text of an array, where it has one."""
    found = F.transform(values, lambda v: F.nullif(F.regexp_extract(v, r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double"))
    return F.filter(found, lambda v: v.isNotNull())


def pick_column(columns: list[str], preferred: list[str], default: str | None = None) -> str | None:
    """The first preferred name that a table has, whatever its case."""
    there = {c.lower(): c for c in columns}
    return next((there[p.lower()] for p in preferred if p.lower() in there), default)


def truck_allowed(edge: dict[str, Column]) -> Column:
    """Not under construction, closed, proposed, private, forbidden, for management only, or for four-wheel drive.

    edge: columns by name: highway, construction, status, access, vehicle, motor_vehicle, hgv; and of a matched authority's road, which
    counts only where `matched` is true: road_status, road_access, trafficable. Missing names are missing values.
    """
    col = lambda n: edge.get(n, F.lit(None).cast("string"))
    matched = flag(edge["matched"]) if "matched" in edge else F.lit(False)
    own = lambda n: F.when(matched, col(n))
    highway, construction, status = text_of(col("highway")), text_of(col("construction")), text_of(col("status"), own("road_status"))
    access = text_of(*[col(n) for n in ("access", "vehicle", "motor_vehicle", "hgv")], own("road_access"))
    trafficable = text_of(own("trafficable"))
    building = highway.contains("construction") | ~construction.isin("", "no", "none", "nan")
    closed = status.rlike("|".join(CLOSED))
    barred = F.arrays_overlap(_tokens(access), F.array(*[F.lit(b) for b in BARRED])) | access.contains("management only")
    return ~(building | closed | barred | ~trafficable.isin("", "2wd", "nan", "none"))


def in_use(status: Column, access: Column, trafficable: Column) -> Column:
    """Of an authority's roads those in operation, open and for ordinary vehicles; a missing text does not count against a road."""
    up = lambda c: F.upper(F.coalesce(c, F.lit("")))
    return up(status).isin("", "OPERATIONAL") & ~up(access).isin("PRIVATE", "MANAGEMENT ONLY", "NO ACCESS") & up(trafficable).isin("", "2WD")


def subtype(tunnels: Column, bridges: Column, layers: Column, highways: Column) -> Column:
    """TUNNEL, BRIDGE, RAMP or ROAD of an edge whose attributes are arrays of texts."""
    level = all_numbers(layers)
    under = any_flag(tunnels) | F.coalesce(F.exists(level, lambda v: v < 0), F.lit(False))
    over = any_flag(bridges) | F.coalesce(F.exists(level, lambda v: v > 0), F.lit(False))
    return F.when(under, "TUNNEL").when(over, "BRIDGE").when(text_of_all(highways).contains("link"), "RAMP").otherwise("ROAD")


def one_way(text: Column) -> Column:
    """Whether an authority's text says one way; null where it says nothing."""
    low = F.lower(F.trim(text))
    both = low.contains("two way") | low.isin("both", "two-way")
    single = low.contains("one way") | low.isin("one-way", "from to", "to from")
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(both, False).when(single, True).otherwise(flag(text))


def parse_edge(text: Column) -> Column:
    """(u, v, k) of "u_v_k" or "u_v"; null for anything else. The key is the number it begins with, 0 if it has none."""
    parts = F.split(text, "_")
    key = F.when(F.size(parts) > 2, integer(F.get(parts, F.lit(2)), 0)).otherwise(F.lit(0))
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("u"), F.get(parts, F.lit(1)).alias("v"), key.alias("k")))


def whole_key(key: Column) -> Column:
    """The key as a whole number; null where it is none."""
    v = key.cast("string").try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != d(float("inf"))) & (v == F.floor(v)), v.try_cast("int"))


def clean_speed(text: Column) -> Column:
    """The first run of digits of a speed limit, 60 without any."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("int"), F.lit(60))


def clean_layer(layer: Column, tunnel: Column) -> Column:
    """A tunnel is below ground whatever its layer says."""
    n = integer(layer, 0)
    return F.when(flag(tunnel) & (n >= 0), F.lit(-1)).otherwise(n)


def quality_target(hdop: Column, satellites: Column, tunnel: Column, state: Column) -> Column:
    """Graded quality of a fix, 0 to 1."""
    low, inside = F.lower(F.coalesce(state, F.lit(""))), flag(tunnel)
    clear = (number(satellites, 0) >= 8) & (number(hdop, 99) <= 1.5) & ~inside
    return F.when(clear, d(1)).when(inside | low.contains("blackout"), d(0)).when(low.contains("degraded"), d(0.35)).when(low.rlike("moderate|recovery"), d(0.55)).otherwise(d(0.75))


def ambiguous(tunnel: Column, state: Column) -> Column:
    return (flag(tunnel) | F.lower(F.coalesce(state, F.lit(""))).contains("blackout")).cast("int")


def moment(text: Column) -> Column:
    """ISO time; unreadable text raises, as a wrong time must not pass for none."""
    read = text.try_cast("timestamp_ntz")
    return F.when(text.isNull() | read.isNotNull(), read).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp_ntz"))


def provenance(row: dict[str, Column], fields: list[str]) -> list[Column]:
    """The named fields, null where there are none."""
    return [row.get(f, F.lit(None).cast("string")).alias(f) for f in fields]


def mean_bearing(points: Column) -> Column:
    """Bearing from a polyline's first to its last point."""
    a, b = F.get(points, F.lit(0)), F.element_at(points, -1)
    return bearing(b["x"] - a["x"], b["y"] - a["y"])


def name_tokens(name: Column) -> Column:
    """Distinct telling words; all words where none tells; an empty array for no name."""
    every = F.array_distinct(_tokens(F.coalesce(name, F.lit(""))))
    telling = F.array_except(every, F.array(*[F.lit(w) for w in NAME_STOP_WORDS]))
    return F.when(F.size(telling) > 0, telling).otherwise(every)


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of token arrays; 0.5 where one is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), d(0.5)).otherwise(F.size(F.array_intersect(a, b)) / either)


def subtype_similarity(a: Column, b: Column) -> Column:
    plain = ["ROAD", "RAMP", "ROUNDABOUT"]
    return (
        F.when(b.isNull() | (b == "") | (b == "NAN"), d(0.5)).when(a == b, d(1)).when(a.isin(plain) & b.isin(plain), d(0.75)).when((a == "ROAD") & b.isin("TUNNEL", "BRIDGE"), d(0.65)).otherwise(d(0))
    )


def direction_similarity(oneway_a: Column, oneway_b: Column, bearing_a: Column, bearing_b: Column) -> Column:
    same = F.when(oneway_a == oneway_b, d(1)).otherwise(d(0.35))
    alignment = F.greatest(d(0), 1 - angle_between(bearing_a, bearing_b) / d(90))
    both = oneway_a & oneway_b & bearing_a.isNotNull() & bearing_b.isNotNull()
    return F.when(oneway_b.isNull(), d(0.5)).when(both, d(0.5) * same + d(0.5) * alignment).otherwise(same)


def complete(*names: str) -> Column:
    """Whether a record has all that its reader needs."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def require(names: list[str], then: Column) -> Column:
    """`then` for complete records; an incomplete one raises."""
    return F.when(complete(*names), then).otherwise(F.raise_error(F.lit(f"a record lacks one of {names}")).cast("string"))
