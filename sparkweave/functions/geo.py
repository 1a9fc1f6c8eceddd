"""Geographic functions on longitude/latitude Columns; polygons as arrays of struct(x, y) rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres, geohash alphabet.
RADIUS = 6371000.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360.0, F.lit(360.0))


def geohash(lon: Column, lat: Column, precision: int) -> Column:
    """Geohash: bits of the two halvings interleaved, longitude first, five to a character."""
    x_bits, y_bits = (5 * precision + 1) // 2, 5 * precision // 2
    cell = lambda v, low, span, bits: F.least(F.floor((v - low) / span * (1 << bits)), F.lit((1 << bits) - 1))
    return cells_geohash(cell(lon, -180.0, 360.0, x_bits), cell(lat, -90.0, 180.0, y_bits), precision)


def cells_geohash(x: Column, y: Column, precision: int) -> Column:
    """The geohash of two cell numbers, longitude first."""
    x_bits, y_bits = (5 * precision + 1) // 2, 5 * precision // 2
    out = []
    for i in range(precision):
        code = F.lit(1)
        for j in range(5):
            k = 5 * i + j
            source, bits = (x, x_bits) if k % 2 == 0 else (y, y_bits)
            code = code + F.shiftright(source, bits - 1 - k // 2).bitwiseAND(F.lit(1)) * (16 >> j)
        out.append(F.substring(F.lit(BASE32), code.cast("int"), F.lit(1)))
    return F.concat(*out)


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def point_geojson(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a closed ring, an array of struct(x, y), contains the point."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = F.filter(
        edges,
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(cross) % 2 == 1


def length(line: Column) -> Column:
    """Metres along an array of struct(x, y)."""
    legs = F.zip_with(
        F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"])
    )
    return F.aggregate(legs, F.lit(0.0), lambda acc, v: acc + v)


def envelope(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")
    )


def circle(lon: Column, lat: Column, metres: Column, segments: int = 32) -> Column:
    """Closed ring of a circle's points."""
    turn = 2 * 3.141592653589793 / segments
    return F.transform(
        F.sequence(F.lit(0), F.lit(segments)),
        lambda i: F.struct(
            (lon + F.degrees(metres / RADIUS) * F.cos(i * turn) / F.cos(F.radians(lat))).alias("x"),
            (lat + F.degrees(metres / RADIUS) * F.sin(i * turn)).alias("y"),
        ),
    )


def geohash_cells(hash_: Column, precision: int) -> tuple[Column, Column]:
    """The two interleaved cell numbers of a geohash, longitude first."""
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(5 * precision):
        code = F.instr(F.lit(BASE32), F.substring(hash_, k // 5 + 1, 1)) - 1
        bit = F.shiftright(code, 4 - k % 5).bitwiseAND(F.lit(1))
        x, y = (x * 2 + bit, y) if k % 2 == 0 else (x, y * 2 + bit)
    return x, y


def geohash_decode(hash_: Column, precision: int) -> Column:
    """struct(x, y): the centre of the cell of a geohash of `precision` characters."""
    x, y = geohash_cells(hash_, precision)
    wide, high = 1 << (5 * precision + 1) // 2, 1 << 5 * precision // 2
    return F.struct(((x + 0.5) / wide * 360 - 180).alias("x"), ((y + 0.5) / high * 180 - 90).alias("y"))


def neighbor_cells(x: Column, y: Column, precision: int, east: int | Column, north: int | Column) -> Column:
    """The geohash `east` and `north` cells away from cell (x, y): around the globe eastwards, null beyond a pole."""
    x, y = F.pmod(x + east, F.lit(1 << (5 * precision + 1) // 2)), y + north
    return F.when((y >= 0) & (y < 1 << 5 * precision // 2), cells_geohash(x, y, precision))


def geohash_neighbor(hash_: Column, precision: int, east: int | Column, north: int | Column) -> Column:
    """The geohash `east` and `north` cells away: around the globe eastwards, null beyond a pole."""
    x, y = geohash_cells(hash_, precision)
    # the lambda's variable keeps the decoding from being repeated for every bit
    return F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda p: neighbor_cells(p["x"], p["y"], precision, east, north))[0]


def point_from_wkt(wkt: Column) -> Column:
    """struct(x, y) of `POINT(x y)`, null for other text."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    part = lambda i: F.regexp_extract(wkt, pattern, i).try_cast("double")
    return F.when(wkt.rlike(pattern), F.struct(part(1).alias("x"), part(2).alias("y")))


def point_from_geojson(text: Column) -> Column:
    """struct(x, y) of a GeoJSON point, null for other geometries."""
    g = F.from_json(text, "type string, coordinates array<double>")
    return F.when(g["type"] == "Point", F.struct(g["coordinates"][0].alias("x"), g["coordinates"][1].alias("y")))


def rectangle(x: Column, y: Column, half_width: float, half_height: float) -> Column:
    """Closed ring of a rectangle around a point."""
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    return F.array(*[F.struct((x + i * half_width).alias("x"), (y + j * half_height).alias("y")) for i, j in corners])


def is_valid_ring(ring: Column) -> Column:
    """Whether a ring is closed, of four points or more and within the range of coordinates."""
    inside = F.forall(ring, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    return F.coalesce((F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)) & inside, F.lit(False))


def intersects(a: Column, b: Column) -> Column:
    """Whether two closed rings share a point: edges meet, or one lies within the other."""
    legs = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    turn = lambda o, p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"])
    overlap = lambda s, t, c: (F.greatest(F.least(s["p"][c], s["q"][c]), F.least(t["p"][c], t["q"][c]))
                               <= F.least(F.greatest(s["p"][c], s["q"][c]), F.greatest(t["p"][c], t["q"][c])))
    meet = lambda s, t: (overlap(s, t, "x") & overlap(s, t, "y")
                         & (F.signum(turn(s["p"], s["q"], t["p"])) * F.signum(turn(s["p"], s["q"], t["q"])) <= 0)
                         & (F.signum(turn(t["p"], t["q"], s["p"])) * F.signum(turn(t["p"], t["q"], s["q"])) <= 0))
    crossing = F.exists(legs(a), lambda s: F.exists(legs(b), lambda t: meet(s, t)))
    return crossing | contains(a, b[0]["x"], b[0]["y"]) | contains(b, a[0]["x"], a[0]["y"])
