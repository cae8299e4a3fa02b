"""SQL pieces that several oracles share."""

PI = "pi()"


def wx(lon: str) -> str:
    return f"(({lon} + 180.0) / 360.0)"


def wy(lat: str) -> str:
    s = f"sin(radians(greatest(-85.0511287798, least(85.0511287798, {lat}))))"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 - ln((1.0 + {s}) / (1.0 - {s})) / (4 * pi())))"


def cell(v: str, z: str | int) -> str:
    return f"greatest(0, least((2 ** {z})::BIGINT - 1, floor({v} * 2 ** {z})::BIGINT))"


def first(v: str, z: int) -> str:
    return f"greatest(0, least({2**z - 1}, floor({v} * {2**z} + 1e-9)::BIGINT))"


def last(low: str, high: str, z: int) -> str:
    return f"greatest({first(low, z)}, greatest(0, least({2**z - 1}, ceil({high} * {2**z} - 1e-9)::BIGINT - 1)))"


def latitude(y: str) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y})))))"


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371008.8 * asin(least(1.0, sqrt(sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2))))"


def tiles(z: int, source: str = "box", extra: str = "file_pos", x: str = "x", y: str = "y") -> str:
    """SELECT of a box table by the tiles that it touches."""
    return (
        f"SELECT {extra}, x AS {x}, y AS {y} FROM (SELECT *, unnest(range({first(wy('n'), z)}, {last(wy('n'), wy('s'), z)} + 1)) AS y FROM"
        f" (SELECT *, unnest(range({first(wx('w'), z)}, {last(wx('w'), wx('e'), z)} + 1)) AS x FROM {source}))"
    )


def linear(c: str, knee: float = 0.03928) -> str:
    return f"(CASE WHEN {c} / 255e0 <= {knee} THEN {c} / 255e0 / 12.92 ELSE (({c} / 255e0 + 0.055) / 1.055) ** 2.4 END)"


def luminance(r: str, g: str, b: str) -> str:
    return f"(0.2126 * {linear(r)} + 0.7152 * {linear(g)} + 0.0722 * {linear(b)})"
