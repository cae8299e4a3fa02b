"""Style rules as tables: which apply to what and when, what is wrong with them, and the rewrites that a style knows.

A rule table is small and has an order (`ord`); features are joined to it by layer, so every test is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..functions import mercator as M

#: The deepest zoom of a rule (fixed value).
DEEPEST = 31
#: Names for shifts of line labels (fixed values); `places` drops them.
SHIFTS = {"extra-sparse": -2, "sparse": -1, "normal": 0, "dense": 1, "extra-dense": 2}
#: Fixed values of borders made to be seen first: stops of zoom and width, the band beside them, sizes of names.
COUNTRY_WIDTHS = [(3.0, 2.2), (8.0, 3.0), (12.0, 3.6), (16.0, 4.6)]
DIVISION_WIDTHS = [(3.0, 1.3), (8.0, 1.8), (12.0, 2.4), (16.0, 3.0)]
BAND, COUNTRY_NAME, DIVISION_NAME, SOONER = 1.2, 2.0, 1.25, 5


def effective_zoom(zoom: Column, bias: Column) -> Column:
    """The zoom that a label rule judges by; null where its bias leaves the range of zooms."""
    e = zoom + F.coalesce(bias, F.lit(0))
    return F.when(e.between(0, DEEPEST), e)


def applies_at(zoom: Column, bias: Column, least: Column, most: Column) -> Column:
    return F.coalesce(effective_zoom(zoom, bias).between(least, most), F.lit(False))


def allows(zoom: Column, bias: Column, least: Column, most: Column, feature_zoom: Column) -> Column:
    """A rule's own range and the feature's least zoom, both at the effective zoom."""
    return applies_at(zoom, bias, least, most) & F.coalesce(effective_zoom(zoom, bias) >= feature_zoom, F.lit(True))


def labels_shape(placement: Column, geom_type: Column) -> Column:
    """Point rules name points (1), line rules lines (2)."""
    return F.coalesce(((placement == "point") & (geom_type == 1)) | ((placement == "line") & (geom_type == 2)), F.lit(False))


def has_role(mask: Column, role: Column) -> Column:
    return F.expr("0").cast("long") != mask.cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), role.cast("int")))


def roles(role: Column) -> Column:
    """An aggregate: a set of roles as a mask."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), role.cast("int")))


def width_at(stops: Column, zoom: Column) -> Column:
    """stops (zoom, width), ascending: geometric between two, held beyond the ends."""
    first, last = F.get(stops, 0), F.element_at(stops, -1)
    at = F.size(F.filter(stops, lambda s: s["zoom"] < zoom))
    a, b = F.get(stops, at - 1), F.get(stops, at)
    between = a["width"] * F.pow(b["width"] / a["width"], (zoom - a["zoom"]) / (b["zoom"] - a["zoom"]))
    return F.when(F.isnan(zoom) | ~(zoom > first["zoom"]), first["width"]).when(zoom >= last["zoom"], last["width"]).otherwise(between)


def stroke_width(width: Column, stops: Column, tile_scale: Column, zoom: Column) -> Column:
    """In pixels: by the stops, or without any the tile's width scaled."""
    return F.when(F.coalesce(F.size(stops), F.lit(0)) <= 0, width * tile_scale).otherwise(width_at(stops, zoom))


def fault() -> Column:
    """What is wrong with a draw rule (layer, min_zoom, max_zoom, fill, width, stops), or null."""
    stops = F.col("stops")
    place = F.sequence(F.lit(0), F.size(stops) - 2)
    falls = (F.size(stops) > 1) & F.exists(F.when(F.size(stops) > 1, place).otherwise(F.array(F.lit(0))), lambda i: ~(F.get(stops, i + 1)["zoom"] > F.get(stops, i)["zoom"]))
    return F.coalesce(
        F.when(F.coalesce("layer", F.lit("")) == "", "no layer"),
        F.when(F.col("max_zoom") < F.col("min_zoom"), "no zoom"),
        F.when(F.col("max_zoom") > DEEPEST, "too deep"),
        F.when(~F.col("fill") & ~(F.col("width") > 0) & (F.size(stops) == 0), "draws nothing"),
        F.when(F.exists(stops, lambda s: ~(s["width"] > 0)), "width of nothing"),
        F.when(falls, "widths out of order"),
    )


def shift_line_labels(labels: DataFrame, zooms: int) -> DataFrame:
    """Label rules (minor, bias, ...) with the names of what a map draws moved by so many zooms."""
    return labels.withColumn("bias", F.col("bias") + F.when(F.col("minor"), zooms).otherwise(0))


def shift_place_labels(labels: DataFrame, zooms: int) -> DataFrame:
    """The same for the names of places, but not of countries and states."""
    place = ~F.col("minor") & ~F.col("political") & (F.col("layer") == "places")
    return labels.withColumn("bias", F.col("bias") + F.when(place, zooms).otherwise(0))


def without_line_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~F.col("minor"))


def label_choice(labels: DataFrame, value: str) -> DataFrame:
    """`places`, a name of a shift, or a signed number; anything else is refused."""
    if value == "places":
        return without_line_labels(labels)
    if value not in SHIFTS and not value.lstrip("+-").isdigit():
        raise ValueError(f"labels {value!r}: not one of places, {', '.join(SHIFTS)}, nor a signed number")
    return shift_line_labels(labels, SHIFTS[value] if value in SHIFTS else int(value))


def _stops(pairs, wider: float = 0.0) -> Column:
    return F.array(*(F.struct(F.lit(z).alias("zoom"), F.lit(w + wider).alias("width")) for z, w in pairs))


def emphasise_rules(rules: DataFrame) -> DataFrame:
    """Draw rules (ord, layer, kinds, role, stops, dash, major, ...): a country's border becomes the dashes of major
    divisions, a band of land, and the border itself, in that order; the others stay.  ord becomes (ord, sub)."""
    country = (F.col("layer") == "boundaries") & (F.col("kinds") == F.array(F.lit("country")))
    made = [("region", True, "boundary_strong", _stops(DIVISION_WIDTHS), F.array(F.lit(3.0), F.lit(2.0)))]
    made += [("country", False, "land", _stops(COUNTRY_WIDTHS, 2 * BAND), F.array().cast("array<double>"))]
    made += [("country", False, "boundary_strong", _stops(COUNTRY_WIDTHS), F.array().cast("array<double>"))]
    new = F.array(*(F.struct(F.lit(i).alias("sub"), F.array(F.lit(k)).alias("kinds"), F.lit(m).alias("major"), F.lit(r).alias("role"), s.alias("stops"), d.alias("dash")) for i, (k, m, r, s, d) in enumerate(made)))
    old = F.array(F.struct(F.lit(0).alias("sub"), "kinds", "major", "role", "stops", "dash"))
    out = rules.withColumn("n", F.explode(F.when(country, new).otherwise(old)))
    changed = ["kinds", "major", "role", "stops", "dash"]
    return out.select(*(F.col(f"n.{c}").alias(c) if c in changed else c for c in rules.columns), "n.sub")


def emphasise_labels(labels: DataFrame) -> DataFrame:
    """Political label rules that name countries are parted: countries larger and sooner, the rest between."""
    parted = F.col("political") & F.array_contains("kinds", "country")
    country = F.struct(F.lit(0).alias("sub"), F.array(F.lit("country")).alias("kinds"), F.lit(COUNTRY_NAME).alias("scale"), (F.col("priority") + SOONER).alias("priority"))
    rest = F.struct(F.lit(1).alias("sub"), F.array_remove("kinds", F.lit("country")).alias("kinds"), F.lit(DIVISION_NAME).alias("scale"), F.col("priority").alias("priority"))
    same = F.struct(F.lit(0).alias("sub"), F.col("kinds").alias("kinds"), F.col("scale").alias("scale"), F.col("priority").alias("priority"))
    out = labels.withColumn("n", F.explode(F.when(parted, F.array(country, rest)).otherwise(F.array(same))))
    return out.select(*(F.col(f"n.{c}").alias(c) if c in ("kinds", "scale", "priority") else c for c in labels.columns), "n.sub")


def label_candidates(features: DataFrame, rules: DataFrame, zoom: Column) -> DataFrame:
    """Features (layer, kind, kind_detail, geom_type, min_zoom, name, ...) by the label rules (layer, ord, kinds, details, placement,
    bias, z0, z1) that name them at a zoom: an equi-join on layer, the rest a residual."""
    f, r = features.alias("f"), rules.alias("r")
    takes = lambda many, one: (F.size(F.col(f"r.{many}")) == 0) | F.coalesce(F.array_contains(F.col(f"r.{many}"), F.col(f"f.{one}")), F.lit(False))
    on = (F.col("f.layer") == F.col("r.layer")) & takes("kinds", "kind") & takes("details", "kind_detail") & labels_shape(F.col("r.placement"), F.col("f.geom_type"))
    on = on & allows(zoom, F.col("r.bias"), F.col("r.z0"), F.col("r.z1"), F.col("f.min_zoom"))
    return f.join(r, on).where("f.name <> ''").select("f.*", "r.ord")


def draw_order(pieces: DataFrame) -> DataFrame:
    """Polygons (fid, tile, ord, sort_rank, area, pos) put together by id over tiles, with the place in which each is drawn: lower sort
    rank first, then larger, then by rule and by where it was first seen."""
    one = pieces.groupBy("view_id", "fid", "ord").agg(F.coalesce(F.min_by("sort_rank", "pos"), F.lit(0.0)).alias("rank"), F.sum("area").alias("area"), F.min("pos").alias("pos"), F.count("*").alias("tiles"))
    from pyspark.sql import Window as W

    order = [F.col("rank"), F.col("area").desc(), F.col("ord"), F.col("pos")]
    return one.withColumn("place", F.row_number().over(W.partitionBy("view_id").orderBy(*order)))


def extra_features(places: DataFrame, tiles: DataFrame) -> DataFrame:
    """places (layer, lat, lon, ...) a caller adds, as points (px, py) of the tiles (layer, z, x, y, extent) that hold them.  A place has
    one key a zoom, so it is an equi-join; one on the world's far edge is in no tile."""
    zooms = tiles.select("z").distinct()  # at most 32
    n = M.side(F.col("z"))
    keyed = places.join(F.broadcast(zooms)).withColumns({"__x": M.world_x(F.col("lon")) * n, "__y": M.world_y(F.col("lat")) * n})
    keyed = keyed.withColumns({"x": F.floor("__x").cast("long"), "y": F.floor("__y").cast("long")})
    held = keyed.join(tiles.select("layer", "z", "x", "y", "extent"), ["layer", "z", "x", "y"])
    inside = lambda w, t: F.floor((F.col(w) - F.col(t)) * F.col("extent")).cast("int")
    return held.withColumns({"px": inside("__x", "x"), "py": inside("__y", "y")}).drop("__x", "__y")


#: Contrast that a palette must keep (fixed values): the map's inks are quiet, what is drawn on them reads, two of them differ.
QUIET, OVER, LETTERS, GAP, APART, CHROMA = 4.5, 3.0, 4.5, 3.0, 6.0, 32.0
#: Whose contrast with whom has which least and most, and the fault's name.
CONTRASTS = [("context", "background", None, QUIET, "loud"), ("overlay", "underfoot", OVER, None, "lost"), ("label", "background", LETTERS, None, "unreadable"), ("label", "road", LETTERS, None, "unreadable"), ("gap", "background", GAP, None, "gap unseen"), ("distinct", "distinct", None, None, "alike")]


def contrast_faults(inks: DataFrame, by: str = "palette") -> DataFrame:
    """inks (palette, name, roles, r, g, b, edge) to every fault of each palette: (palette, fault, name, other, value).  roles are of
    background, context, underfoot, overlay, distinct, label, road, gap; shaded ground is inks of its own.  Inks of one edge are a
    line and its border, which need not differ.  One equi-join on palette and role; a palette holds tens of inks."""
    own = inks.withColumns({"__l": F.array(*colour.lab(F.col("r"), F.col("g"), F.col("b"))), "__y": colour.luminance(F.col("r"), F.col("g"), F.col("b"))})
    rules = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("role"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), F.lit(fault).alias("fault")) for a, b, low, high, fault in CONTRASTS))
    asked = own.withColumn("__r", F.explode(F.filter(rules, lambda x: F.array_contains("roles", x["a"])))).select(by, "__r.role", "__r.low", "__r.high", "__r.fault", "name", F.col("__y").alias("ay"), F.col("__l").alias("al"), F.col("edge").alias("ae"))
    offered = own.select(by, F.explode("roles").alias("role"), F.col("name").alias("other"), F.col("__y").alias("by_"), F.col("__l").alias("bl"), F.col("edge").alias("be"))
    met = asked.join(offered, [by, "role"])
    ratio = (F.greatest("ay", "by_") + 0.05) / (F.least("ay", "by_") + 0.05)
    faults = met.withColumn("value", ratio).where("fault <> 'alike' and (value < low or value > high)").select(by, "fault", "name", "other", "value")
    pairs = met.where("fault = 'alike' and name < other and not coalesce(ae = be, false)")
    # a plain filter would be pushed below the steps of the formula, and hold it as one huge expression
    only = lambda df, test: df.withColumn("value", F.explode(F.filter(F.array("value"), test)))
    alike = only(colour.with_difference(pairs, "value", *(tuple(F.get(c, i) for i in range(3)) for c in ("al", "bl"))), lambda v: v < APART)
    bright = only(own.where(F.array_contains("roles", "context")).withColumn("value", F.hypot(F.get("__l", 1), F.get("__l", 2))), lambda v: v > CHROMA)
    return faults.unionByName(alike.select(by, "fault", "name", "other", "value")).unionByName(bright.select(by, F.lit("saturated").alias("fault"), "name", F.lit(None).cast("string").alias("other"), "value"))
