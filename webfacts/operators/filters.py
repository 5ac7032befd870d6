"""Row filters. Every filter is a column predicate, so it reaches the file scan where the source allows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.functions import color, url
from webfacts.functions.base import ColumnOrName, col, lookup
from webfacts.functions.vector import first_bad_index, vector_error

# Request type -> stored motion category.
MOTION_CATEGORY = {
    "animation": "css_animation",
    "transition": "page_transition",
    "transform": "micro_interaction",
    "scroll": "scroll_trigger",
    "hover": "hover_effect",
    "keyframe": "css_animation",
}


def all_of(*conds: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conds if c is not None], F.lit(True))


def equal_where_given(**wanted) -> Column:
    """AND of ``column = value``; a value of None adds no predicate."""
    return all_of(*[F.col(c) == v for c, v in wanted.items() if v is not None])


def motion_filter(type=None, trigger=None, min_duration=None, max_duration=None, *, category="category", trigger_col="trigger_type", animation="animation") -> Column:
    duration = F.get_json_object(F.col(animation), "$.duration").try_cast("double")
    return all_of(
        None if type is None else F.col(category) == MOTION_CATEGORY.get(type, type),
        None if trigger is None else F.col(trigger_col) == trigger,
        None if min_duration is None else duration >= min_duration,
        None if max_duration is None else duration <= max_duration,
    )


def motion_category(type_col: ColumnOrName) -> Column:
    return F.coalesce(lookup(MOTION_CATEGORY, col(type_col)), col(type_col))


def color_within(c1: ColumnOrName, c2: ColumnOrName, tolerance: float = 15) -> Column:
    return F.coalesce(color.delta_e_hex(c1, c2) <= tolerance, F.lit(False))


def color_near(c: Column, reference: tuple[float, float, float], tolerance: float = 10) -> Column:
    """CIE76 distance of a hex colour to a fixed Lab colour, such as a neutral grey; an invalid colour never matches."""
    return F.coalesce(color.delta_e_to(c, color.lab(*reference)) <= tolerance, F.lit(False))


def visual_filter(features: ColumnOrName, theme=None, min_contrast=None, dominant=None, tolerance=15, min_density=None, max_density=None, min_whitespace=None) -> Column:
    """Struct predicates; a missing struct or field fails an active sub-filter and passes an inactive one."""
    v = col(features)

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return all_of(
        None if theme is None else sure(v["theme"]["type"] == theme),
        None if min_contrast is None else sure(v["theme"]["contrast_ratio"] >= min_contrast),
        None if dominant is None else color_within(F.lit(dominant), v["colors"]["dominant"], tolerance),
        None if min_density is None else sure(v["density"]["content_density"] >= min_density),
        None if max_density is None else sure(v["density"]["content_density"] <= max_density),
        None if min_whitespace is None else sure(v["density"]["whitespace_ratio"] >= min_whitespace),
    )


def member(c: ColumnOrName, values: list, confidence: ColumnOrName | None = None, minimum: float | None = None) -> Column:
    return all_of(col(c).isin(values), None if minimum is None else col(confidence) >= minimum)


def has_category(differences: ColumnOrName, category: str) -> Column:
    return F.exists(col(differences), lambda d: d["category"] == category)


def responsive_filter(category=None, min_width=None, max_width=None, min_diff=None, viewports=None, *, differences="differences", breakpoints="breakpoints", diffs="screenshot_diffs") -> Column:
    """The width bounds are two separate tests: different breakpoints may satisfy them."""
    return all_of(
        None if category is None else has_category(differences, category),
        None if min_width is None else F.exists(F.col(breakpoints), lambda b: b["width"] >= min_width),
        None if max_width is None else F.exists(F.col(breakpoints), lambda b: b["width"] <= max_width),
        None if min_diff is None else F.exists(F.col(diffs), lambda s: s["diff_percentage"] >= min_diff),
        None
        if viewports is None
        else F.exists(F.col(diffs), lambda s: (s["viewport1"] == viewports[0]) & (s["viewport2"] == viewports[1])),
    )


def name_contains(c: ColumnOrName, part: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(part.lower()))


def palette_mode(c: ColumnOrName, mode: str) -> Column:
    return col(c) == ("system" if mode == "both" else mode)


def newer_than(c: ColumnOrName, as_of: Column, days: int = 90) -> Column:
    return col(c) > as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def owned_by(owner: ColumnOrName, user) -> Column:
    """Rows of one tenant; no tenant means no rows."""
    if user is None or str(user).strip() == "":
        return F.lit(False)
    return col(owner) == F.lit(user)


def split_vectors(df: DataFrame, vector: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantine with ``error`` and ``bad_index``)."""
    marked = df.withColumn("error", vector_error(vector, dims))
    good = marked.filter("error IS NULL").drop("error")
    bad = marked.filter("error IS NOT NULL").withColumn("bad_index", first_bad_index(vector))
    return good, bad


def on_domains(df: DataFrame, url_col: str, domains: DataFrame | list[str], allow: bool = True, host: Column | None = None) -> DataFrame:
    """Keep (or drop) rows whose host is one of the domains or below it. ``host`` replaces the usual host of the URL.

    A literal list becomes a predicate. A table is matched by exploding the host into its suffixes and
    joining on equality, so a long list needs no row-by-row comparison.
    """
    host = url.url_host(url_col) if host is None else host
    if isinstance(domains, list):
        hit = F.lit(False)
        for d in domains:
            hit = hit | url.in_domain(host, d)
        hit = F.coalesce(hit, F.lit(False))
        return df.filter(hit if allow else ~hit)
    hosts = df.select(host.alias("_host")).distinct()
    listed = (
        hosts.select("_host", F.explode(url.host_suffixes("_host")).alias("domain"))
        .join(domains.select("domain").distinct(), "domain", "left_semi")
        .select("_host")
        .distinct()
    )
    return df.withColumn("_host", host).join(listed, "_host", "left_semi" if allow else "left_anti").drop("_host")


def light_response(df: DataFrame, keep: list[str], arrays: dict[str, int] | None = None, texts: dict[str, int] | None = None) -> DataFrame:
    """Summary projection: named columns, arrays cut to at most 1000 elements, long texts cut."""
    arrays, texts = arrays or {}, texts or {}
    if any(not 0 <= n <= 1000 for n in arrays.values()):
        raise ValueError("array limit must be within 0..1000")
    cols = []
    for c in keep:
        if c in arrays:
            cols.append(F.slice(F.col(c), 1, arrays[c]).alias(c))
        elif c in texts:
            cols.append(F.left(F.col(c), F.lit(texts[c])).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
