"""Names: identifiers in lists, pick patterns, zones, units, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def id_list(c: str | Column) -> Column:
    """Integers of a list separated by commas or blanks; tokens that are no numbers are left out, an empty list is NULL."""
    tokens = F.filter(F.split(F.trim(col(c)), r"[,\s]+"), lambda t: t.try_cast("double").isNotNull() & ~F.isnan(t.try_cast("double")))
    ids = F.transform(tokens, lambda t: t.try_cast("double").cast("int"))
    return F.when(F.size(ids) > 0, ids)


def required_key(c: str | Column, what: str = "alignment_dir") -> Column:
    """The trimmed value; blank, nan, none and NULL raise."""
    x = F.trim(col(c))
    bad = x.isNull() | x.isin("") | F.lower(x).isin("nan", "none")
    return F.when(bad, F.raise_error(F.lit(f"{what} is missing"))).otherwise(x)


def pick_pattern(pattern: str) -> str:
    """Anchored regular expression of a file pattern with one * (an index) that ends in .star."""
    p = pattern.strip()
    if p.count("*") != 1 or not p.endswith(".star"):
        raise ValueError("a pattern has one * and ends in .star")
    before, after = p.split("*")
    return f"^{re.escape(before)}(\\d+){re.escape(after)}$"


def file_index(name: str | Column, pattern: str) -> Column:
    got = F.regexp_extract(col(name), pick_pattern(pattern), 1)
    return F.when(got != "", got.cast("int"))


def set_name(path: str | Column) -> Column:
    """The path part that ends in _tomograms, without that suffix; unknown if there is none."""
    got = F.regexp_extract(col(path), r"/([^/]+)_tomograms(?:/.*)?$", 1)
    return F.when(got == "", "unknown").otherwise(got)


def zone_name(pre: str | Column, post: str | Column) -> Column:
    return F.concat(F.lit("cleft_pre"), col(pre).cast("string"), F.lit("_post"), col(post).cast("string"))


def zone_pre(zone: str | Column) -> Column:
    got = F.regexp_extract(col(zone), r"pre(\d+)", 1)
    return F.when(got != "", got.cast("int"))


def zone_post(zone: str | Column) -> Column:
    got = F.regexp_extract(col(zone), r"post(\d+)", 1)
    return F.when(got != "", got.cast("int"))


def safe_name(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_")


# Words of a column name, words that exclude it, its unit, and the marks of a name that has a unit.
UNITS = (
    (("distance", "cleft_width", "diameter", "radius", "dimension"), (), "_nm", ("_nm", "_um")),
    (("area", "surface"), (), "_um2", ("_nm2", "_um2", "_nm\u00b2", "_um\u00b2")),
    (("volume",), ("sphericity",), "_um3", ("_nm3", "_um3", "_nm\u00b3", "_um\u00b3")),
    (("aunp",), (), "_per_um2", ("_per_um2", "_per_um\u00b2")),
    (("coordinatex", "coordinatey", "coordinatez", "center_x", "center_y", "center_z", "point_x", "point_y", "point_z"), (), "_nm", ("_nm", "_um")),
)


def with_unit(name: str) -> str:
    """Column name with the unit of the first rule that fits it and none of whose marks it has.

    The rule of particles asks for a density, and the last one also takes the bare names of axes.
    """
    low = name.lower()
    for words, without, unit, marks in UNITS:
        fits = any(w in low for w in words) and not any(w in low for w in without)
        if unit == "_per_um2":
            fits = fits and "density" in low
        if words is UNITS[-1][0]:
            fits = fits or low in ("x", "y", "z")
        if fits and not any(m in name for m in marks):
            return name + unit
    return name
