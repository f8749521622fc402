"""Scalar functions as Column expressions, and a few Arrow functions where Spark has no built-in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0088


def half_even_long(c: Column) -> Column:
    """A double as a long, rounded half to even (a plain cast would cut)."""
    return F.bround(c, 0).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def zero_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def area_m2(label: Column) -> Column:
    """Square metres of a label such as '711 M2' or '1.2 HA'; 0, unreadable and null give null."""
    number = F.regexp_extract(label, r"^\s*([0-9][0-9,]*\.?[0-9]*)\s*(?i:m2|ha)\s*$", 1)
    value = F.when(number != "", F.regexp_replace(number, ",", "").try_cast("double"))
    return zero_as_null(F.round(F.when(F.upper(label).like("%HA%"), value * 10_000).otherwise(value), 2))


def serial_date(n: Column, earliest: str, latest: str) -> Column:
    """The date of a spreadsheet's day number; null outside earliest..latest."""
    day = F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))
    return F.when(day.between(F.lit(earliest).cast("date"), F.lit(latest).cast("date")), day)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    # least() passes over nulls
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def mercator_y(lat: Column) -> Column:
    """Web Mercator's y on the unit sphere."""
    return F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(lat) / 2))


# Fixed values of the New Zealand Transverse Mercator 2000 projection on the GRS80 ellipsoid
NZTM = {"a": 6378137.0, "f": 1 / 298.257222101, "lat0": 0.0, "lon0": 173.0, "k0": 0.9996, "e0": 1_600_000.0, "n0": 10_000_000.0}


def nztm_sql(lon: str, lat: str) -> tuple[str, str]:
    """SQL for easting and northing in metres of WGS84 degrees, by the series to the sixth order."""
    a, f, k0 = NZTM["a"], NZTM["f"], NZTM["k0"]
    e2 = f * (2 - f)
    e4, e6 = e2 * e2, e2**3
    c0, c2, c4, c6 = 1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, 3 / 8 * (e2 + e4 / 4 + 15 * e6 / 128), 15 / 256 * (e4 + 3 * e6 / 4), 35 * e6 / 3072
    p = f"radians({lat})"
    m = f"({a!r} * ({c0!r} * {p} - {c2!r} * sin(2 * {p}) + {c4!r} * sin(4 * {p}) - {c6!r} * sin(6 * {p})))"
    s2 = f"(sin({p}) * sin({p}))"
    nu = f"({a!r} / sqrt(1 - {e2!r} * {s2}))"
    rho = f"({a * (1 - e2)!r} / pow(1 - {e2!r} * {s2}, 1.5))"
    psi, t2, w, c = f"({nu} / {rho})", f"(tan({p}) * tan({p}))", f"radians({lon} - {NZTM['lon0']!r})", f"cos({p})"
    east = f"({NZTM['e0']!r} + {k0!r} * {nu} * {w} * {c} * (1 + pow({w} * {c}, 2) / 6 * ({psi} - {t2}) + pow({w} * {c}, 4) / 120 * (4 * pow({psi}, 3) * (1 - 6 * {t2}) + pow({psi}, 2) * (1 + 8 * {t2}) - {psi} * 2 * {t2} + {t2} * {t2})))"
    north = f"({NZTM['n0']!r} + {k0!r} * ({m} + {nu} * sin({p}) * {c} * pow({w}, 2) / 2 * (1 + pow({w} * {c}, 2) / 12 * (4 * pow({psi}, 2) + {psi} - {t2}))))"
    return east, north


def python_round(places: int):
    """An Arrow function that rounds half to even on the binary value, as Python does."""
    @F.pandas_udf(T.DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else round(float(v), places)).astype("float64")

    return run


# Letters with marks that names are written with, and without
MARKED, BARE = "āēīōūàáâäèéêëìíîïòóôöùúûüçñ", "aeiouaaaaeeeeiiiioooouuuucn"
#: Words of place names that are written short.
SHORT_FORMS = {"saint": "st", "mount": "mt"}


def name_key(c: Column) -> Column:
    """A place name reduced for matching: lower case, no accents, saint and mount shortened, letters and digits only."""
    out = F.regexp_replace(F.translate(F.lower(c), MARKED, BARE), r"\p{M}", "")
    for word, short in SHORT_FORMS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    return F.regexp_replace(out, "[^a-z0-9]", "")


def has_han(c: Column) -> Column:
    """Whether a text has a Chinese character."""
    return F.coalesce(c.rlike(r"[一-鿿]"), F.lit(False))


def evidence(text: Column, at: Column, length: Column, around: int = 34) -> Column:
    """The text around a match (1-based place and length), with dots where it was cut."""
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at + length - 1 + around)
    cut = F.trim(F.substring(text, start, end - start + 1))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))


def trim_to_sentence(text: Column, most: int) -> Column:
    """Text of at most `most` characters, cut behind the last sentence end that fits, else at the last blank."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])(\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(text) <= most, text).when(whole != "", whole).when(word != "", word).otherwise(head)


def sum_dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of numbers, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def source_form(c: Column) -> Column:
    """A source's name as mix_target has it: trimmed, lower case, underscores between words."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


def label_form(c: Column) -> Column:
    """A language label as a code: trimmed, lower case, cut at the first - or _."""
    return F.element_at(F.split(F.lower(F.trim(c)), "[-_]"), 1)
