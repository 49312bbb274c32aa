"""Dates, names, labels and numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles of the categories.
TITLES = {"screenshot": "Screenshots", "document": "Documents", "identity": "Identity & cards", "places": "Places", "no_faces": "No faces", "pets": "Pets", "video": "Videos"}
UNNAMED = "Unnamed"
GRID = 0.05


def taken_at(exif: Column) -> Column:
    """Epoch seconds of ``yyyy:MM:dd HH:mm:ss`` in the session's time zone; null for anything else."""
    return F.try_to_timestamp(exif, F.lit("yyyy:MM:dd HH:mm:ss")).cast("double")


def signed(value: Column, ref: Column, negative: str) -> Column:
    """A coordinate with the sign of its hemisphere."""
    return F.when(F.coalesce(ref == negative, F.lit(False)), -value).otherwise(value)


def stem(name: Column) -> Column:
    return F.when(extension(name) == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1))


def extension(name: Column) -> Column:
    """What follows the last dot, if something precedes it."""
    return F.regexp_extract(name, r"^.+\.([^.]+)$", 1)


def numbered(name: Column, n: Column) -> Column:
    """``name`` for 1, ``stem (n).ext`` from 2."""
    e = extension(name)
    return F.when(n <= 1, name).otherwise(F.concat(stem(name), F.lit(" ("), n.cast("string"), F.lit(")"), F.when(e == "", F.lit("")).otherwise(F.concat(F.lit("."), e))))


def last_component(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def full_path(root: Column, relative: Column) -> Column:
    """``root/relative``; the relative path alone without a root."""
    return F.when(F.coalesce(root, F.lit("")) == "", relative).otherwise(F.concat_ws("/", root, relative))


def relative_path(path: Column, root: str) -> Column:
    """What follows ``root/``, else the last component."""
    inside = root.rstrip("/") + "/"
    return F.when(path.startswith(inside), path.substr(F.lit(len(inside) + 1), F.length(path))).otherwise(last_component(path))


def display_name(name: Column) -> Column:
    return F.coalesce(name, F.lit(UNNAMED))


def cleaned(name: Column) -> Column:
    """Trimmed; null where nothing is left, which takes a name away."""
    return F.nullif(F.trim(name), F.lit(""))


def grid_key(lat: Column, lon: Column) -> Column:
    """``i,j`` of a coordinate's cell; halves round away from zero."""
    return F.concat_ws(",", F.round(lat / GRID).cast("long"), F.round(lon / GRID).cast("long"))


def match_percent(distance: Column) -> Column:
    return F.round((F.lit(1.0) - distance) * 100).cast("int")


def review_label(distance: Column) -> Column:
    """``likely same · 84% · 0.16`` for a candidate pair's distance."""
    kind = F.when(distance < 0.3, "likely same").otherwise("uncertain")
    return F.format_string("%s · %.0f%% · %.2f", kind, F.greatest(F.lit(0.0), F.lit(1.0) - distance) * 100, distance)


def short_count(n: Column) -> Column:
    return F.when(n >= 1000, F.format_string("%.1fk", n / 1000.0)).otherwise(n.cast("string"))


def byte_size(n: Column) -> Column:
    """In the largest unit that leaves a whole: decimal units, a digit after the point from MB."""
    return F.when(n < 1000, F.format_string("%d bytes", n)).when(n < 1e6, F.format_string("%.0f KB", n / 1e3)).when(n < 1e9, F.format_string("%.1f MB", n / 1e6)).otherwise(F.format_string("%.2f GB", n / 1e9))


def face_line(x: Column, y: Column, w: Column, h: Column, person: Column) -> Column:
    """A face's person (a dash for none) and box, three digits each."""
    return F.format_string("person %s · bbox [x=%.3f y=%.3f w=%.3f h=%.3f]", F.coalesce(person.cast("string"), F.lit("—")), x, y, w, h)


def title(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[category], F.lit(""))
