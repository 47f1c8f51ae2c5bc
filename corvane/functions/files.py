"""Paths, formats, checksums, ids and sizes as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats, other spellings of them, and what can be done with which.
FORMATS = ("pdf", "docx", "pptx", "xlsx", "txt", "html", "md", "png", "jpg", "jpeg", "tiff", "webp", "bmp", "gif")
ALIASES = {"tif": "tiff", "htm": "html", "markdown": "md", "mdown": "md", "text": "txt"}
IMAGES = ("png", "jpg", "jpeg", "tiff", "webp", "bmp", "gif")
RENDERABLE = (*IMAGES, "pdf", "docx", "pptx")
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def canonical(value: str) -> str:
    """A format by any of its spellings."""
    name = value.strip().lower().lstrip(".")
    name = ALIASES.get(name, name)
    if name not in FORMATS:
        raise ValueError(f"unknown format {value!r}; known: {', '.join(FORMATS)}")
    return name


def suffix(path: Column) -> Column:
    """What follows the last dot of the last part of a path, lower-cased; null without one."""
    found = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.when(found != "", found)


def format_of(path: Column) -> Column:
    """The canonical format by suffix; null if unknown."""
    raw = suffix(path)
    name = F.coalesce(F.create_map(*map(F.lit, chain(*ALIASES.items())))[raw], raw)
    return F.when(name.isin(*FORMATS), name)


def is_image(fmt: Column) -> Column:
    return fmt.isin(*IMAGES)


def is_renderable(fmt: Column) -> Column:
    return fmt.isin(*RENDERABLE)


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its suffix; the default title."""
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


def checksum(content: Column, length: int | None = None) -> Column:
    """SHA-256 in hexadecimal, or its first length digits."""
    if length is not None and length < 1:
        raise ValueError("length must be at least 1")
    digest = F.sha2(content, 256)
    return digest if length is None else F.substring(digest, 1, length)


def stable_id(prefix: str, key: Column) -> Column:
    """prefix_ and 12 hexadecimal digits of the key's SHA-256; the same key has the same id in every run."""
    if not prefix:
        raise ValueError("an id needs a prefix")
    return F.concat(F.lit(prefix + "_"), checksum(key.cast("string"), 12))


def human_size(size: Column) -> Column:
    """Bytes in steps of 1024: bytes as they are, else with one decimal; halves go to the even digit."""
    amount = F.abs(size).cast("double")
    said = lambda k: F.format_string(f"%.1f {UNITS[k]}", F.bround(amount / 1024.0**k, 1))
    out = said(5)
    for k in range(4, 0, -1):
        out = F.when(amount < 1024.0 ** (k + 1), said(k)).otherwise(out)
    out = F.when(amount < 1024.0, F.concat(F.abs(size).cast("long").cast("string"), F.lit(" B"))).otherwise(out)
    return F.when(size < 0, F.concat(F.lit("-"), out)).otherwise(out)


def zoom(dpi: Column) -> Column:
    return dpi / 72.0


def fitted(width: Column, height: Column, limit: int) -> Column:
    """Sizes of an image scaled down to limit on its longer side, at least 1 each; halves go to the even number."""
    scale = F.lit(float(limit)) / F.greatest(width, height)
    small = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("int"))
    fits = F.greatest(width, height) <= limit
    return F.struct(F.when(fits, width.cast("int")).otherwise(small(width)).alias("width"), F.when(fits, height.cast("int")).otherwise(small(height)).alias("height"))
