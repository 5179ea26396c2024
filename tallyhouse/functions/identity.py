"""Keys and labels derived from paths and source systems."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse import constants as K
from tallyhouse.functions.models import trimmed


def file_stem(path: Column, suffix: str = r"\.[^./]*") -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), rf"(?i){suffix}$", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def plain_path(uri: Column) -> Column:
    """Path as stored, from the percent-encoded URI that file metadata reports."""
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def workspace_key(path: Column, root: str) -> Column:
    """First path segment below the root; the path itself when it lies elsewhere."""
    base = re.sub(_SCHEME, "", root).rstrip("/") + "/"
    local = F.regexp_replace(path, _SCHEME, "")
    first = F.element_at(F.split(F.substr(local, F.lit(len(base) + 1)), "/"), 1)
    return F.when(local.startswith(base) & (first != ""), first).otherwise(path)


def workspace_label(key: Column) -> Column:
    """Percent-decoded key when that yields an absolute path, else the key.

    "+" and incomplete escapes stand for themselves, so both are escaped before decoding.
    """
    safe = F.regexp_replace(F.replace(key, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(safe)
    absolute = decoded.startswith("/") | decoded.rlike(r"(?s)^.:\\")
    return F.when(key.contains("%") & absolute, decoded).otherwise(key)


def source_from_app_type(app_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in K.APP_TYPE_SOURCES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, trimmed(F.lower(app_type))), app_type)


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def event_key(*parts: Column, sep: str = ":") -> Column:
    """Replay-safe identity of a request; absent parts count as empty text."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
