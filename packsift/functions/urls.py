"""Inspector locations and URL allow-lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsift.settings import INSPECTOR_HOST, MAX_URL_BYTES

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def inspector_base(name: Column, version: Column, url: Column, host: str = INSPECTOR_HOST) -> Column:
    """Move a download URL to the inspector host, below its project and version.

    Scheme, port, query and fragment are kept.
    """
    part = lambda group: F.regexp_extract(url, _URL, group)
    port = F.regexp_extract(part(2), r"(:[0-9]+)$", 1)
    return F.concat(
        part(1),
        F.lit(f"://{host}"),
        port,
        F.lit("/project/"),
        name,
        F.lit("/"),
        version,
        F.lit("/"),
        F.ltrim(part(3), F.lit("/")),
        F.lit("/"),
        part(4),
        part(5),
    )


def inspector_url(base: Column, path: Column) -> Column:
    """Struct ``(url, error)``: base and path joined as they are, at most 2048 bytes."""
    url = F.concat(base, path)
    error = F.when(F.octet_length(url) > MAX_URL_BYTES, F.lit(f"address-too-long: more than {MAX_URL_BYTES} bytes"))
    return F.struct(F.when(error.isNull(), url).alias("url"), error.alias("error"))


def is_allowed_origin(url: Column, origins: Sequence[str]) -> Column:
    """True for a bare allow-listed origin: no user, path, query or fragment."""
    origin = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#@\s]+)/*$", 1))
    no_default_port = F.regexp_replace(
        F.regexp_replace(origin, r"^(https://.*):443$", "$1"), r"^(http://.*):80$", "$1"
    )
    return no_default_port.isin(list(origins))


def is_tarball(url: Column) -> Column:
    return url.endswith(".tar.gz")
