"""Application and container identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings used by the metric feeds.
APP_PREFIX = "application_"
CONTAINER_PREFIX = "ContainerResource_container_e"
HOST_PREFIX = "Hostname="
# container_[e<epoch>_]<cluster timestamp>_<application>_<attempt>_<container>
CONTAINER_APP = r"container_(?:e\d+_)?([^_]+_[^_]+)_"


def app_id_from_container(container: Column) -> Column:
    """``…container_e17_1489_0012_01_000002`` → ``application_1489_0012``; null if it does not parse."""
    number = F.regexp_extract(container, CONTAINER_APP, 1)
    return F.when(number != "", F.concat(F.lit(APP_PREFIX), number))


def _digits(text: Column, prefix: str, exact: bool) -> Column:
    bare = F.replace(F.replace(text, F.lit(prefix), F.lit("")), F.lit("_"), F.lit(""))
    return bare.try_cast("decimal(38,0)" if exact else "double")


def app_id_number(app: Column, exact: bool = False) -> Column:
    """Application id as a number.

    As a double, ids beyond 2^53 share values, so it serves as a feature and
    never as a key; ``exact`` gives ``decimal(38,0)``.
    """
    return _digits(app, APP_PREFIX, exact)


def container_id_number(container: Column, exact: bool = False) -> Column:
    """Container id as a number, with the same caveat as :func:`app_id_number`."""
    return _digits(container, CONTAINER_PREFIX, exact)


def strip_host_prefix(host: Column) -> Column:
    """``Hostname=node7`` → ``node7``."""
    return F.replace(host, F.lit(HOST_PREFIX), F.lit(""))
