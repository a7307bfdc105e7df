"""URL expressions: normal form, host, site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_of(url: Column) -> Column:
    """The URL's host without letter case, user, leading `www.` and port; null where there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#\s]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def normalize_url(url: Column, keep_query: bool = False) -> Column:
    """Scheme and host in lower case, path `/` where empty, no fragment, query only on request."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.concat(scheme, F.lit("://"), host, path, query if keep_query else F.lit(""))
