"""URL and path functions as expressions. Survey IDs in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqweft.functions.text import without_slashes

LATEST = "latest_assembly_versions/"  # fixed value: the folder of current versions
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def without_dots(path: Column) -> Column:
    """An absolute path without . and .. segments."""
    pieces = F.split(path, "/")
    last = F.element_at(pieces, -1)
    ended = F.when(last.isin(".", ".."), F.concat(pieces, F.array(F.lit("")))).otherwise(pieces)

    def fold(done: Column, piece: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
        return F.when(piece == ".", done).when(piece == "..", up).otherwise(F.concat(done, F.array(piece)))

    return F.array_join(F.aggregate(ended, F.array().cast("array<string>"), fold), "/")


def resolve(base: Column, href: Column) -> Column:
    """href against base by the rules for references with a scheme, //host, /path, ?query, #fragment or a relative path [URL-01]."""
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    path = F.when(_part(base, 3) == "", F.lit("/")).otherwise(_part(base, 3))
    folder = F.regexp_extract(path, "^(.*/)", 1)
    own, tail = _part(href, 3), F.concat(_part(href, 4), _part(href, 5))
    return (
        F.when(_part(href, 1) != "", href)
        .when(F.startswith(href, F.lit("//")), F.concat(_part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, without_dots(own), tail))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path, href))
        .when(F.startswith(href, F.lit("#")) | (href == ""), F.concat(root, _part(base, 3), _part(base, 4), href))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), tail))
    )


def latest_url(url: Column) -> Column:
    """The folder of current versions below a URL, with one slash between [URL-02]."""
    return F.concat(without_slashes(url), F.lit("/" + LATEST))


def local_path(root_url: Column, file_url: Column, out: Column) -> Column:
    """Where a file goes below out: its path below the root's, or its base name where it is not below [URL-03]."""
    root, path = F.concat(without_slashes(_part(root_url, 3)), F.lit("/")), without_dots(_part(file_url, 3))
    below = F.substring(path, F.length(root) + 1, F.length(path))
    inside = F.startswith(path, root) & (below != "")
    return F.concat(without_slashes(out), F.lit("/"), F.when(inside, below).otherwise(F.element_at(F.split(path, "/"), -1)))


def parent_name(path: Column) -> Column:
    """The parent folder's name of a percent-encoded file URI [SRC-04, URL-05]."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -2), F.lit("+"), F.lit("%2B")))
