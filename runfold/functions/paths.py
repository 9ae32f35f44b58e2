"""POSIX path expressions with Node ``path`` semantics, as Spark columns.

``resolve`` joins a relative path to a root. A path with ``.``, ``..`` or empty
components is rebuilt with one ``aggregate`` over its parts (a lambda, outside
generated code); all other paths, the normal case, are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(c) -> Column:
    """Absolute normal form of an absolute path: no '.', '..', '' parts."""
    p = _c(c)
    parts = F.split(p, "/", -1)
    empty = F.array().cast("array<string>")

    def step(acc, x):
        return (F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                 .when((x == "") | (x == "."), acc)
                 .otherwise(F.concat(acc, F.array(x))))

    rebuilt = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, empty, step), "/"))
    return F.when(p.rlike(r"//|/\.{1,2}(/|$)|./$"), rebuilt).otherwise(p)


def resolve_path(c, root: str) -> Column:
    """``path.resolve(root, p)``: absolute paths stay, relative ones hang
    under ``root``; the result is normalised."""
    p = _c(c)
    return normalize_path(F.when(F.startswith(p, F.lit("/")), p)
                          .otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p)))


def basename(c) -> Column:
    """Last component of a normal absolute path ('' for '/')."""
    return F.regexp_extract(_c(c), "([^/]*)$", 1)


def dirname(c) -> Column:
    """Everything before the last '/', or '/' for top-level entries."""
    p = _c(c)
    d = F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit("/")).otherwise(d)


def extname(c) -> Column:
    """Node ``extname`` of a path: from the last '.' of the base name, but ''
    when there is no dot, the dot is the first character, or the name is '..'.
    Lower-cased (the policy compares in lower case)."""
    b = basename(c)
    return F.lower(F.when(b == "..", F.lit(""))
                   .otherwise(F.regexp_extract(b, "(?s)^.+(\\.[^.]*)$", 1)))


def is_within(resolved, base: str) -> Column:
    """``!path.relative(base, p).startsWith('..')`` for normal absolute paths.

    True for ``base`` itself and for paths under it whose first component
    below ``base`` does not start with '..' (so a file named '..x' directly
    under ``base`` counts as outside, as in the source)."""
    p = _c(resolved)
    b = "/" + base.strip("/") if base.strip("/") else "/"
    prefix = b if b.endswith("/") else b + "/"
    rest = F.substring(p, len(prefix) + 1, 1 << 30)
    return (p == F.lit(b)) | (F.startswith(p, F.lit(prefix)) & ~F.startswith(rest, F.lit("..")))
