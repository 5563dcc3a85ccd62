"""Paths, slugs and globs, as strings on the driver and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_slash(path: str) -> str:
    return path.strip("/")


def join_path(*parts: str) -> str:
    return re.sub(r"/{2,}", "/", "/".join(p for p in parts if p))


def parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def tail(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def parent_column(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/?[^/]*$", "")


def tail_column(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def join_path_column(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), "/{2,}", "/")


def prefix_dictionary(content: str) -> list[str]:
    return [line.strip() for line in content.splitlines() if line.strip()]


def base_dir(pattern: str) -> str:
    """The folder above the first wildcard."""
    fixed = pattern.split("*", 1)[0]
    return fixed if fixed.endswith("/") else fixed.rpartition("/")[0] + "/" if "/" in fixed else ""


def is_glob(pattern: str) -> bool:
    return "*" in pattern


def glob_regex(pattern: str) -> str:
    """`**/` is any folders or none, `**` anything, `*` anything but a slash; all else stands for itself."""
    shown = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    return "^" + "".join(shown.get(p) or re.escape(p) for p in re.findall(r"\*\*/|\*\*|\*|[^*]+", pattern)) + "$"


def glob_match(path: str, pattern: str) -> bool:
    return re.match(glob_regex(pattern), path) is not None


def slug_of(path: str, pattern: str) -> str:
    """A file's slug: its path below the pattern's folder, without the ending, slashes as two hyphens."""
    below = path[len(base_dir(pattern)) :] if path.startswith(base_dir(pattern)) else path
    return re.sub(r"\.[^./]+$", "", below).replace("/", "--")


def slug_column(path: Column, pattern: str) -> Column:
    below = F.regexp_replace(path, "^" + re.escape(base_dir(pattern)), "")
    return F.replace(F.regexp_replace(below, r"\.[^./]+$", ""), F.lit("/"), F.lit("--"))


def path_of(slug: str, pattern: str) -> str:
    ending = re.search(r"\.[^./*]+$", pattern)
    return base_dir(pattern) + slug.replace("--", "/") + (ending[0] if ending else "")
