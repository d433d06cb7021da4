"""What a log file's name says: its day, its type and its kind of source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DATE_PATTERNS = (
    r"(?<!\d)(20\d{2})[-_.](0[1-9]|1[0-2])[-_.](0[1-9]|[12]\d|3[01])(?!\d)",
    r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)",
)
UNSPECIFIED = "Unspecified"
DEFAULT_EXTENSIONS = (".log", ".txt", ".xml", ".csv", ".json")


def copy_label(path: Column, other: Column) -> Column:
    """How one of two copies is shown: its name, with its folder in front where both have one name."""
    folder = F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)
    return F.when((leaf(path) == leaf(other)) & (folder != ""), F.concat(folder, F.lit("/"), leaf(path))).otherwise(leaf(path))


def leaf(name: Column) -> Column:
    """The last part of a path with slashes of either kind."""
    return F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)


def stem(name: Column) -> Column:
    """The leaf without its last suffix; a leading dot opens no suffix."""
    return F.regexp_replace(leaf(name), r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(leaf(name), r".(\.[^.]+)$", 1))


def date_from_name(name: Column) -> Column:
    """The first calendar date in the name, with separators before without; null if there is none."""

    def dates(pattern: str) -> Column:
        found = F.regexp_extract_all(leaf(name), F.lit(pattern), F.lit(0))
        as_dates = F.transform(found, lambda d: F.try_to_timestamp(F.regexp_replace(d, r"\D", ""), F.lit("yyyyMMdd")).cast("date"))
        return F.get(F.filter(as_dates, lambda d: d.isNotNull()), 0)

    return F.coalesce(*map(dates, DATE_PATTERNS))


def log_type(name: Column) -> Column:
    """The stem in front of the earliest date, without separators around it."""
    base = stem(name)
    cuts = [F.when(base.rlike(p), F.length(F.regexp_extract(base, f"^(.*?){p}", 1))) for p in DATE_PATTERNS]
    cut = F.coalesce(F.least(*cuts), F.length(base))
    return F.coalesce(F.nullif(F.trim(F.substring(base, F.lit(1), cut), F.lit("-_. ")), F.lit("")), F.lit(UNSPECIFIED))


def source_kind(name: Column) -> Column:
    """The stem without any date, separators collapsed; ``Log`` if nothing is left."""
    text = stem(name)
    for pattern in DATE_PATTERNS:
        text = F.regexp_replace(text, pattern, " ")
    text = F.trim(F.regexp_replace(text, r"[-_. ]+", " "))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Log"))


def extensions(values: list[str] | None) -> list[str]:
    """Suffixes with a leading dot in lower case; at least one is needed."""
    out = sorted({(v if v.startswith(".") else f".{v}").lower() for v in (values or DEFAULT_EXTENSIONS) if v})
    if not out:
        raise ValueError("at least one file extension must be allowed")
    return out


def type_matches(kind: Column, patterns: list[str] | None) -> Column:
    """Case-insensitive match against names with ``*``, ``?`` and ``[...]``; no patterns match everything."""
    import fnmatch

    if not patterns:
        return F.lit(True)
    regexes = [fnmatch.translate(p.lower()).replace("(?s:", "(?s)(?:").replace("\\Z", "$").replace("\\z", "$") for p in patterns]
    return F.lower(kind).rlike("|".join(f"^(?:{r})" for r in regexes))
