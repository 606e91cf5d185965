"""String, hash and numeric expressions on names: all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPACE = r"[ \t\n\x0B\f\r]"


def strip(c: Column) -> Column:
    """Leading and trailing white space removed (tabs and line feeds too)."""
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def normal_id(c: Column) -> Column:
    """Lower-cased, stripped identifier."""
    return F.lower(strip(c))


def metric_name(c: Column) -> Column:
    """Normal form of a metric's name: @ spelled out, separators to one underscore, none at the ends."""
    plain = F.regexp_replace(normal_id(c), "@", "_at_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[\s\-./]+", "_"), "_+", "_"), "^_|_$", "")


def task_name(c: Column) -> Column:
    """White space and underscores become hyphens."""
    return F.regexp_replace(normal_id(c), r"[\s_]+", "-")


def root_name(c: Column) -> Column:
    """Name without parentheses and other signs; the lower-cased name itself if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\(.*?\)", " "), "[^a-z0-9]+", " "))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lower(c))


def root_of(dataset: Column) -> Column:
    """The part of a dataset's name before the first slash."""
    return F.element_at(F.split(dataset, "/"), 1)


def clean_name(c: Column) -> Column:
    """Slash, hyphen and underscore as blanks."""
    return F.translate(c, "/-_", "   ")


def name_tokens(c: Column) -> Column:
    """The name itself, then its tokens, each once, in order."""
    return F.array_distinct(F.concat(F.array(c), F.filter(F.split(F.lower(c), r"[/\-_.\s#]+"), lambda t: t != "")))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased name, runs of other signs as one blank; a shorter name gives itself."""
    name = F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "))
    at = F.sequence(F.lit(1), F.length(name) - 2)
    made = F.array_distinct(F.transform(at, lambda i: name.substr(i, F.lit(3))))
    return F.when(F.length(name) >= 3, made).otherwise(F.array(name))


def words(c: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, one sign or more."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def tie_key(c: Column) -> Column:
    """A fixed permutation of ids, for ties: multiply-add modulo 2^64 as an exact decimal."""
    # fixed values: multiplier and increment of the tie order
    return (c.cast("decimal(19,0)") * F.lit("11400714819323198485").cast("decimal(20,0)") + F.lit("15111065706836454659").cast("decimal(20,0)")).cast("decimal(38,0)") % F.lit("18446744073709551616").cast("decimal(20,0)")


def md5_bucket(c: Column, n: int = 10000) -> Column:
    """MD5 of the string, as a 128-bit number modulo ``n``, from its two halves."""
    half = lambda at: F.conv(F.substring(F.md5(c), at, 16), 16, 10).cast("decimal(20,0)") % n
    return ((half(1) * F.lit((1 << 64) % n) + half(17)) % n).cast("long")


def number(c: Column) -> Column:
    """A tolerant number: blanks and one % stripped, a one-element list unwrapped; null if not finite or no number."""
    s = F.regexp_replace(strip(F.regexp_replace(strip(c.cast("string")), r"^\[([^,\[\]]*)\]$", "$1")), "%$", "")
    v = strip(s).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & ~F.lower(s).isin("true", "false"), v)


def utc_now() -> Column:
    """The query's time in UTC, to the second, as 2024-01-31T23:59:59+00:00."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
