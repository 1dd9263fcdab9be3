"""Scalar text functions as Column expressions, and their pattern translators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The punctuation that separates tokens in the symbol index, and in ranked queries.
INDEX_PUNCTUATION = r"[_\-./:\\(){}\[\]<>,;'\"=+*#@!?|&^~`$%]"
QUERY_PUNCTUATION = r"[_\-./:\\(){}\[\]<>,;'\"=+]"
#: Fixed value: paths of tests.
TEST_PATH = r"(?i)(\.(test|spec|e2e)\.(ts|tsx|js|jsx|py)$|__tests?__/)"
#: Languages by extension.
LANGUAGES = {
    "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx",
    "py": "python", "pyi": "python",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "sh": "shell", "bash": "shell", "zsh": "shell",
    "ps1": "powershell", "psm1": "powershell", "psd1": "powershell",
}


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def tokens(text: Column, punctuation: str = INDEX_PUNCTUATION) -> Column:
    """Lower-case tokens of two characters or more, in order, repeated ones kept."""
    spaced = F.lower(F.regexp_replace(split_camel(text), punctuation, " "))
    return F.filter(F.split(spaced, r"\s+"), lambda t: F.length(t) >= 2)


def raw_terms(text: Column) -> Column:
    """Lower-case words of a query: what is no word character separates."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\w\s]", " ")), r"\s+"), lambda t: F.length(t) > 0)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the text with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both.cast("double") / either)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves upwards, also below zero."""
    return F.floor(x * 10**digits + F.lit(0.5)) / F.lit(float(10**digits))


def language_of(path: Column) -> Column:
    """The language by the lower-cased extension; null if it is none that is known."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return known[extension]


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def top_directory(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def identifier(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_]", "_")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) in which a character (from 0) stands."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def lines_between(text: Column, first: Column, last: Column, most: int) -> Column:
    """Lines first to last (from 1, both included), at most so many, joined."""
    count = F.greatest(F.lit(0), F.least(last - first + 1, F.lit(most)))
    return F.array_join(F.slice(F.split(text, "\n"), first, count), "\n")


def normal_path(path: Column) -> Column:
    """The path with `.` and `..` resolved."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0)
        return F.when((part == ".") | (part == ""), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def loose_glob(pattern: str) -> str:
    """A regular expression, found anywhere and in any case: `**` any text, `*` and `?` within a segment."""
    out = re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m[0], pattern)
    out = out.replace("**", "\0").replace("*", "[^/]*").replace("?", "[^/]").replace("\0", ".*")
    return f"(?i){out}"


def segment_glob(pattern: str) -> str:
    """A regular expression for whole paths: `*` one whole segment, `**` any number of them, no wildcard inside a segment."""
    parts = pattern.split("/")
    parts = [p for k, p in enumerate(parts) if p != "**" or k == 0 or parts[k - 1] != "**"]  # one after the other they say the same

    def expression(at: int) -> str:
        """For the segments from there on; each brings the slash before it, but for the first."""
        if at == len(parts):
            return ""
        lead = "/" if at else ""
        if parts[at] == "**":
            rest = expression(at + 1)
            return f"(?:{lead}[^/]*(?:/[^/]*)*)?{rest}" if at else f"(?:[^/]*(?:/[^/]*)*){rest}" if at == len(parts) - 1 else f"(?:[^/]*/)*{expression(at + 1).removeprefix('/')}"
        one = "[^/]*" if parts[at] == "*" else re.sub(r"([^\w/])", r"\\\1", parts[at])
        return lead + one + expression(at + 1)

    return f"^{expression(0)}$"


def iso_timestamp(millis: Column) -> Column:
    """Milliseconds since 1970 as a time in UTC, whatever the session's time zone: 2024-01-02T03:04:05.678Z."""
    utc = F.timestamp_add("MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
