"""Scalar columns: dates, weight keys, move gains; and plain helpers on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_safe_time(iso: Column) -> Column:
    """An ISO time for file names: without `-`, `:` and `Z`."""
    return F.translate(iso, "-:Z", "")


def iso_seconds(time: Column) -> Column:
    """A timestamp as ISO text; years after 9999 stand without the sign that date patterns put before them."""
    return F.ltrim(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("+"))


def epoch_iso(seconds: Column) -> Column:
    return iso_seconds(F.timestamp_seconds(seconds))


def utc_iso(time: Column) -> Column:
    """An RFC 3339 time with any offset, in UTC; null if it can't be read."""
    return iso_seconds(F.try_to_timestamp(F.regexp_replace(time, " ", "T")))


def date_problem(text: Column) -> Column:
    """Why a text is not a date like 2026-04-29, or null. February may have 29 days in any year."""
    x = F.coalesce(text, F.lit(""))
    year, month, day = (F.try_to_number(F.regexp_extract(x, r"^(\d{4})-(\d{2})-(\d{2})$", k), F.lit("9999")) for k in (1, 2, 3))
    most = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(~x.rlike(r"^\d{4}-\d{2}-\d{2}$"), "format").when(year < 1970, "year").when((month < 1) | (month > 12), "month").when((day < 1) | (day > most), "day")


def weight_key(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit("\0"), target)


def split_weight_key(key: Column, separator: str = "\0") -> tuple[Column, Column]:
    """Source and target around the first separator; null where there is none."""
    at = F.instr(key, separator)
    good = at > 0
    return F.when(good, F.substring(key, F.lit(1), at - 1)), F.when(good, F.substring(key, at + len(separator), F.length(key)))


def weight_problem(weight: Column) -> Column:
    return F.when(weight.isNull(), "missing").when(F.isnan(weight) | (F.abs(weight) == float("inf")), "not_finite").when(weight < 0, "negative")


def modularity_gain(k_in: Column, k_v: Column, sigma: Column, m: Column) -> Column:
    """Gain of moving a node into a community; a resolution parameter does not enter."""
    return F.when(m > 0, k_in - k_v * sigma / (2.0 * m)).otherwise(F.lit(0.0))


def cpm_gain(k_in: Column, gamma: Column, size: Column) -> Column:
    return k_in - gamma * size


def well_connected(k_in: Column, gamma: Column, size: Column, whole: Column) -> Column:
    return F.when((gamma == 0) | (whole == 0), True).otherwise(k_in >= gamma * (size - size * size / whole))


def truncate_256(text: Column, most: int = 256) -> Column:
    """At most 256 bytes of UTF-8, at a whole character: back from the first byte that is left out to one that begins a
    character (of four bytes at most, and not 10xxxxxx)."""
    raw = text.cast("binary")
    begins = lambda k: F.conv(F.hex(F.substring(raw, k + 1, 1)), 16, 10).cast("int").bitwiseAND(192) != 128
    cut = F.when(begins(most), most)
    for k in range(most - 1, most - 3, -1):
        cut = cut.when(begins(k), k)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), cut.otherwise(most - 3)).cast("string"))


def string_content(literal: str) -> str | None:
    """What stands between the quotes of a literal; None if it is empty or has none."""
    text = literal.strip()
    if len(text) >= 2 and text[0] in "\"'`" and text[-1] == text[0]:
        return text[1:-1] or None
    return None


def without_comments(jsonc: str) -> str:
    """JSON out of JSON with comments and trailing commas; strings stay as they are."""
    out: list[str] = []
    i, n = 0, len(jsonc)
    while i < n:
        c = jsonc[i]
        if c == '"':
            end = i + 1
            while end < n and jsonc[end] != '"':
                end += 2 if jsonc[end] == "\\" else 1
            out.append(jsonc[i : end + 1])
            i = end + 1
        elif jsonc.startswith("//", i):
            end = jsonc.find("\n", i)
            i = n if end < 0 else end
        elif jsonc.startswith("/*", i):
            end = jsonc.find("*/", i + 2)
            i = n if end < 0 else end + 2
        else:
            if c in "}]":  # a comma before it goes
                k = len(out) - 1
                while k >= 0 and out[k].isspace():
                    k -= 1
                if k >= 0 and out[k] == ",":
                    del out[k]
            out.append(c)
            i += 1
    return "".join(out)
