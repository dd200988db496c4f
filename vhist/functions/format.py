"""Text forms of results, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zoned_time(seconds: Column, offset_minutes: Column) -> Column:
    """`Mon Jan 2 15:04:05 2006 -0700` of epoch seconds at a row's own offset; needs the session's time zone to be UTC."""
    at = F.timestamp_seconds(seconds + offset_minutes * 60)
    size = F.abs(offset_minutes)
    zone = F.format_string("%s%02d%02d", F.when(offset_minutes < 0, "-").otherwise("+"), F.floor(size / 60).cast("int"), (size % 60).cast("int"))
    return F.concat(F.date_format(at, "EEE MMM d HH:mm:ss yyyy "), zone)


def oneline_subject(message: Column) -> Column:
    """The lines up to the first blank one, trimmed and joined by a space."""
    lines = F.split(F.trim(message, F.lit("\n")), "\n")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    first_blank = F.array_position(trimmed, "")
    return F.array_join(F.when(first_blank > 0, F.slice(trimmed, 1, first_blank.cast("int") - 1)).otherwise(trimmed), " ")


def indented(message: Column) -> Column:
    """A message with four spaces before each line and none at line ends; tabs go to the next multiple of eight."""
    lines = F.split(F.trim(message, F.lit("\n")), "\n")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("    "), F.regexp_replace(expand_tabs(x), "[ \\t\\r\\x0B\\f]+$", ""), F.lit("\n"))), "")


def expand_tabs(line: Column) -> Column:
    parts = F.split(line, "\t", -1)
    head = F.slice(parts, 1, F.size(parts) - 1)
    padded = F.transform(head, lambda x: F.concat(x, F.repeat(F.lit(" "), (8 - F.length(x) % 8).cast("int"))))
    return F.concat(F.array_join(padded, ""), F.element_at(parts, -1))


def medium_log(oid: Column, parents: Column, author: Column, seconds: Column, offset_minutes: Column, message: Column) -> Column:
    """One commit as a log shows it; merges name their parents by seven digits."""
    short = F.array_join(F.transform(parents, lambda p: F.substring(p, 1, 7)), " ")
    merge = F.when(F.size(parents) > 1, F.concat(F.lit("Merge: "), short, F.lit("\n"))).otherwise("")
    body = F.when(F.trim(message, F.lit("\n")) == "", "").otherwise(indented(message))
    return F.concat(F.lit("commit "), oid, F.lit("\n"), merge, F.lit("Author: "), author, F.lit("\nDate:   "), zoned_time(seconds, offset_minutes), F.lit("\n\n"), body)


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 6, "0")


def quoted_path(path: Column) -> Column:
    """A path as patches name it: in double quotes with C escapes if it has quotes, backslashes, controls or bytes over 127."""
    odd = path.rlike(r'[\x00-\x1F\x7F"\\]') | (F.octet_length(path) != F.length(path))
    named = F.create_map(*[F.lit(x) for pair in {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r", 34: '"', 92: "\\"}.items() for x in pair])
    raw = F.encode(path, "UTF-8")

    def one(i: Column) -> Column:
        code = F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
        escape = F.try_element_at(named, code)
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(code.cast("string"), 10, 8), 3, "0"))
        return F.when(escape.isNotNull(), F.concat(F.lit("\\"), escape)).when((code < 32) | (code > 126), octal).otherwise(F.chr(code))

    return F.when(odd, F.concat(F.lit('"'), F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(path)), one), ""), F.lit('"'))).otherwise(path)
