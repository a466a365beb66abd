"""Texts of files, and small scalar parsers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8_text(content: Column) -> Column:
    """The whole content as text; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("binary").cast("string"))


def strict_text(content: Column) -> Column:
    """The whole content as text, NULL if any byte is no UTF-8."""
    return F.try_validate_utf8(content.cast("binary").cast("string"))


def strip(text: Column) -> Column:
    """Remove white space at both ends, tabs and the like included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 1-based character position."""
    before = F.substr(text, F.lit(1), position - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def semver(version: Column) -> Column:
    """``struct(major, minor, patch)`` or NULL; structs compare field by field."""
    bare = F.regexp_replace(version, r"^v", "")
    parts = F.split(bare, r"\.")

    def number(i):
        part = F.try_element_at(parts, F.lit(i + 1))
        return F.when(part.rlike(r"^\+?[0-9]{1,18}$"), part.try_cast("bigint"))

    nums = [number(i) for i in range(3)]
    limit = 2 ** 32 - 1
    ok = (F.size(parts) == 3) & (nums[0] <= limit) & (nums[1] <= limit) & (nums[2] <= limit)
    return F.when(ok, F.struct(nums[0].alias("major"), nums[1].alias("minor"), nums[2].alias("patch")))


def front_matter_description(text: Column) -> Column:
    """``description:`` of a leading ``---`` block: inline text, or the indented lines below it."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("open"), F.lit(False).alias("done"))

    def step(s, line):
        trimmed = strip(line)
        key = trimmed.startswith("description:")
        inline = F.regexp_replace(F.regexp_replace(strip(F.substr(trimmed, F.lit(13))),
                                                   r'^"+|"+$', ""), r"^'+|'+$", "")
        indented = line.startswith(" ") | line.startswith("\t")
        joined = F.when(s["out"] == "", trimmed).otherwise(F.concat(s["out"], F.lit(" "), trimmed))
        return (F.when(s["done"], s)
                .when(s["open"] & indented,
                      F.struct(joined.alias("out"), F.lit(True).alias("open"), F.lit(False).alias("done")))
                .when(key & (inline != ""),
                      F.struct(inline.alias("out"), F.lit(False).alias("open"), F.lit(True).alias("done")))
                .when(key, F.struct(s["out"].alias("out"), F.lit(True).alias("open"), F.lit(False).alias("done")))
                .otherwise(F.struct(s["out"].alias("out"), F.lit(False).alias("open"), F.lit(False).alias("done"))))

    return F.nullif(F.aggregate(lines(block), state, step)["out"], F.lit(""))
