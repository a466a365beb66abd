"""Path arithmetic as column expressions (``/`` separated paths)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskledger.catalog import names


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    cut = F.length(path) - F.length(basename(path)) - 1
    return (F.when(cut > 0, F.left(path, cut))
            .when(cut == 0, F.lit("/")).otherwise(F.lit("")))


def extension(name: Column) -> Column:
    """Text after the last dot; empty for none and for plain dot files."""
    return F.regexp_extract(name, r"^.+\.([^.]*)$", 1)


def file_stem(name: Column) -> Column:
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(stem == "", name).otherwise(stem)


def qualified_name(path: Column) -> Column:
    """``parent/stem``; dot files keep their whole name."""
    name = basename(path)
    parent = basename(parent_dir(path))
    shown = F.when(parent == "", F.lit("unknown")).otherwise(parent)
    return F.concat(shown, F.lit("/"),
                    F.when(name.startswith("."), name).otherwise(file_stem(name)))


def relative_to(path: Column, root: Column) -> Column:
    return F.substr(path, F.length(root) + F.lit(2))


def is_under(path: Column, root: Column) -> Column:
    return path.startswith(F.concat(root, F.lit("/")))


def ancestor_dirs(directory: Column) -> Column:
    """The directory and all its parents, deepest last, as an array."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def string_prefixes(text: Column) -> Column:
    """Every string prefix of ``text``, the empty one and the whole included."""
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda n: F.left(text, n))


def content_allowed(name: Column) -> Column:
    return (name.isin(names.CONTENT_NAMES) | name.contains(names.CONTENT_CONTAINS)
            | name.endswith(names.CONTENT_SUFFIX))


def is_source_file(name: Column) -> Column:
    return F.lower(extension(name)).isin(names.SOURCE_EXTENSIONS)


def is_json_config(name: Column) -> Column:
    return ((F.lower(extension(name)) == "json")
            & ~F.lower(name).isin(names.JSON_SKIP_NAMES))


def is_text_file(name: Column) -> Column:
    ext = F.lower(extension(name))
    return (ext == "") | ext.isin(names.TEXT_EXTENSIONS)


def scrub_home(path: Column, home: Column) -> Column:
    """Replace the home directory by ``~``; show only the file name elsewhere."""
    return (F.when(home.isNotNull() & is_under(path, home),
                   F.concat(F.lit("~/"), relative_to(path, home)))
            .otherwise(basename(path)))
