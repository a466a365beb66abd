"""JSON columns: normal form and typed access."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_json(text: Column) -> Column:
    """Compact JSON with sorted keys, NULL if the text is not valid JSON."""
    return F.to_json(F.try_parse_json(text))


def has_key(json: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def json_string(json: Column, key: str) -> Column:
    """Value of a top-level key if it is a JSON string."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def string_items(json: Column, key: str) -> Column:
    """The string members of a top-level array; empty if there is none."""
    items = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "array<variant>")
    kept = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(kept, lambda v: F.try_variant_get(v, "$", "string")),
                      F.array().cast("array<string>"))


def servers_json(json: Column) -> Column:
    """The server map of a tool-server file (``mcpServers``, else ``servers``) as JSON text."""
    chosen = F.when(has_key(json, "mcpServers"), F.get_json_object(json, "$.mcpServers")) \
        .otherwise(F.get_json_object(json, "$.servers"))
    return F.when(chosen.startswith("{"), chosen)


def server_entries(json: Column) -> Column:
    """``array<struct(key, value)>`` of the server map, sorted by name; values are JSON text."""
    return F.array_sort(F.map_entries(F.from_json(servers_json(json), "map<string,string>")))
