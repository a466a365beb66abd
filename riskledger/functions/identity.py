"""Content digests and identity hashes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_MODE = "full_sha256"


def content_hash(content: Column) -> Column:
    """Digest of all bytes, however large the file."""
    return F.sha2(content.cast("binary"), 256)


def _json(*pairs) -> Column:
    """Compact JSON object; values are plain identifiers and hex, so no escaping is needed."""
    parts = []
    for i, (key, value) in enumerate(pairs):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{key}":"'), value, F.lit('"')]
    return F.concat(*parts, F.lit("}"))


def artifact_hash(digest: Column, artifact_type: Column, version: Column | None = None) -> Column:
    return F.sha2(_json(("artifact_content", digest), ("artifact_type", artifact_type),
                        ("version", F.lit("v1") if version is None else version)), 256)


def artifact_id(hash_: Column, scope: Column) -> Column:
    return F.sha2(_json(("artifact_hash", hash_), ("artifact_scope", scope)), 256)


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def entity_id(path: Column, hash_: Column) -> Column:
    tail = F.when(F.coalesce(hash_, F.lit("")) == "", short_hash(path)).otherwise(F.left(hash_, F.lit(12)))
    return F.concat(path, F.lit(":"), tail)


def state_key(path, origin, file_id, size, modified_ns, full_hash) -> Column:
    """Tamper key of a stored file: any change in place, size, time or bytes changes it."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws(":", path, origin, blank(file_id), size.cast("string"),
                              F.coalesce(modified_ns, F.lit(0)).cast("string"), blank(full_hash)), 256)
