"""Detectors: corpus rows in, artifact rows out.

A detector is any callable ``detect(files, ctx) -> DataFrame`` with ``name``; the registry says in
which modes it runs and when its results may be reused.  Artifact rows of all detectors are
united by column name.
"""

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.catalog import names
from riskledger.catalog.patterns import HTTP_URL
from riskledger.functions import identity as I, jsontext as J, paths, signals as G, text as T
from riskledger.operators import rules as rule_ops
from riskledger.operators.corpus import with_path_parts

NO_STRINGS = "array<string>"


@dataclass(frozen=True)
class ScanOptions:
    """``content_gate``: read only texts of files on the allow list, as a scan does by default.
    ``carried``: further columns of the files that the rows of rules, containers and server files keep."""

    mode: str = "workdir"
    deep: bool = True
    content_gate: bool = True
    rules: list = field(default_factory=list)
    detectors: tuple = ()
    carried: tuple = ()


class Detector(Protocol):
    """A detector of the user's own goes into ``ScanOptions.detectors``; ``modes``: where it runs."""

    name: str
    modes: list[str]

    def __call__(self, files: DataFrame, ctx: ScanOptions) -> DataFrame: ...


def detectors_for(mode: str) -> list[str]:
    return [d for d, (modes, _) in names.DETECTOR_MODES.items() if mode in modes]


def cacheable(mode: str, detector: str) -> bool:
    return mode in names.DETECTOR_MODES[detector][1]


def prepare(files: DataFrame, ctx: ScanOptions) -> DataFrame:
    """Add path parts, the readable ``text`` and the content gate to corpus rows."""
    out = with_path_parts(files)
    is_text = out.schema["content"].dataType.simpleString() == "string"
    return out.withColumns({
        "text": F.col("content") if is_text else T.utf8_text(F.col("content")),
        "content_ok": paths.content_allowed(F.col("name")),
    })


_CARRIED = ["scan_id", "path", "name", "dir", "origin", "size_bytes", "modified_at",
            "declared_tools", "permissions", "dependencies"]


def _file_facts(ctx: ScanOptions) -> list[Column]:
    """Identity and prompt facts, taken while the content is at hand."""
    content, size, text = F.col("content"), F.col("size_bytes"), F.col("text")
    gated = F.when(F.col("content_ok"), text)
    return [
        *[F.col(c) for c in (*_CARRIED, *ctx.carried)],
        I.content_hash(content).alias("content_hash"),
        F.lit(I.HASH_MODE).alias("content_hash_mode"),
        size.cast("bigint").alias("content_hash_bytes"),
        G.env_marker(gated).alias("env_marker"),
        F.coalesce(G.template_surface(gated), F.lit(False)).alias("template_surface"),
        F.coalesce(G.user_input_surface(gated), F.lit(False)).alias("user_input_surface"),
    ]


def custom_rules(files: DataFrame, ctx: ScanOptions) -> DataFrame:
    found = rule_ops.apply_rules(prepare(files, ctx), ctx.rules, ctx.deep, ctx.content_gate)
    return found.select(
        *_file_facts(ctx), F.lit("custom_rules").alias("detector"),
        (F.col("match_kind") * 100000 + F.col("rule_rank")).alias("rule_order"), "rule_name",
        "artifact_type", "confidence", "signals",
        F.when(F.col("artifact_type") == "skill", T.front_matter_description(F.col("text")))
        .alias("description"))


def container_kind(name: Column) -> Column:
    return F.when(name.contains("compose"), "service_orchestration").otherwise("image_definition")


def base_image(text: Column) -> Column:
    """Image of the first FROM line."""
    rows = F.filter(F.transform(T.lines(text), T.strip), lambda x: F.upper(x).startswith("FROM "))
    rest = T.strip(F.substr(F.try_element_at(rows, F.lit(1)), F.lit(6)))
    return F.nullif(F.regexp_extract(rest, r"(?U)^(\S+)", 1), F.lit(""))


def exposed_ports(text: Column) -> Column:
    """Numeric ports of all EXPOSE lines, in order."""
    rows = F.filter(F.transform(T.lines(text), T.strip), lambda x: F.upper(x).startswith("EXPOSE "))
    ports = F.flatten(F.transform(rows, lambda x: F.transform(
        F.split(T.strip(F.substr(x, F.lit(8))), r"(?U)\s+"), lambda p: F.substring_index(p, "/", 1))))
    return F.filter(ports, lambda p: p.rlike(r"\A[0-9]*\z"))


def compose_services(text: Column) -> Column:
    """Names directly below ``services:``; the first indented key sets the level."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("int").alias("indent"),
                     F.array().cast(NO_STRINGS).alias("out"))

    def state(inside, indent, out):
        return F.struct(inside.alias("inside"), indent.alias("indent"), out.alias("out"))

    def step(s, line):
        bare = T.strip(line)
        indented = line.startswith(" ") | line.startswith("\t")
        opens = bare.startswith("services:")
        depth = F.length(line) - F.length(F.regexp_replace(line, r"(?U)\A\s+", ""))
        level = F.coalesce(s["indent"], depth)
        name = T.strip(F.substr(bare, F.lit(1), F.length(bare) - 1))
        good = (depth == level) & (name != "") & ~name.contains(" ")
        return (F.when((bare == "") | bare.startswith("#"), s)
                .when(~indented, state(opens, F.when(opens, s["indent"]), s["out"]))
                .when(s["inside"] & bare.endswith(":"), state(
                    s["inside"], level,
                    F.when(good, F.concat(s["out"], F.array(name))).otherwise(s["out"])))
                .otherwise(s))

    return F.aggregate(T.lines(text), start, step)["out"]


def proximity_dirs(files: DataFrame) -> DataFrame:
    """Directories holding an agent file, over the whole corpus."""
    return (with_path_parts(files).where(F.col("name").isin(names.PROXIMITY_NAMES))
            .select("scan_id", "dir").distinct().withColumn("ai_artifact_proximity", F.lit(True)))


NEAR_AGENT = "ai_artifact_proximity"


def container_confidence(direct: Column, near: Column) -> Column:
    return F.when(direct, 0.8).when(near, 0.55).otherwise(0.4)


def placed(found: DataFrame, near_dirs: DataFrame) -> DataFrame:
    """Container rows of an earlier scan with what depends on their neighbours set anew."""
    rows = found.drop(NEAR_AGENT).join(near_dirs, ["scan_id", "dir"], "left")
    near = F.coalesce(F.col(NEAR_AGENT), F.lit(False))
    mark = F.when(near, F.array(F.lit(NEAR_AGENT))).otherwise(F.array().cast(NO_STRINGS))
    return rows.withColumns({
        "signals": F.concat(mark, F.filter("signals", lambda s: s != NEAR_AGENT)),
        "confidence": container_confidence(F.col("direct_ai_evidence"), near), NEAR_AGENT: near})


def containers(files: DataFrame, ctx: ScanOptions, near_dirs: DataFrame | None = None) -> DataFrame:
    """``near_dirs`` comes from the whole corpus (:func:`proximity_dirs`), never from a part of it."""
    found = prepare(files, ctx).where(F.col("name").isin(names.CONTAINER_NAMES))
    readable = F.col("text").isNotNull() & F.col("content_ok")
    scanned = G.with_signals(found, "text", readable)
    scanned = scanned.withColumn("_low", F.coalesce(F.lower(F.when(readable, F.col("text"))), F.lit("")))
    scanned = scanned.withColumns({
        "_tokens": G.tokens_in("_low", names.AI_TOKENS, "ai_token:"),
        "direct_agentic_evidence": G.contains_any(F.col("_low"), names.AGENTIC_TOKENS),
    }).join(proximity_dirs(files) if near_dirs is None else near_dirs, ["scan_id", "dir"], "left")
    near = F.coalesce(F.col("ai_artifact_proximity"), F.lit(False))
    direct = F.size("_tokens") > 0
    text, image = F.when(readable, F.col("text")), F.col("name").contains("compose")
    return scanned.select(
        *_file_facts(ctx), F.lit("containers").alias("detector"), F.lit(0).alias("rule_order"),
        F.when(direct, "container_config").otherwise("container_candidate").alias("artifact_type"),
        container_confidence(direct, near).alias("confidence"),
        F.concat(F.when(near, F.array(F.lit(NEAR_AGENT))).otherwise(F.array().cast(NO_STRINGS)),
                 "_tokens", "secret_signals", "danger_signals").alias("signals"),
        container_kind(F.col("name")).alias("container_kind"),
        F.when(~image, base_image(text)).alias("base_image"),
        F.when(~image, exposed_ports(text)).alias("exposed_ports"),
        F.when(image, compose_services(text)).alias("services"),
        direct.alias("direct_ai_evidence"), "direct_agentic_evidence", near.alias("ai_artifact_proximity"))


def mcp_configs(files: DataFrame, ctx: ScanOptions) -> DataFrame:
    found = prepare(files, ctx).where(F.col("name").isin(names.MCP_NAMES) & F.col("text").isNotNull())
    parsed = G.with_signals(found, "text", families=["secret"]) \
        .withColumn("_json", J.normal_json(F.col("text")))
    is_map = J.has_key(F.col("_json"), "mcpServers") | J.has_key(F.col("_json"), "servers")
    parsed = parsed.withColumn("server_json", F.when(is_map, F.col("_json")))
    doc = F.col("server_json")
    none = F.array().cast(NO_STRINGS)
    parsed = parsed.withColumn("_low", F.coalesce(F.lower(doc), F.lit("")))
    tokens = {k: G.tokens_in("_low", w) for k, w in (
        ("execution_tokens", names.EXECUTION_TOKENS), ("shell_tokens", names.SHELL_TOKENS),
        ("_credentials", names.CREDENTIAL_TOKENS))}
    parsed = parsed.withColumns(tokens)
    flags = G.present(F.when(F.size("execution_tokens") > 0, "execution_tokens_present"),
                      F.when(F.size("shell_tokens") > 0, "shell_access_detected"),
                      F.when(F.size("_credentials") > 0, "credential_references"))
    entries = F.coalesce(J.server_entries(doc), F.array().cast("array<struct<key:string,value:string>>"))
    return parsed.select(
        *_file_facts(ctx), F.lit("mcp_configs").alias("detector"), F.lit(0).alias("rule_order"),
        F.lit("mcp_config").alias("artifact_type"),
        F.when(doc.isNotNull(), 0.85).otherwise(0.75).alias("confidence"),
        F.concat(flags, "secret_signals").alias("signals"),
        "execution_tokens", "shell_tokens",
        F.when(doc.isNotNull(), G.urls(doc, HTTP_URL)).otherwise(none).alias("api_endpoints"),
        F.when(doc.isNotNull(), F.size(entries)).alias("server_count"),
        F.transform(entries, lambda e: e["key"]).alias("server_names"))


def browser_extensions(directories: DataFrame) -> DataFrame:
    """Extension directories of the chosen profile of each browser root.

    Input ``scan_id, profile_root, path`` (directories).  ``Default`` is preferred, else the
    smallest profile that has an ``Extensions`` directory.
    """
    rel = F.split(paths.relative_to(F.col("path"), F.col("profile_root")), "/")
    rows = directories.select("scan_id", "profile_root", rel[0].alias("profile"), F.size(rel).alias("n"),
                              F.try_element_at(rel, F.lit(2)).alias("second"),
                              F.try_element_at(rel, F.lit(3)).alias("extension_id")).where("second = 'Extensions'")
    chosen = (rows.groupBy("scan_id", "profile_root")
              .agg(F.min(F.struct((F.col("profile") != "Default").alias("other"), "profile")).alias("m"))
              .select("scan_id", "profile_root", F.col("m.profile").alias("profile")))
    return (rows.where("n = 3").join(chosen, ["scan_id", "profile_root", "profile"])
            .select("scan_id", "profile_root",
                    F.concat("profile_root", F.lit("/"), "profile", F.lit("/Extensions")).alias("path"),
                    "extension_id").distinct())


def browser_footprints(directories: DataFrame) -> DataFrame:
    """One artifact per browser root that has extensions.

    The ids themselves stay in :func:`browser_extensions`; the identity of the artifact covers them
    by ``ids_digest``, a digest over the digests of 256 shares of sorted ids.
    """
    key = ["scan_id", "profile_root", "path"]
    shares = (browser_extensions(directories).withColumn("share", F.left(F.sha2("extension_id", 256), F.lit(2)))
              .groupBy(*key, "share").agg(F.count("*").alias("n"), F.sha2(F.array_join(
                  F.array_sort(F.collect_list("extension_id")), "\n"), 256).alias("digest")))
    out = shares.groupBy(*key).agg(F.sum("n").alias("extension_count"), F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("share", "digest"))), lambda s: s["digest"]), "\n"), 256).alias("ids_digest"))
    facts = F.struct("extension_count", F.col("ids_digest").alias("extension_ids"), "profile_root")
    none = F.array().cast(NO_STRINGS)
    digest = F.sha2(F.to_json(F.struct(facts.alias("metadata"), none.alias("risk_reasons"),
                                       none.alias("signals"))), 256)
    return out.select(
        "scan_id", "path", "profile_root", "extension_count", "ids_digest", digest.alias("content_digest"), F.lit("browser_footprints").alias("detector"),
        F.lit(0).alias("rule_order"), F.lit("browser_footprint").alias("artifact_type"),
        F.lit(0.6).alias("confidence"), F.array().cast(NO_STRINGS).alias("signals"),
        F.lit("host").alias("origin"))
