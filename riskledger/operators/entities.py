"""Contract entities: prompts, agents, skills, container apps, and their links.

Entity rows stay flat or carry short lists of fixed size; relations without a bound (agents of an
app, agents using a server, tools of an agent) are separate link tables.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.catalog import labels as L
from riskledger.functions import identity as I, paths, scoring as S, urls as U
from riskledger.operators import links, mcp_servers as M
from riskledger.operators.corpus import salted_join, spread_rank
from riskledger.operators.detectors import NO_STRINGS, ScanOptions
from riskledger.operators.skills import trust_of

PROMPT_TYPES = ["cursor_rules", "prompt_config", "agents_md"]
CONTAINER_TYPES = ["container_config", "container_candidate"]
COMBO = "dangerous_combo:shell+network+fs"


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def _starts(prefix: str):
    return lambda s: s.startswith(prefix)


def with_entity_keys(artifacts: DataFrame) -> DataFrame:
    """Add ``entity_name``, ``entity_id`` and derived ``capabilities``."""
    return artifacts.withColumns({
        "entity_name": paths.qualified_name(F.col("path")),
        "entity_id": I.entity_id(F.col("path"), F.col("artifact_hash")),
        "capabilities": S.capabilities(F.col("signals"))})


def secret_refs(signals: Column, env_marker: Column) -> Column:
    danger = F.array_contains(signals, "credential_exposure_signal")
    kind = "array<struct<label:string,detail:string,tone:string>>"
    row = lambda label, detail, tone: F.array(F.struct(
        F.lit(label).alias("label"), detail.alias("detail"), F.lit(tone).alias("tone")))
    hits = F.transform(F.filter(signals, lambda s: s == "credential_exposure_signal"), lambda s: F.struct(
        F.lit("Credential reference detected").alias("label"),
        F.lit("Redacted — matched known secret pattern").alias("detail"), F.lit("danger").alias("tone")))
    safe = row("Env var reference (safe)",
               F.concat(F.lit("References environment variable via "), env_marker), "safe")
    return F.when(danger, hits).when(env_marker.isNotNull(), safe).otherwise(F.array().cast(kind))


def injection_surfaces(signals: Column, template: Column, user_input: Column) -> Column:
    row = lambda text, level: F.struct(text.alias("text"), F.lit(level).alias("severity"))
    kw = "dangerous_keyword:"
    listed = F.transform(F.filter(signals, lambda s: s.startswith(kw) | (s == COMBO)), lambda s: row(
        F.when(s == COMBO, "Combined shell + network + filesystem access pattern").otherwise(
            F.concat(F.lit("Dangerous instruction keyword: "), F.substr(s, F.lit(len(kw) + 1)))), "high"))
    none = F.array().cast("array<struct<text:string,severity:string>>")
    return F.concat(
        listed,
        F.when(template, F.array(row(F.lit("Template interpolation detected — potential injection surface"),
                                     "medium"))).otherwise(none),
        F.when(user_input, F.array(row(F.lit("Direct user input reference in prompt body"),
                                       "medium"))).otherwise(none))


def prompts(artifacts: DataFrame) -> DataFrame:
    rows = with_entity_keys(artifacts.where(F.col("artifact_type").isin(PROMPT_TYPES)))
    caps = F.transform("capabilities", lambda c: F.struct(
        S.capability_label(c).alias("text"), S.capability_level(c).alias("level")))
    return rows.select(
        "scan_id", F.col("entity_id").alias("id"), F.col("entity_name").alias("name"),
        F.col("path").alias("source_file_path"),
        F.when(F.col("artifact_type").isin("cursor_rules", "agents_md"), "System Prompt")
        .otherwise("User Prompt").alias("classification"),
        F.floor(F.coalesce("size_bytes", F.lit(0)) / 4).cast("bigint").alias("tokens"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce(F.date_format("modified_at", "yyyy-MM-dd"), F.lit("1970-01-01")).alias("last_changed_date"),
        caps.alias("capabilities"), secret_refs(F.col("signals"), F.col("env_marker")).alias("secret_refs"),
        injection_surfaces(F.col("signals"), F.col("template_surface"), F.col("user_input_surface"))
        .alias("injection_surfaces"),
        "dependencies", clamp(F.col("risk_score")).alias("risk_score"))


def _has(capabilities: Column, *wanted: str) -> Column:
    return F.arrays_overlap(capabilities, F.array(*[F.lit(w) for w in wanted]))


def agent_class(capabilities: Column) -> Column:
    return (F.when(_has(capabilities, "code_execution", "shell_execution"), "Code")
            .when(_has(capabilities, "container_runtime", "dependency_execution"), "Automation")
            .when(_has(capabilities, "browser_access", "external_api_calls"), "Research")
            .otherwise("System"))


def trust_breakdown(artifact_type: Column, signals: Column, status: Column) -> Column:
    factor = lambda label, delta: F.struct(label.alias("label"), F.lit(delta).alias("delta"))
    none = F.array().cast("array<struct<label:string,delta:int>>")
    kw = "dangerous_keyword:"

    def of(s):
        return (F.when(s == "credential_exposure_signal",
                       factor(F.lit("Hardcoded credential or secret pattern detected"), -25))
                .when(s == COMBO, factor(F.lit(
                    "Combined shell, network, and filesystem access — high exfiltration risk"), -30))
                .when(s.startswith(kw), factor(F.concat(
                    F.lit("Dangerous keyword detected: '"), F.substr(s, F.lit(len(kw) + 1)),
                    F.lit("' command")), -15))
                .when(s == "execution_tokens_present",
                      factor(F.lit("Execution tokens present in MCP configuration"), -10))
                .when(s == "shell_access_detected",
                      factor(F.lit("Shell access detected in MCP configuration"), -10)))

    label = F.concat(F.lit("Known artifact type: "), F.replace(artifact_type, F.lit("_"), F.lit(" ")))
    return F.concat(
        F.when(artifact_type == "agents_md", F.array(factor(label, 10)))
        .when(artifact_type == "cursor_rules", F.array(factor(label, 5))).otherwise(none),
        F.filter(F.transform(signals, of), lambda f: f.isNotNull()),
        F.when(status.isin("info", "low"), F.array(factor(F.lit("Verification clean"), 15))).otherwise(none))


def agents(artifacts: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    rows = with_entity_keys(artifacts.where("artifact_type = 'agents_md'"))
    if repos is not None:
        rows = links.nearest_repo(rows, repos)
        source = U.sanitize_remote(F.col("remote"))
    else:
        source = F.lit("unknown")
    caps, signals = F.col("capabilities"), F.col("signals")
    flags = F.array(*[F.struct(F.lit(name).alias("name"), _has(caps, *wanted).alias("enabled"))
                      for name, wanted in L.AGENT_FLAGS])
    risky = F.exists(signals, lambda s: s.startswith("dangerous_keyword:") | (s == COMBO))
    return rows.select(
        "scan_id", "path", "dir", F.col("entity_id").alias("id"), F.col("entity_name").alias("name"),
        agent_class(caps).alias("classification"),
        F.when(risky, "Autonomous").otherwise("User-in-the-loop").alias("execution_model"),
        clamp(F.lit(100) - F.col("risk_score")).alias("trust_score"),
        F.lit("unknown").alias("version"), F.lit("unknown").alias("author"), source.alias("source_repo"),
        flags.alias("capabilities"), "declared_tools",
        trust_breakdown(F.col("artifact_type"), signals, F.col("verification_status")).alias("trust_breakdown"))


def tool_counts(agent_rows: DataFrame, reach: DataFrame) -> DataFrame:
    """Agents with ``tool_count``: declared tools plus servers in reach (:func:`links.reach_counts`)."""
    return salted_join(agent_rows, reach.withColumnRenamed("agent_dir", "dir"), ["scan_id", "dir"], ["path"], "left").withColumn(
        "tool_count", F.size("declared_tools") + F.coalesce("servers", F.lit(0))).drop("servers")


def dependent_agents(agent_rows: DataFrame, server_links: DataFrame) -> DataFrame:
    """``scan_id, server_name, agent_id``: agents that have the server among their tools."""
    who = agent_rows.select("scan_id", F.col("dir").alias("agent_dir"), F.col("id").alias("agent_id")).distinct()
    return salted_join(who, server_links.select("scan_id", "agent_dir", "server_name"), ["scan_id", "agent_dir"], ["agent_id"]) \
        .select("scan_id", "server_name", "agent_id").distinct()


# --- Skills -----------------------------------------------------------------------------------

_PERMISSIONS = "array<string>"


def _permissions(capabilities: Column) -> Column:
    mapped = F.expr("map(" + ", ".join(
        f"'{c}', array({', '.join(repr(p) for p in ps)})" for c, ps in L.CAPABILITY_PERMISSIONS.items()) + ")")
    return F.array_distinct(F.flatten(F.transform(capabilities, lambda c: F.coalesce(
        F.element_at(mapped, c), F.array().cast(_PERMISSIONS)))))


def _tool_field(tool: Column, index: int, default, kind: str = "string") -> Column:
    def spell(v):
        if isinstance(v, list):
            return f"cast(array({', '.join(repr(x) for x in v)}) as array<string>)"
        return repr(v)
    table = F.expr("map(" + ", ".join(f"'{t}', {spell(row[index])}" for t, row in L.TOOL_SKILLS.items()) + ")")
    return F.coalesce(F.element_at(table, tool), default)


def skills(artifacts: DataFrame, files: DataFrame, ctx: ScanOptions, skill_findings: DataFrame | None = None,
           repos: DataFrame | None = None) -> DataFrame:
    """One row per scan and skill name: skill files and declared tools in artifact order, then the
    commands of tool servers; the first use of a name wins."""
    none = F.array().cast(NO_STRINGS)
    found = with_entity_keys(artifacts)
    caps = F.col("capabilities")
    own = found.where("artifact_type = 'skill'").select(
        "scan_id", "path", "dir", F.col("entity_name").alias("name"), F.lit(0).alias("phase"), "detector_rank",
        "rule_order", F.lit(0).alias("sub"), F.col("entity_id").alias("id"), F.lit("Local Function").alias("type"),
        F.lit("Local Process").alias("environment"),
        F.coalesce("description", F.lit("Reusable agent skill instructions")).alias("description"),
        _permissions(caps).alias("permissions"),
        F.array_compact(F.array(F.when(_has(caps, "shell_execution", "code_execution"), F.lit("shell")),
                                F.when(_has(caps, "container_runtime"), F.lit("docker")))).alias("binaries"),
        F.array_compact(F.array(F.when(_has(caps, "external_api_calls", "network_access"),
                                       F.lit("HTTP")))).alias("apis"), F.lit("file").alias("kind"))
    tool = F.col("name")
    declared = found.select("scan_id", "path", "dir", F.posexplode("declared_tools").alias("pos", "name"),
                            F.lit(0).alias("phase"), "detector_rank", "rule_order") \
        .select("scan_id", "path", "dir", "name", "phase", "detector_rank", "rule_order",
                (F.col("pos") + 1).alias("sub"), F.col("name").alias("id"),
                _tool_field(tool, 0, F.lit("Local Function")).alias("type"),
                _tool_field(tool, 1, F.lit("Local Process")).alias("environment"),
                _tool_field(tool, 3, F.concat(F.lit("Provides "), F.replace(tool, F.lit("_"), F.lit(" ")),
                                              F.lit(" functionality"))).alias("description"),
                _tool_field(tool, 4, none).alias("permissions"), _tool_field(tool, 2, none).alias("binaries"),
                none.alias("apis"), F.lit("tool").alias("kind"))
    entries = M.server_entries(files, ctx).withColumns({
        "command": M.J.json_string(F.col("value"), "command"), "args": M.J.string_items(F.col("value"), "args")})
    commands = entries.where("command is not null").select(
        "scan_id", "path", "dir", F.substring_index("command", "/", -1).alias("name"), F.lit(1).alias("phase"),
        F.lit(0).alias("detector_rank"), F.lit(0).alias("rule_order"), F.lit(0).alias("sub"),
        F.substring_index("command", "/", -1).alias("id"), F.lit("CLI Tool").alias("type"),
        F.lit("Local Process").alias("environment"),
        F.concat(F.lit("Executes MCP server via: "), M.command_line(F.col("command"), F.col("args"))).alias("description"),
        F.array(F.lit("Shell execution")).alias("permissions"), F.array("command").alias("binaries"),
        none.alias("apis"), F.lit("command").alias("kind"), F.col("server_name").alias("tie"))
    every = own.withColumn("tie", F.lit("")).unionByName(declared.withColumn("tie", F.lit(""))).unionByName(commands)
    order = ["phase", "detector_rank", "path", "rule_order", "sub", "tie"]
    rest = ["dir", "id", "type", "environment", "description", "permissions", "binaries", "apis", "kind"]
    first = every.groupBy("scan_id", "name").agg(F.min(F.struct(*order, *rest)).alias("m")).select(
        "scan_id", "name", "m.path", *[f"m.{c}" for c in rest])
    if skill_findings is not None:
        from riskledger.operators.skills import grade_skills
        graded = grade_skills(skill_findings.withColumn("_key", F.struct("scan_id", "path")), "_key").select(
            "_key.scan_id", "_key.path", F.col("grade").alias("_grade"))
        first = first.join(graded, ["scan_id", "path"], "left")
    else:
        first = first.withColumn("_grade", F.lit(None).cast("string"))
    first = first.withColumn("grade", F.when(F.col("kind") == "file", F.coalesce("_grade", F.lit("A")))
                             .otherwise("pending")).drop("_grade")
    first = first.withColumn("trust", trust_of(F.col("grade")))
    if repos is None:
        return first
    placed = links.nearest_repo(first, repos)
    remote = U.sanitize_remote(F.col("remote"))
    known = (F.col("kind") == "file") & F.col("remote").isNotNull() & (remote != "unknown")
    branch = F.coalesce(F.nullif(F.regexp_extract(F.trim("head"), r"^ref: refs/heads/(.*)$", 1), F.lit("")),
                        F.lit("main"))
    github = remote.contains("github.com")
    return placed.withColumn("detected_source", F.when(known, F.struct(
        F.when(github, "gitHub").otherwise("unsupportedRemote").alias("status"),
        F.when(github, remote).alias("repo_url"), F.when(github, branch).alias("branch"),
        F.when(github, F.col("relative_path")).alias("path"),
        F.when(~github, remote).alias("remote_url")))).drop("repo_dir", "remote", "head", "relative_path")


def skill_consumers(skill_rows: DataFrame, agent_rows: DataFrame, scopes: links.ServerScopes) -> DataFrame:
    """``scan_id, skill_name, agent_id, agent_name``: agents that list a tool of the skill's name;
    for skill files, agents defined by the same file.  Only servers named like a skill are paired."""
    who = agent_rows.select("scan_id", "path", "dir", "declared_tools", F.col("id").alias("agent_id"),
                            F.col("name").alias("agent_name"))
    by_decl = who.select("scan_id", F.explode("declared_tools").alias("skill_name"), "agent_id", "agent_name")
    named = skill_rows.where("kind <> 'file'").select("scan_id", F.col("name").alias("skill_name"))
    listed = scopes.pairs(names=named.withColumnRenamed("skill_name", "server_name"))
    by_server = salted_join(who, listed.select("scan_id", F.col("agent_dir").alias("dir"), F.col("server_name").alias("skill_name")),
                            ["scan_id", "dir"], ["agent_id"]).select("scan_id", "skill_name", "agent_id", "agent_name")
    via_tool = salted_join(by_decl.unionByName(by_server), named, ["scan_id", "skill_name"], ["agent_id"]) \
        .select("scan_id", "skill_name", "agent_id", "agent_name")
    via_path = skill_rows.where("kind = 'file'").select("scan_id", "path", F.col("name").alias("skill_name")) \
        .join(who.select("scan_id", "path", "agent_id", "agent_name"), ["scan_id", "path"]) \
        .select("scan_id", "skill_name", "agent_id", "agent_name")
    return via_tool.unionByName(via_path).distinct()


# --- Container apps ---------------------------------------------------------------------------

def framework(signals: Column) -> Column:
    def of(s):
        low = F.lower(s)
        return (F.when(low.contains("langchain") | low.contains("langgraph"), "LangGraph")
                .when(low.contains("crewai"), "CrewAI").when(low.contains("autogen"), "AutoGen"))
    named = F.filter(F.transform(signals, of), lambda f: f.isNotNull())
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("Custom"))


def app_risk(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low")


def integrations(endpoints: Column) -> Column:
    def doc(e):
        low = F.lower(e)
        return low.contains("docs.") | low.contains("/docs/") | low.contains("readme")

    def name(e):
        low = F.lower(e)
        return (F.when(low.contains("github"), "GitHub API").when(low.contains("openai"), "OpenAI API")
                .when(low.contains("anthropic"), "Anthropic API").otherwise(e))
    return F.transform(F.filter(endpoints, lambda e: ~doc(e)), lambda e: F.struct(
        name(e).alias("name"), F.lit("REST API").alias("type"), F.lit("Medium").alias("risk")))


def app_agents(artifacts: DataFrame, agent_rows: DataFrame) -> DataFrame:
    """Agents below each container directory with their workflow step.

    ``scan_id, dir, agent_id, agent_name, classification, tool_count, step, step_total``.  Steps
    follow the digest of the agent's path: the order of files in a walk has no meaning.
    """
    dirs = artifacts.where(F.col("artifact_type").isin(CONTAINER_TYPES))
    who = agent_rows.select("scan_id", "path", F.col("id").alias("agent_id"), F.col("name").alias("agent_name"),
                            "classification", "tool_count")
    below = links.agents_below(dirs, who)
    return spread_rank(below, ["scan_id", "dir"], F.sha2(F.concat_ws("/", "scan_id", "path"), 256), "step") \
        .drop("path")


def workflow_action(classification: Column, tool_count: Column) -> Column:
    return F.concat(F.lit("Execute "), classification, F.lit(" tasks using "), tool_count.cast("string"),
                    F.lit(" tools"))


def apps(artifacts: DataFrame, members: DataFrame) -> DataFrame:
    """Containers that run agents: agents below their directory or direct agentic content."""
    boxes = with_entity_keys(artifacts.where(F.col("artifact_type").isin(CONTAINER_TYPES)))
    local = members.groupBy("scan_id", "dir").agg(
        F.count("*").alias("agent_count"), F.array_sort(F.collect_set("classification")).alias("classes"))
    direct = F.coalesce("direct_agentic_evidence", F.lit(False))
    rows = boxes.join(local, ["scan_id", "dir"], "left").withColumn(
        "agent_count", F.coalesce("agent_count", F.lit(0))).where((F.col("agent_count") > 0) | direct)
    label = F.when(F.col("container_kind") == "image_definition", "Container image definition") \
        .otherwise("Service orchestration configuration")
    frame, risk = framework(F.col("signals")), app_risk(F.col("risk_score"))
    head = F.concat(label, F.lit(" for a "), frame, F.lit(" workflow"))
    reasons = F.array_join("risk_reasons", ", ")
    caps, signals = F.col("capabilities"), F.col("signals")
    near = F.array_contains(signals, "ai_artifact_proximity")
    clean = F.col("verification_status").isin("info", "low")
    return rows.select(
        "scan_id", "dir", F.col("entity_id").alias("id"), F.col("entity_name").alias("name"),
        F.col("path").alias("source_file_path"), frame.alias("framework"), "agent_count", risk.alias("risk"),
        F.when(F.col("verification_status").isin("critical", "high"), "Flagged").otherwise("Unreviewed")
        .alias("review_status"),
        F.when(F.col("agent_count") > 0, F.concat(
            head, F.lit(" with "), F.col("agent_count").cast("string"), F.lit(" agent(s) performing "),
            F.lower(F.array_join("classes", ", ")), F.lit(" tasks"))).otherwise(head).alias("description"),
        integrations(F.col("api_endpoints")).alias("integrations"),
        F.array_compact(F.array(
            F.concat(label, F.lit(" present")), F.lit("Risk score computed"),
            F.when(clean, F.lit("Verification passed")), F.when(direct, F.lit("Direct agentic content detected")),
            F.when(near, F.lit("AI artifact proximity detected")))).alias("verification_checks"),
        F.array_compact(F.array(
            F.when(_has(caps, "shell_execution", "code_execution"), F.lit("Autonomous Code Execution")),
            F.when(F.array_contains(signals, "credential_exposure_signal"), F.lit("Credential Exposure")),
            F.when(_has(caps, "network_access", "external_api_calls"), F.lit("External Network Access")),
            F.when(F.exists(signals, _starts("dangerous_keyword:")), F.lit("Dangerous Instructions"))))
        .alias("risk_tags"),
        F.concat(risk, F.lit("-risk "), F.lower(label), F.lit(" '"), "entity_name", F.lit("'. "),
                 F.when(F.size("risk_reasons") == 0, "No specific risk drivers identified.").otherwise(
                     F.concat(F.lit("Key risk drivers: "), reasons, F.lit(".")))).alias("risk_summary"))
