"""The contract: artifacts to six linked record sets, and their JSON form."""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.catalog import contract_schema as X, labels as L, names
from riskledger.operators import entities as E, links, mcp_servers as M
from riskledger.operators.corpus import salted_join
from riskledger.operators.detectors import ScanOptions
from riskledger.session import cut

SECTIONS = ["prompts", "skills", "mcpServers", "agents", "agenticApps"]


class Contract:
    """Entities and links of a set of scans, each made on first use.

    Artifacts, server files, agents and links feed several others, so their lineage is cut where
    the session names a checkpoint folder; of the corpus only tool-server files are read again.
    """

    def __init__(self, files: DataFrame, artifacts: DataFrame, ctx: ScanOptions, repos: DataFrame | None = None,
                 skill_findings: DataFrame | None = None, host_env: DataFrame | None = None):
        self._files, self._artifacts, self._ctx = files, artifacts, ctx
        self._repos, self._skill_findings, self._host_env = repos, skill_findings, host_env

    @cached_property
    def artifacts(self) -> DataFrame:
        return cut(self._artifacts)

    @cached_property
    def server_files(self) -> DataFrame:
        return cut(self._files.where(F.substring_index("path", "/", -1).isin(names.MCP_NAMES)))

    @cached_property
    def prompts(self) -> DataFrame:
        return E.prompts(self.artifacts)

    @cached_property
    def _plain_agents(self) -> DataFrame:
        return E.agents(self.artifacts, self._repos)

    @cached_property
    def entries(self) -> DataFrame:
        """``scan_id, path, dir, server_name, value``"""
        return cut(M.server_entries(self.server_files, self._ctx))

    @cached_property
    def agent_dirs(self) -> DataFrame:
        return cut(self._plain_agents.select("scan_id", "dir").distinct())

    @cached_property
    def scopes(self) -> links.ServerScopes:
        found = links.server_scopes(self.agent_dirs, self.entries)
        return links.ServerScopes(cut(found.directories), cut(found.servers))

    @cached_property
    def reach(self) -> DataFrame:
        """``scan_id, agent_dir, servers``"""
        return cut(links.reach_counts(self.agent_dirs, self.entries))

    @cached_property
    def server_links(self) -> DataFrame:
        """``scan_id, agent_dir, server_name, first_path``: written out for the records that list them."""
        return cut(self.scopes.pairs())

    @cached_property
    def agents(self) -> DataFrame:
        return cut(E.tool_counts(self._plain_agents, self.reach))

    @cached_property
    def dependents(self) -> DataFrame:
        """``scan_id, server_name, agent_id``"""
        return cut(E.dependent_agents(self.agents, self.server_links))

    @cached_property
    def members(self) -> DataFrame:
        """``scan_id, dir, agent_id, agent_name, classification, tool_count, step, step_total``"""
        return cut(E.app_agents(self.artifacts, self.agents))

    @cached_property
    def apps(self) -> DataFrame:
        return E.apps(self.artifacts, self.members)

    @cached_property
    def skills(self) -> DataFrame:
        return cut(E.skills(self.artifacts, self.server_files, self._ctx, self._skill_findings, self._repos))

    @cached_property
    def consumers(self) -> DataFrame:
        """``scan_id, skill_name, agent_id, agent_name``"""
        return E.skill_consumers(self.skills, self.agents, self.scopes)

    @cached_property
    def servers(self) -> DataFrame:
        return cut(M.mcp_servers(self.server_files, self._ctx, self.artifacts))

    @cached_property
    def env_refs(self) -> DataFrame:
        return M.env_references(self.servers, self._host_env)


def _pair(names_and_columns) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in names_and_columns])


def _with_list(rows: DataFrame, keys, edges: DataFrame, item: Column, spread: str, name: str) -> DataFrame:
    """Attach a long list to its record, in as many record parts as the list needs, numbered from 1."""
    return links.with_list(rows, edges, keys, item, spread, name).withColumns({
        "listPart": F.col("part") + 1, "listParts": F.col("parts")}).drop("part", "parts")


def _or_empty(rows: DataFrame, name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.expr(f"cast(array() as {kind})"))


def records(c: Contract, logs: DataFrame | None = None) -> DataFrame:
    """``scan_id, section, key, record``: every contract record as JSON.

    Field names follow the contract; absent optional fields are left out.  A record with a list of no
    fixed size carries ``listPart`` and ``listParts``; a longer list appears as several such parts, which
    hold every item once.  The lists are also tables of their own: ``server_links``, ``dependents``,
    ``members`` and ``consumers`` of :class:`Contract`.
    """
    out = [c.prompts.select("scan_id", F.lit("prompts").alias("section"), F.col("id").alias("key"), F.to_json(_pair([
        ("id", "id"), ("name", "name"), ("sourceFilePath", "source_file_path"),
        ("classification", "classification"), ("tokens", "tokens"), ("contentHash", "content_hash"),
        ("lastChangedDate", "last_changed_date"), ("capabilities", "capabilities"),
        ("secretRefs", "secret_refs"), ("injectionSurfaces", "injection_surfaces"),
        ("dependencies", "dependencies"), ("riskScore", "risk_score")])).alias("record"))]

    consumer = F.struct(F.col("agent_id").alias("id"), F.col("agent_name").alias("name"),
                        F.lit("Agent").alias("type"), F.lit(0).alias("invocations"))
    skills = _with_list(c.skills.withColumnRenamed("name", "skill_name"), ["scan_id", "skill_name"],
                        c.consumers, consumer, "agent_id", "consumers")
    permissions = F.transform("permissions", lambda p: F.struct(p.alias("name"), F.lit(True).alias("required")))
    fields = [("id", "id"), ("name", "skill_name"), ("type", "type"), ("trustLevel", "trust"),
              ("overallGrade", "grade"), ("executionEnvironment", "environment"),
              ("description", "description"), ("permissions", permissions),
              ("dependencies", F.struct(F.expr("cast(array() as array<string>)").alias("libraries"),
                                        "binaries", "apis")),
              ("consumers", _or_empty(skills, "consumers",
                                      "array<struct<id:string,name:string,type:string,invocations:int>>")),
              ("listPart", "listPart"), ("listParts", "listParts")]
    if "detected_source" in skills.columns:
        s = F.col("detected_source")
        fields.append(("detectedSource", F.when(s.isNotNull(), F.struct(
            s["status"].alias("status"), s["repo_url"].alias("repoUrl"), s["branch"].alias("branch"),
            s["path"].alias("path"), s["remote_url"].alias("remoteUrl")))))
    out.append(skills.select("scan_id", F.lit("skills").alias("section"), F.col("id").alias("key"),
                             F.to_json(_pair(fields)).alias("record")))

    env = c.env_refs.groupBy("scan_id", "server_name").agg(F.array_sort(F.collect_list(
        F.struct("ord", "name", "is_set", "source_key"))).alias("env"))
    # agents and log rows of a server share one list, so both stay whole however long they are
    blank = F.lit(None).cast("string")
    edges = c.dependents.select("scan_id", "server_name", "agent_id", blank.alias("category"),
                                blank.alias("detail"), blank.alias("url"))
    if logs is not None:
        edges = edges.unionByName(M.attach_logs(c.servers, logs).distinct().withColumn("agent_id", blank))
    edges = edges.withColumn("spread", F.coalesce("agent_id", "url"))
    servers = _with_list(c.servers.join(env, ["scan_id", "server_name"], "left"), ["scan_id", "server_name"], edges,
                         F.struct("agent_id", "category", "detail", "url"), "spread", "long_list")
    servers = servers.withColumn("long_list", _or_empty(
        servers, "long_list", "array<struct<agent_id:string,category:string,detail:string,url:string>>"))
    dependents = F.transform(F.filter("long_list", lambda e: e["agent_id"].isNotNull()), lambda e: e["agent_id"])
    seen = F.transform(F.filter("long_list", lambda e: e["agent_id"].isNull()), lambda e: F.struct(
        F.lit("logs").alias("source"), e["category"].alias("category"), e["detail"].alias("detail"),
        e["url"].alias("url")))
    evidence = F.concat("evidence", seen)
    refs = F.transform(_or_empty(servers, "env", "array<struct<ord:int,name:string,is_set:boolean,source_key:string>>"),
                       lambda e: F.struct(e["name"].alias("name"), e["is_set"].alias("isSet"),
                                          e["source_key"].alias("sourceKey")))
    out.append(servers.select("scan_id", F.lit("mcpServers").alias("section"), F.col("id").alias("key"),
                              F.to_json(_pair([
                                  ("id", "id"), ("name", "server_name"), ("transport", "transport"),
                                  ("network", "network"), ("auth", "auth"), ("verified", "verified"),
                                  ("command", "command_line"), ("tools", "tools"),
                                  ("dependentAgents", dependents),
                                  ("networkEvidence", evidence), ("envVars", refs),
                                  ("listPart", "listPart"), ("listParts", "listParts")])).alias("record")))

    tool = F.struct("first_path", F.col("server_name").alias("name"))
    agents = _with_list(c.agents, ["scan_id", "dir"], c.server_links.withColumnRenamed("agent_dir", "dir"), tool, "server_name", "items")
    typed = lambda kind: (lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))
    tool_names = F.transform(_or_empty(agents, "items", "array<struct<first_path:string,name:string>>"), lambda i: i["name"])
    agents = agents.withColumn("tool_names", tool_names)
    first = F.col("listPart") == 1
    declared = F.when(first, F.col("declared_tools")).otherwise(F.expr("cast(array() as array<string>)"))
    out.append(agents.select("scan_id", F.lit("agents").alias("section"), F.col("id").alias("key"), F.to_json(_pair([
        ("id", "id"), ("name", "name"), ("sourceFilePath", "path"), ("classification", "classification"),
        ("executionModel", "execution_model"), ("trustScore", "trust_score"), ("version", "version"),
        ("author", "author"), ("sourceRepo", "source_repo"), ("capabilities", "capabilities"),
        ("tools", F.concat(F.transform(declared, typed("skill")), F.transform("tool_names", typed("mcp")))),
        ("trustBreakdown", "trust_breakdown"), ("listPart", "listPart"), ("listParts", "listParts")])).alias("record")))

    # members and the tool lists of members share one list: an agent is one member, however many parts its tools have
    tool_names = agents.select("scan_id", F.col("id").alias("agent_id"), F.col("listPart").alias("tool_part"),
                               F.concat(declared, "tool_names").alias("tool_names"))
    who = c.members.select("scan_id", "dir", "agent_id", "step", F.col("agent_name").alias("name"),
                           E.workflow_action(F.col("classification"), F.col("tool_count")).alias("action"))
    with_tools = salted_join(who.select("scan_id", "dir", "agent_id", "step"), tool_names, ["scan_id", "agent_id"], ["dir"])
    member = F.struct("step", "tool_part", F.col("agent_id").alias("id"), "name", "action", "tool_names")
    edges = who.withColumn("tool_part", F.lit(0)).unionByName(with_tools, allowMissingColumns=True)
    apps = _with_list(c.apps, ["scan_id", "dir"], edges, member, "agent_id", "members")
    kind = "array<struct<step:bigint,tool_part:int,id:string,name:string,action:string,tool_names:array<string>>>"
    apps = apps.withColumn("members", _or_empty(apps, "members", kind))
    apps = apps.withColumns({"tool_lists": F.filter("members", lambda m: m["tool_part"] > 0),
                             "members": F.filter("members", lambda m: m["tool_part"] == 0)})
    out.append(apps.select("scan_id", F.lit("agenticApps").alias("section"), F.col("id").alias("key"), F.to_json(_pair([
        ("id", "id"), ("name", "name"), ("sourceFilePath", "source_file_path"), ("framework", "framework"),
        ("agentCount", "agent_count"), ("risk", "risk"), ("reviewStatus", "review_status"),
        ("description", "description"),
        ("agents", F.transform("members", lambda m: F.struct(m["id"].alias("id"), m["name"].alias("name")))),
        ("toolsByAgent", F.transform("tool_lists", lambda m: m["tool_names"])),
        ("workflow", F.transform("members", lambda m: F.struct(
            m["step"].alias("step"), m["name"].alias("agent"), m["action"].alias("action")))),
        ("integrations", "integrations"), ("verificationChecks", "verification_checks"),
        ("riskTags", "risk_tags"), ("riskSummary", "risk_summary"), ("listPart", "listPart"), ("listParts", "listParts")])).alias("record")))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def payload(record_rows: DataFrame, scans: DataFrame, size: int = links.LIST_PART) -> DataFrame:
    """``scan_id, part, parts, payload``: the contract JSON of each scan.

    A scan of ordinary size is one document.  A larger one is cut into parts of about ``size``
    records, each a valid document of its own with the same ``scanMeta``; together they hold every
    record.  ``scans``: ``scan_id, scan_meta`` (JSON text).
    """
    record_rows = cut(record_rows)
    count = record_rows.groupBy("scan_id").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("parts"))
    base = scans.join(count, "scan_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = salted_join(record_rows, count, ["scan_id"], ["key"]).withColumn(
        "part", F.pmod(F.xxhash64("section", "key"), F.col("parts")).cast("int"))
    lists = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("section") == s, F.struct("key", "record")))), lambda r: r["record"]), ",").alias(s) for s in SECTIONS]
    grouped = placed.groupBy("scan_id", "part").agg(*lists)
    every_part = base.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = every_part.join(grouped, ["scan_id", "part"], "left")
    pieces = [F.lit('{"scanMeta":'), F.col("scan_meta")]
    for s in SECTIONS:
        pieces += [F.lit(f',"{s}":['), F.coalesce(F.col(s), F.lit("")), F.lit("]")]
    return rows.select("scan_id", "part", "parts", F.concat(*pieces, F.lit("}")).alias("payload"))


def disclosure(record_rows: DataFrame, c: Contract, scans: DataFrame) -> DataFrame:
    """Which data categories a payload shows, per scan: ``scan_id, category, label``.

    ``scans``: ``scan_id, host_security`` (does the host block carry data).
    """
    present = record_rows.groupBy("scan_id").agg(F.collect_set("section").alias("sections"))
    met = c.scopes.directories.join(c.scopes.servers.select("scan_id", "scope").distinct(), ["scan_id", "scope"], "left_semi")
    deps = met.select("scan_id").distinct().withColumn("has_deps", F.lit(True))
    env = c.env_refs.select("scan_id").distinct().withColumn("has_env", F.lit(True))
    rows = (scans.select("scan_id", "host_security").join(present, "scan_id", "left")
            .join(deps, "scan_id", "left").join(env, "scan_id", "left"))
    has = lambda s: F.coalesce(F.array_contains("sections", s), F.lit(False))
    servers = has("mcpServers")
    tests = {"meta": F.lit(True), "roots": F.lit(True), "hostname": F.lit(True),
             "host_security": F.col("host_security"), "version": F.lit(True), "prompts": has("prompts"),
             "skills": has("skills"), "agents": has("agents"), "apps": has("agenticApps"),
             "commands": servers, "tools": servers, "dependents": servers & F.coalesce("has_deps", F.lit(False)),
             "logs": servers, "env": servers & F.coalesce("has_env", F.lit(False))}
    listed = F.array(*[F.when(t, F.struct(F.lit(k).alias("category"), F.lit(L.DISCLOSURE_LABELS[k]).alias("label")))
                       for k, t in tests.items()])
    return rows.select("scan_id", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("c")) \
        .select("scan_id", "c.category", "c.label")


def disclosure_counts(record_rows: DataFrame) -> DataFrame:
    """``scan_id, artifact_records, server_records``: how many records a submission shows."""
    part = F.get_json_object("record", "$.listPart")
    each = record_rows.where(part.isNull() | (part == "1"))
    servers = F.col("section") == "mcpServers"
    return each.groupBy("scan_id").agg(F.count_if(~servers).alias("artifact_records"), F.count_if(servers).alias("server_records"))


def violations(record_rows: DataFrame) -> DataFrame:
    """``scan_id, section, key, field, value``: required fields that are missing (value NULL) and labels
    outside the contract's lists, those inside lists of a record included."""
    out = None
    for section, ddl in X.RECORDS.items():
        rows = record_rows.where(F.col("section") == section).withColumn("r", F.from_json("record", ddl))
        bad = [F.when(F.col(f"r.{name}").isNull(), F.array(F.struct(F.lit(name).alias("field"), F.lit(None).cast("string").alias("value"))))
               for name in X.required(section)]
        for path, allowed in X.ENUMS.items():
            of, *names = path.split(".")
            if of != section:
                continue
            field, values = ".".join(names), F.col(f"r.{names[0]}")
            listed = F.array(values) if len(names) == 1 else F.transform(values, lambda x: x[names[1]])
            odd = F.array_distinct(F.filter(listed, lambda v: v.isNotNull() & ~v.isin(allowed)))
            bad.append(F.transform(odd, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))))
        none = F.expr("cast(array() as array<struct<field:string,value:string>>)")
        part = rows.select("scan_id", "section", "key", F.inline(F.concat(*[F.coalesce(b, none) for b in bad])))
        out = part if out is None else out.unionByName(part)
    return out
