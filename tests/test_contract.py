import json

import pytest
from pyspark.sql import functions as F

from riskledger.functions.identity import short_hash
from riskledger.operators import mcp_servers as M
from riskledger.plans import contract, scan
from riskledger.sources import files as src

SERVERS = json.dumps({"mcpServers": {
    "zeta": {"type": "http", "url": "https://u:p@api.example.com/x?token=1", "gallery": "https://meta.example.com"},
    "alpha": {"command": "/bin/bash", "args": ["--api-key", "k", "--token=t", "API_KEY=x", "Authorization: Bearer y", "-k", "v", "-y", 5],
              "env": {"API_TOKEN": "${TOK}", "EMPTY_KEY": "", "PLAIN": "1"}},
    "gh": {"command": "npx", "args": ["github-mcp"]}, "lan": {"url": "http://127.0.0.1:9/x"}}}, indent=1)


def servers(spark, ctx, corpus):
    rows = M.mcp_servers(corpus([("/r/mcp.json", SERVERS), ("/r/z/mcp.json", '{"servers":{"gh":{"command":"other"}}}'),
                                 ("/r/mcp_settings.json", '{"mcpServers":{"hidden":{}}}'), ("/r/y/mcp.json", "{broken")]), ctx)
    return {r.server_name: r for r in rows.collect()}


def test_servers(spark, ctx, corpus):
    got = servers(spark, ctx, corpus)
    assert sorted(got) == ["alpha", "gh", "lan", "zeta"]
    a = got["alpha"]
    assert a.command_line == "/bin/bash --api-key REDACTED --token=REDACTED API_KEY=REDACTED REDACTED -k REDACTED -y"
    assert (a.transport, a.auth, a.network) == ("stdio", "API Key", "Local Only")
    assert [(t.name, t.risk) for t in a.tools] == [("run_shell_command", "High")]
    assert [e.detail for e in a.evidence if e.category == "credential-in-env"] == [
        "Credential env var 'API_TOKEN' passed to server (value present)",
        "Credential env var 'EMPTY_KEY' passed to server (value empty)"]
    z = got["zeta"]
    assert z.transport == "streamable-http" and z.network == "Internet Exposed"
    assert [e.url for e in z.evidence] == [None, "https://api.example.com/x?token=REDACTED"]
    assert got["gh"].network == "Internet Exposed" and got["gh"].command_line == "npx github-mcp"
    assert got["lan"].network == "LAN"
    assert got["lan"].transport == "sse" and got["lan"].auth == "None"


def test_env_references(spark, ctx, corpus):
    host = spark.createDataFrame([("s", "TOK")], "scan_id string, name string")
    rows = M.env_references(M.mcp_servers(corpus([("/r/mcp.json", SERVERS)]), ctx), host).where("server_name = 'alpha'")
    assert [(r.ord, r.name, r.source_key, r.is_set) for r in rows.orderBy("ord").collect()] == [
        (0, "TOK", "config", True), (1, "API_TOKEN", "env", True), (2, "EMPTY_KEY", "env", True), (3, "PLAIN", "env", True)]


def built(spark, ctx, corpus):
    files = corpus([("/r/mcp.json", SERVERS), ("/r/AGENTS.md", "run shell, network"), ("/r/sub/AGENTS.md", "wipe it all"),
                    ("/r/Dockerfile", "FROM python\nRUN pip install crewai"), ("/r/SKILL.md", "---\ndescription: d\n---\ndocker"),
                    ("/r/.cursorrules", "{{user_input}} $HOME")], tools={"/r/AGENTS.md": ["shell", "my_tool"]})
    return contract.Contract(files, scan.scan(files, ctx), ctx)


def meta(spark):
    return spark.createDataFrame([("s", '{"scanId":"s","endpointHostname":"h"}', False), ("empty", '{"scanId":"e"}', False)],
                                 "scan_id string, scan_meta string, host_security boolean")


def test_payload(spark, ctx, corpus, tmp_path):
    c = built(spark, ctx, corpus)
    rows = contract.records(c)
    whole = {r.scan_id: json.loads(r.payload) for r in contract.payload(rows, meta(spark)).collect()}
    assert whole["empty"] == {"scanMeta": {"scanId": "e"}, **{s: [] for s in contract.SECTIONS}}
    doc = whole["s"]
    assert list(doc) == ["scanMeta", "prompts", "skills", "mcpServers", "agents", "agenticApps"]
    agent = next(a for a in doc["agents"] if a["sourceFilePath"] == "/r/AGENTS.md")
    assert [t["name"] for t in agent["tools"]] == ["shell", "my_tool", "alpha", "gh", "lan", "zeta"]
    assert agent["classification"] == "Code" and agent["trustScore"] == 100 - 8 - 7
    other = next(a for a in doc["agents"] if a["sourceFilePath"] == "/r/sub/AGENTS.md")
    assert other["executionModel"] == "Autonomous"
    assert {"label": "Dangerous keyword detected: 'wipe' command", "delta": -15} in other["trustBreakdown"]
    skills = {s["name"]: s for s in doc["skills"]}
    assert set(skills) == {"r/SKILL", "shell", "my_tool", "bash", "npx"}
    assert skills["r/SKILL"]["description"] == "d" and skills["r/SKILL"]["overallGrade"] == "A"
    assert [c["name"] for c in skills["shell"]["consumers"]] == ["r/AGENTS"]
    assert "REDACTED" in skills["bash"]["description"]
    app = doc["agenticApps"][0]
    assert (app["framework"], app["agentCount"], len(app["workflow"]), len(app["toolsByAgent"])) == ("CrewAI", 2, 2, 2)
    server = next(s for s in doc["mcpServers"] if s["name"] == "alpha")
    assert len(server["dependentAgents"]) == 2 and (server["listPart"], server["listParts"]) == (1, 1)
    prompt = next(p for p in doc["prompts"] if p["sourceFilePath"] == "/r/.cursorrules")
    assert prompt["secretRefs"][0]["detail"].endswith("via $") and len(prompt["injectionSurfaces"]) == 2

    parts = contract.payload(rows, meta(spark), size=4).where("scan_id = 's'")
    src.write_payloads(parts, str(tmp_path / "out"))
    back = src.read_reports(spark, str(tmp_path / "out"))
    assert back.count() == parts.count() > 2
    n = back.select(sum([F.size(s) for s in contract.SECTIONS], F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert n == rows.count()

    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"prompts": 5')
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_reports(spark, str(tmp_path / "bad")).collect()


def test_log_rows_join_their_server(spark, ctx, corpus):
    c = built(spark, ctx, corpus)
    logs = spark.createDataFrame([("s", "outbound-url", "URL observed in x", "https://api.example.com/y"),
                                  ("s", "outbound-url", "URL observed in x", "https://nobody.example.com/")],
                                 "scan_id string, category string, detail string, url string")
    record = contract.records(c, logs).where("section = 'mcpServers' and key like 'zeta%'").first().record
    server = json.loads(record)
    assert [e["url"] for e in server["networkEvidence"] if e["source"] == "logs"] == ["https://api.example.com/y"]
    assert len(server["dependentAgents"]) == 2


def test_disclosure_and_conformance(spark, ctx, corpus):
    c = built(spark, ctx, corpus)
    rows = contract.records(c)
    got = {}
    for r in contract.disclosure(rows, c, meta(spark)).collect():
        got.setdefault(r.scan_id, set()).add(r.category)
    assert got["empty"] == {"meta", "roots", "hostname", "version"}
    assert got["s"] == {"meta", "roots", "hostname", "version", "prompts", "skills", "agents", "apps", "commands",
                        "tools", "dependents", "logs", "env"}
    assert contract.violations(rows).count() == 0
    broken = rows.where("section = 'mcpServers'").withColumn("record", F.replace("record", F.lit('"sse"'), F.lit('"odd"')))
    assert [r.value for r in contract.violations(broken).collect()] == ["odd"]


def test_server_id(spark, ctx, corpus):
    row = M.mcp_servers(corpus([("/r/mcp.json", SERVERS)]), ctx).where("server_name = 'gh'").select(
        "id", short_hash(F.lit("/r/mcp.json")).alias("h")).first()
    assert row.id == "gh-" + row.h


def test_long_lists_come_in_parts_that_hold_everything_once(spark, ctx, corpus, monkeypatch):
    files = corpus([("/r/mcp.json", SERVERS), ("/r/Dockerfile", "FROM python\nRUN pip install crewai")]
                   + [(f"/r/d{i}/AGENTS.md", "run shell") for i in range(5)])
    c = contract.Contract(files, scan.scan(files, ctx), ctx)
    whole = [r.record for r in contract.records(c).where("section = 'agenticApps'").collect()]
    monkeypatch.setattr(contract.links, "LIST_PART", 2)
    parts = [json.loads(r.record) for r in contract.records(c).where("section = 'agenticApps'").collect()]
    one = json.loads(whole[0])
    assert len(whole) == 1 and one["agentCount"] == len(one["agents"]) == 5 and len(one["toolsByAgent"]) == 5
    assert len(parts) > 1 and {p["listParts"] for p in parts} == {len(parts)}
    assert sorted(w["step"] for p in parts for w in p["workflow"]) == [1, 2, 3, 4, 5]
    assert sorted(a["id"] for p in parts for a in p["agents"]) == sorted(a["id"] for a in one["agents"])
    assert sorted(t for p in parts for ts in p["toolsByAgent"] for t in ts) == sorted(t for ts in one["toolsByAgent"] for t in ts)


def test_missing_fields_are_violations(spark, ctx, corpus):
    rows = contract.records(built(spark, ctx, corpus))
    broken = rows.where("section = 'agents'").withColumn("record", F.regexp_replace("record", '"author":"[^"]*",', ""))
    assert {(r.field, r.value) for r in contract.violations(broken).collect()} == {("author", None)}
    odd = rows.where("section = 'prompts'").withColumn("record", F.replace("record", F.lit('"tone":"safe"'), F.lit('"tone":"odd"')))
    assert ("secretRefs.tone", "odd") in {(r.field, r.value) for r in contract.violations(odd).collect()}
