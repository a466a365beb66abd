import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskledger.operators import corpus as C, detectors as D, links, source_risk as R
from riskledger.plans import contract, scan


def apps_of(spark, ctx, files):
    c = contract.Contract(files, scan.scan(files, ctx), ctx)
    return c.agents.collect(), c.apps.collect()


def test_plain_image_is_no_app(spark, ctx, corpus):
    agents, apps = apps_of(spark, ctx, corpus([("/r/Dockerfile", "FROM python:3.11-slim\nEXPOSE 8080/tcp\n")]))
    assert (agents, apps) == ([], [])


def test_agentic_compose_is_an_app(spark, ctx, corpus):
    agents, apps = apps_of(spark, ctx, corpus([
        ("/r/docker-compose.yml", "services:\n  runner:\n    image: acme/langgraph-runner\n")]))
    assert agents == [] and [(a.framework, a.agent_count) for a in apps] == [("LangGraph", 0)]


def test_image_beside_an_agent_is_an_app(spark, ctx, corpus):
    agents, apps = apps_of(spark, ctx, corpus([
        ("/r/p/Dockerfile", "FROM python\n"), ("/r/p/AGENTS.md", "use the shell"), ("/r/q/Dockerfile", "FROM x\n")]))
    assert len(agents) == 1 and [(a.name, a.agent_count) for a in apps] == [("p/Dockerfile", 1)]


SOURCE = """await import(loader);
require(runtimeModule)
spawn(commandName, args)
fetch("http://10.0.0.7/token")
request("http://service.internal/x")
"""


def test_source_findings(spark, ctx, corpus):
    clean = 'import("./a"); require("b"); spawn("ls", ["-l"]); spawn(["x"]);\nconst ip = "10.0.0.7";\nimport(\n'
    rows = R.findings(corpus([("/r/a.ts", SOURCE), ("/r/b.ts", clean),
                              ("/r/w.js", 'x\nwriteFileSync("Soul.md")\nreadFile("memory.md")')]), ctx).collect()
    got = {(r.path, r.signal): r.line for r in rows}
    assert got == {
        ("/r/a.ts", "source:dynamic_import"): 1, ("/r/a.ts", "source:nonliteral_require"): 2,
        ("/r/a.ts", "source:nonliteral_spawn"): 3, ("/r/a.ts", "source:ssrf_private_ip"): 4,
        ("/r/a.ts", "source:ssrf_internal_host"): 5, ("/r/w.js", "cognitive_tampering:file_write"): 3,
        ("/r/w.js", "cognitive_tampering:file_target"): 3}


def test_json_findings(spark, ctx, corpus):
    text = '{\n"password": "hunter2hunter2",\n"db": "postgres://u:p@h/x",\n"u": "https://localhost/x"}'
    rows = R.findings(corpus([("/r/c.json", text), ("/r/package.json", text)]), ctx).collect()
    assert {(r.path, r.signal, r.line) for r in rows} == {
        ("/r/c.json", "json_config:credential_value", 2), ("/r/c.json", "json_config:credential_connection_string", 3),
        ("/r/c.json", "json_config:metadata_url", 4)}


def test_surface_needs_an_agent_file(spark, ctx, corpus):
    assert R.source_surface(corpus([("/r/a/a.ts", SOURCE)]), ctx).count() == 0
    row = R.source_surface(corpus([("/r/a/a.ts", SOURCE), ("/r/a/b/c.py", "x"), ("/r/AGENTS.md", "")]), ctx).first()
    assert row.path == "/r/a" and row.scanned_source_file_count == 2 and row.confidence == 0.65
    assert row.finding_counts == {"dynamic_execution": 3, "network_context": 2}


def test_common_root(spark):
    def brute(ps):
        parts = [p.split("/") for p in ps]
        out = []
        for level in zip(*parts):
            if len(set(level)) > 1:
                break
            out.append(level[0])
        return "/".join(out) or None
    rng = random.Random(5)
    for _ in range(40):
        ps = ["/" + "/".join(rng.choice(["a", "ab", "b"]) for _ in range(rng.randint(1, 4))) + "/f" for _ in range(rng.randint(1, 3))]
        df = spark.createDataFrame([(min(ps), max(ps))], "lo string, hi string")
        got = df.select(R.common_root(F.col("lo"), F.col("hi")).alias("o")).first().o
        assert (got or "").rstrip("/") == (brute(ps) or ""), ps


def test_result_ignores_partitioning(spark, ctx, corpus):
    from fleet_queries.corpus import files
    base = files(spark, "/root/testdata/sf0.001")
    cols = ["path", "rule_name", "signals", "risk_score", "risk_reasons", "verification_status"]
    one = scan.scan(base.coalesce(1), ctx).select(cols)
    many = scan.scan(base.repartition(13, F.rand(3)), ctx).select(cols)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0 and one.count() > 50


def test_severity_filter_uses_the_score(spark, ctx, corpus):
    rows = scan.scan(corpus([("/r/AGENTS.md", "ghp_x")]), ctx)
    assert rows.first().verification_status == "critical"
    assert scan.filter_by_severity(rows, "high").count() == 0


def test_walk_order_and_ranks_against_brute_force(spark):
    rows = [("hot" if i % 3 else f"s{i % 5}", f"/p/{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "scan_id string, path string")
    order = F.sha2(F.concat_ws("/", "scan_id", "path"), 256)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id").orderBy(order)))
    got = C.spread_rank(df, ["scan_id"], order).drop("rank_total")
    assert got.select("scan_id", "path", "rank").exceptAll(want.withColumn("rank", F.col("rank").cast("bigint"))).count() == 0
    every = C.in_walk_order(df)
    assert every.select("scan_id", "path", F.col("walk_rank").alias("rank")).exceptAll(want.withColumn("rank", F.col("rank").cast("bigint"))).count() == 0
    assert every.count() == 3000 and {r.walk_total for r in every.where("scan_id = 'hot'").collect()} == {2000}


def test_beyond_top_n_is_the_rest(spark):
    rows = [("hot" if i % 3 else f"s{i % 5}", i * 7919 % 1000, f"/p/{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "scan_id string, score int, path string")
    order = [F.desc("score"), F.asc("path")]
    first = C.top_n(df, ["scan_id"], order, 3, ["path"], salts=8).drop("rank")
    rest = C.beyond_top_n(df, ["scan_id"], order, 3, ["path"], salts=8)
    assert rest.columns == df.columns and first.intersect(rest).count() == 0 and first.count() + rest.count() == 900


def test_top_n_against_brute_force(spark):
    df = spark.range(2000).selectExpr("concat('k', id % 2) k", "id % 97 v", "id")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id"))).where("rank <= 7")
    got = C.top_n(df, ["k"], [F.desc("v"), F.asc("id")], 7, ["id"])
    assert got.select("k", "v", "id", "rank").exceptAll(want.select("k", "v", "id", "rank")).count() == 0


def test_long_lists_stay_whole(spark):
    edges = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'x' ELSE 'hot' END k", "id")
    sizes = links.list_parts(edges, ["k"], 100)
    parts = links.chunked_lists(edges, sizes, ["k"], F.col("id"), "id").collect()
    hot = [r for r in parts if r.k == "hot"]
    assert len(hot) == {r.k: r.parts for r in sizes.collect()}["hot"] > 20 and max(len(r["items"]) for r in hot) < 250
    assert sorted(i for r in hot for i in r["items"]) == [i for i in range(5000) if i % 3]
    rows = spark.createDataFrame([("x",), ("none",)], "k string")
    got = {(r.k, r.part, r.parts): r.ids for r in links.with_list(rows, edges, ["k"], F.col("id"), "id", "ids").collect()}
    assert got.pop(("none", 0, 1)) is None and sorted(i for ids in got.values() for i in ids) == list(range(0, 5000, 3))


MARKS = [".vscode", ".vscode-insiders", ".cursor", ".claude", "Code/User", "Cursor/User"]


def random_reach(seeds):
    """Agent directories and servers of one scan a seed, and what each directory reaches."""
    agents, servers, want = [], [], {}
    for seed in seeds:
        rng, scan_id = random.Random(seed), f"s{seed}"
        seg = ["p", "p1", "p13", ".vscode", ".vscode-insiders", "Code/User", ".claude", "x"]
        dirs = sorted({"/" + "/".join(rng.choice(seg) for _ in range(rng.randint(0, 4))) for _ in range(30)})
        rng.shuffle(dirs)
        own = [(scan_id, d, f"{d}/mcp.json", f"n{rng.randint(0, 6)}") for d in dirs[:18] for _ in range(2)]
        for a in dirs[10:]:
            agents.append((scan_id, a))
            for _, d, path, name in own:
                if a.startswith(d) or d.startswith(a) or any(m in a and m in d for m in MARKS):
                    want[(scan_id, a, name)] = min(path, want.get((scan_id, a, name), path))
        servers += own
    return agents, servers, want


def test_reach_against_brute_force(spark):
    agents, servers, want = random_reach(range(25))
    agent_rows = spark.createDataFrame(agents, "scan_id string, dir string")
    server_rows = spark.createDataFrame(servers, "scan_id string, dir string, path string, server_name string")
    scopes = links.server_scopes(agent_rows, server_rows)
    assert {(r.scan_id, r.agent_dir, r.server_name): r.first_path for r in scopes.pairs().collect()} == want
    counts = {(r.scan_id, r.agent_dir): r.servers for r in links.reach_counts(agent_rows, server_rows).collect()}
    assert counts == {a: sum(k[:2] == a for k in want) for a in agents}
    some = spark.createDataFrame([("s3", "n1"), ("s4", "n2")], "scan_id string, server_name string")
    few = {(r.scan_id, r.agent_dir, r.server_name) for r in scopes.pairs(names=some).collect()}
    assert few == {k for k in want if (k[0], k[2]) in {("s3", "n1"), ("s4", "n2")}}
    one = spark.createDataFrame([agents[0]], "scan_id string, agent_dir string")
    assert {(r.scan_id, r.agent_dir) for r in scopes.pairs(one).collect()} == {agents[0]}


def test_reach_of_a_root_config_stays_linear(spark):
    agents = [("s", f"/r/p{i}") for i in range(300)] + [("s", f"/r/.claude/a{i}") for i in range(100)]
    servers = [("s", "/r", "/r/mcp.json", f"n{i}") for i in range(200)] + [("s", f"/r/.claude/b{i}", f"/r/.claude/b{i}/mcp.json", f"m{i}") for i in range(100)]
    agent_rows = spark.createDataFrame(agents, "scan_id string, dir string")
    server_rows = spark.createDataFrame(servers, "scan_id string, dir string, path string, server_name string")
    scopes = links.server_scopes(agent_rows, server_rows)
    assert scopes.directories.count() + scopes.servers.count() <= 3 * (len(agents) + len(servers))
    counts = {r.agent_dir: r.servers for r in links.reach_counts(agent_rows, server_rows).collect()}
    assert {counts[d] for _, d in agents[:300]} == {200} and {counts[d] for _, d in agents[300:]} == {300}


def test_nearest_repo(spark):
    entries = spark.createDataFrame([("s", "/a/b/c"), ("s", "/a"), ("s", "/ab"), ("t", "/a/b")], "scan_id string, dir string")
    repos = spark.createDataFrame([("s", "/a", "r1", "h"), ("s", "/a/b", "r2", "h")], "scan_id string, dir string, remote string, head string")
    got = {(r.scan_id, r.dir): (r.remote, r.relative_path) for r in links.nearest_repo(entries, repos).collect()}
    assert got == {("s", "/a/b/c"): ("r2", "c"), ("s", "/a"): ("r1", ""), ("s", "/ab"): (None, None), ("t", "/a/b"): (None, None)}


def test_modes():
    assert D.detectors_for("workdir") == ["custom_rules", "containers", "mcp_configs", "source_risks"]
    assert "browser_footprints" in D.detectors_for("host") and "source_risks" not in D.detectors_for("host")
    assert not D.cacheable("workdir", "containers") and D.cacheable("file", "source_risks")
    assert not D.cacheable("workdir", "source_risks") and D.cacheable("scan", "mcp_configs")


def test_browser_artifacts_join_the_scan(spark, corpus):
    ctx = scan.options(spark, mode="host")
    dirs = spark.createDataFrame([("s", "/b", f"/b/{p}") for p in (
        "Profile 1/Extensions/a", "Default/Extensions/x", "Default/Extensions/y", "Default/Extensions/y/1.0", "Default/Cache/z")],
        "scan_id string, profile_root string, path string")
    row = scan.scan(corpus([("/r/AGENTS.md", "x")]), ctx, dirs).where("detector = 'browser_footprints'").first()
    assert (row.extension_count, row.path, row.artifact_scope, row.risk_score) == (2, "/b/Default/Extensions", "host", 5)
    fewer = scan.identify(D.browser_footprints(dirs.where("path not like '%/x'"))).first()
    assert len(row.artifact_hash) == 64 and row.artifact_hash != fewer.artifact_hash
