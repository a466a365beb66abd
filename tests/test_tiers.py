"""Tiers of files under homes against a plain loop, and a plan that holds one row a home."""

from riskledger.operators import corpus as C

HOMES = [("s", "linux", "/home/a"), ("s", "macos", "/home/a/src/b"), ("t", "linux", "/home/a"), ("t", "amiga", "/x"), ("t", None, "/y"), ("t", "windows", "")]
PATHS = ["/home/a/n.md", "/home/a/src/b/n.md", "/home/a/src/b/.claude/x/n.md", "/home/a/.config/Code/User/m.json", "/home/a/.config/m.json",
         "/home/a/git/src/n", "/home/ab/src/n", "/x/n", "/x/src/n", "/y/n", "/y/src/n", "/src/q/n", "n", None]


def _plain(spark):
    roots = {(r.scan_id, r.root, r.tier, r.tier_rank) for r in C.tier_roots(spark.createDataFrame(HOMES, "scan_id string, os string, home string")).collect()}
    best = {}
    for scan in "st":
        for path in PATHS:
            folder = (path or "").rpartition("/")[0]
            met = [(0, "home") for s, _, h in HOMES if (s, h) == (scan, folder)]
            met += [(n, tier) for s, root, tier, n in roots if s == scan and (folder + "/").startswith(root + "/")]
            if met:
                best[scan, path] = min(met)
    return best


def test_tiers_without_the_roots_of_all_homes(spark):
    homes = spark.createDataFrame(HOMES, "scan_id string, os string, home string")
    files = spark.createDataFrame([(s, p) for s in "st" for p in PATHS], "scan_id string, path string")
    found = C.assign_origin(files.union(files), homes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "explode(sequence" not in plan
    want = _plain(spark)
    assert {(r.scan_id, r.path): r.origin for r in found.collect()} == {k: tier for k, (_, tier) in want.items()}
    first = C.dedupe_first_origin(C.tiers_of(files, homes)).collect()
    assert {(r.scan_id, r.path): (r.tier_rank, r.tier) for r in first} == want and len(first) == len(want)
