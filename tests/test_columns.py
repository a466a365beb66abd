import random

import pytest
from pyspark.sql import functions as F

from riskledger.functions import jsontext as J, paths, scoring as S, text as T, urls as U
from riskledger.plans import scan as plan


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_utf8_text_keeps_everything(spark):
    rng = random.Random(3)
    pieces = ["a", "é", "€", "😀", "zz"]
    rows = []
    for _ in range(300):
        data = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))).encode()
        if rng.random() < 0.5:
            cut = rng.randint(0, len(data))
            data = data[:cut] + bytes([rng.choice([0xFF, 0xC3, 0xE2, 0x80])]) + data[cut:]
        rows.append(bytearray(data))
    assert column(spark, rows, T.utf8_text, "binary") == [bytes(r).decode(errors="replace") for r in rows]
    for r, s in zip(rows, column(spark, rows, T.strict_text, "binary")):
        try:
            assert bytes(r).decode() == s
        except UnicodeDecodeError:
            assert s is None


def test_front_matter(spark):
    texts = ['---\nname: x\ndescription: "Does it"\n---\nbody', "---\ndescription:\n  two\n\tlines\nother: 1\n---\n",
             "no matter", "---\nname: x\n---\n", "---\ndescription: 'q'\n--- ", "---\ndescription: open"]
    assert column(spark, texts, T.front_matter_description) == ["Does it", "two lines", None, None, "q", None]


def test_semver(spark):
    got = column(spark, ["v1.2.3", "1.2", "1.2.x", "1.10.0", "1.2.3.4"], T.semver)
    assert [tuple(g) if g else None for g in got] == [(1, 2, 3), None, None, (1, 10, 0), None]


def test_paths(spark):
    p = ["/a/b/.cursorrules", "/a/AGENTS.md", "AGENTS.md", "/AGENTS.md", "/x/y.tar.gz"]
    assert column(spark, p, paths.parent_dir) == ["/a/b", "/a", "", "/", "/x"]
    assert column(spark, p, paths.qualified_name) == [
        "b/.cursorrules", "a/AGENTS", "unknown/AGENTS", "unknown/AGENTS", "x/y.tar"]
    assert column(spark, [".env", "a.PY", "a.", "x"], paths.extension) == ["", "PY", "", ""]


@pytest.mark.parametrize("raw,safe", [
    ("https://user:p@ss@host/x", "https://host/x"), ("https://h/?token=abc&b=1", "https://h/?token=REDACTED&b=1"),
    ("https://h/#access_key%3Dabc", "https://h/#access_key=REDACTED"), ("https://h/x?b=1", "https://h/x?b=1")])
def test_redaction(spark, raw, safe):
    assert column(spark, [raw], U.redact_url) == [safe]


def test_remotes_and_hosts(spark):
    remotes = ["https://tok@github.com/o/r", "git@github.com:o/r.git", "git@h:/o", "/local", "file:///x", "", "ssh://u@h/p"]
    assert column(spark, remotes, U.sanitize_remote) == [
        "https://github.com/o/r", "ssh://github.com/o/r.git", "ssh://h/o", "unknown", "unknown", "unknown", "ssh://h/p"]
    hosts = ["LOCALHOST", "127.8.0.1", "10.0.0.1", "172.32.0.1", "172.31.0.1", "192.168.0.300", "::1", "fd00::1", "fe80::2",
             "2001:db8::1", "example.com", "0:0:0:0:0:0:0:1"]
    assert column(spark, hosts, U.is_private_host) == [
        True, True, True, False, True, False, True, True, True, False, False, True]
    urls = ["http://example.com", "https://example.com", "http://10.0.0.1:80/x", "ftp://x", "x", "https://"]
    assert column(spark, urls, U.endpoint_status) == [
        "public_http", "public_not_allowed", "allowed", "unsupported_scheme", "missing_scheme", "no_host"]
    assert column(spark, ["[::1]:80", "h:80", "::1", "h"], U.strip_port) == ["::1", "h", "::1", "h"]


def _scored(spark, rows):
    df = spark.createDataFrame(rows, "artifact_type string, signals array<string>, declared_tools array<string>")
    df = df.withColumns({"permissions": F.array().cast("array<string>"), "api_endpoints": F.array().cast("array<string>")})
    return plan.grade(plan.score(df)).collect()


def test_scores(spark):
    rows = _scored(spark, [
        ("cursor_rules", ["keyword:shell"], ["shell"]),
        ("agents_md", ["keyword:instructions", "keyword:shell", "dangerous_keyword:steal"], []),
        ("agents_md", ["credential_exposure_signal", "secret:crypto:rsa_private_key"], []),
        ("other", ["extension_count:50", "mcp_server_count:3", "unknown"], []),
        ("skill", ["keyword:shell", "keyword:shell"], []),
        ("agents_md", ["dangerous_keyword:wipe"], ["shell"]),
        ("agents_md", ["dangerous_combo:shell+network+fs"], []),
    ])
    assert [r.risk_score for r in rows] == [17, 61, 33, 30, 38, 38, 38]
    assert rows[1].risk_reasons == ["dangerous_keyword:steal (+35)", "keyword:shell (+15)"]
    assert rows[4].risk_reasons == ["keyword:shell (+15)", "keyword:shell (+15)"]
    assert [r.verification_status for r in rows] == ["low", "high", "critical", "low", "low", "medium", "medium"]


def test_bands(spark):
    assert column(spark, [90, 89, 70, 40, 10, 9], S.severity_band, "int") == [
        "critical", "high", "high", "medium", "low", "info"]


def test_server_maps_are_sorted_and_typed(spark):
    text = '{"servers": {"b": {"command": 5}, "a": {"url": "u", "command": "c"}}}'
    got = column(spark, [text, "[1]", "{", '{"mcpServers": 1, "servers": {"x": {}}}'],
                 lambda c: J.server_entries(J.normal_json(c)))
    assert [e.key for e in got[0]] == ["a", "b"] and got[1:] == [None, None, None]
    assert column(spark, ['{"command":5}', '{"command":"c"}'], lambda c: J.json_string(c, "command")) == [None, "c"]


def test_pages_by_position_equal_sorted_pages(spark, tmp_path):
    from riskledger.operators import catalog as K
    rows = spark.range(500).selectExpr("concat('s', id) slug", "id % 7 downloads", "CASE WHEN id % 9 = 0 THEN NULL ELSE concat('n', id % 50) END name")
    for sort, reverse in (("downloads", False), ("alpha", True)):
        folder = str(tmp_path / sort)
        K.write_sorted(rows, folder, sort, reverse, ranges=9)
        stored = spark.read.parquet(folder)
        for number in (1, 7, 18, 29, 30):
            want = K.page(rows, sort, reverse, number, 17).select("slug", "total", "total_pages").collect()
            assert K.page_of(stored, sort, reverse, number, 17).select("slug", "total", "total_pages").collect() == want


def test_ranked_search_and_update(spark):
    import math
    from riskledger.operators import catalog as K
    rows = [("a", "red fox", "a fox, a red fox"), ("b", "blue", None), ("c", "", "fox"), ("d", None, "")]
    frame = spark.createDataFrame(rows, "slug string, name string, description string")
    index = K.search_index(frame.where("slug <> 'd'"))
    index = K.update_index(index, frame.where("slug in ('c', 'd')"))
    words = {s: " ".join(x or "" for x in (s, n, d)).replace(",", " ").split() for s, n, d in rows}
    mean = sum(map(len, words.values())) / 4
    want = {}
    for term in ("fox", "red"):
        held = [s for s, w in words.items() if term in w]
        for s in held:
            t = words[s].count(term)
            want[s] = want.get(s, 0) + math.log(1 + (4 - len(held) + 0.5) / (len(held) + 0.5)) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * len(words[s]) / mean))
    got = {r.slug: r.score for r in K.ranked(index, "Red fox!").collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    assert [r.slug for r in K.ranked(index, "fox", 1).collect()] == ["a"] and K.ranked(index, "none").collect() == []
