import pytest

from riskledger.operators import source_risk as R
from riskledger.sources import files as src

PARTS = ["const x = 1;\n", "\r\n", "spawn(cmd);\r\n", "é" * 40 + "\n", "readFile(\"agents.md\");\n", "\n", "fetch('http://10.0.0.7/t');\n", "writeFileSync(\"soul.md\", x);\n"]


@pytest.fixture()
def ranges(spark):
    setting = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    yield lambda n: spark.conf.set(setting, str(n))
    spark.conf.set(setting, usual)


def folder_of(tmp_path):
    root = tmp_path / "root"
    (root / "a b+c%20").mkdir(parents=True)
    bodies = {"a b+c%20/one.ts": "".join(PARTS * 30), "two.ts": "".join(PARTS[2:] * 7).rstrip("\n"), "empty.ts": "", "blank.ts": "\n\n", "x.bin": "\n"}
    for name, body in bodies.items():
        (root / name).write_bytes(body.encode())
    (root / "bad.ts").write_bytes(b"\xff\nok")
    return root, bodies | {"bad.ts": "�\nok"}


@pytest.mark.parametrize("size", [37, 1000, 1 << 20])
def test_lines_do_not_depend_on_ranges(spark, ranges, tmp_path, size):
    root, bodies = folder_of(tmp_path)
    ranges(size)
    got = src.read_lines(spark, str(root), "s", name_glob="*.ts").collect()
    want = set()
    for name, body in bodies.items():
        lines = body.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want |= {(f"{root}/{name}", i + 1, line.removesuffix("\r")) for i, line in enumerate(lines) if name.endswith(".ts")}
    assert len(got) == len(want) and {(r.path, r.line, r.text) for r in got} == want


def test_findings_in_lines_equal_those_of_whole_files(spark, ctx, ranges, tmp_path):
    root, _ = folder_of(tmp_path)
    files = src.read_files(spark, str(root), "s", name_glob="*.ts")
    want = sorted(map(tuple, R.source_findings(files, ctx).collect()))
    ranges(100)
    got = sorted(map(tuple, R.findings_in_lines(src.read_lines(spark, str(root), "s", name_glob="*.ts")).collect()))
    assert got == want and len({r[3] for r in want}) >= 4
    assert R.findings_in_lines(src.read_lines(spark, str(root), "s", name_glob="empty.ts")).count() == 0
