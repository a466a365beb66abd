"""Findings in source and JSON files, and the per-scan source surface."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskledger.catalog import names, patterns as P
from riskledger.functions import identity as I, paths, signals as G, text as T
from riskledger.functions.regex import to_java
from riskledger.operators.corpus import top_n, with_path_parts
from riskledger.operators.detectors import NO_STRINGS, ScanOptions
from riskledger.session import cut

FINDING = "struct<family:string,signal:string,line:int,ordinal:int,summary:string>"


def _finding(family: str, signal, line, summary, ordinal: int = 0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(family).alias("family"), as_col(signal).alias("signal"),
                    (F.lit(None) if line is None else as_col(line)).cast("int").alias("line"),
                    F.lit(ordinal).alias("ordinal"), as_col(summary).alias("summary"))


def _present(items) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def eligible(files: DataFrame) -> DataFrame:
    """Source files and JSON configurations with ``is_source``."""
    parts = with_path_parts(files).withColumn("is_source", paths.is_source_file(F.col("name")))
    return parts.where(F.col("is_source") | paths.is_json_config(F.col("name")))


def nonliteral_argument(line: Column, expression: str, literal_starts: str) -> Column:
    """Is the first argument after the first match anything but a literal?"""
    first = F.regexp_extract(line, to_java(expression + r"\s*(\S?)"), 1)
    return (first != "") & ~first.isin(*literal_starts)


# a line cannot give a finding unless it holds one of these (case folded)
_LINE_ANCHORS = {
    "source:dynamic_import": ["import"], "source:nonliteral_require": ["require"],
    "source:nonliteral_spawn": ["spawn", "execfile", "fork"],
}
_SENSITIVE_ANCHORS = [[".openclaw/", "readfile"], ["/environ"], ["_history"], [".ssh/", "id_"],
                      [".aws/", ".kube/", ".docker/", ".npmrc", ".pypirc", ".gnupg/", ".git-cred", ".netrc"]]
_INTERNAL_ANCHORS = ["local", "internal", "corp", "intranet", "private"]


def _line_findings(line: Column, fold: Column, low: Column, number: Column) -> Column:
    items = []
    for signal, summary, expr, starts in P.SOURCE_CALL_PATTERNS:
        ok = G.contains_any(fold, _LINE_ANCHORS[signal]) & nonliteral_argument(line, expr, starts)
        items.append(F.when(ok, _finding("dynamic_execution", signal, number, summary)))
    dotted = line.rlike(r"[0-9]\.[0-9]")
    address = line.rlike(to_java(P.PRIVATE_IP)) | line.rlike(to_java(P.LINK_LOCAL_IP))
    items.append(F.when(dotted & address & line.rlike(to_java(P.NETWORK_CALL)),
                        _finding("network_context", "source:ssrf_private_ip", number, P.PRIVATE_IP_SUMMARY)))
    items.append(F.when(G.contains_any(fold, _INTERNAL_ANCHORS) & line.rlike(to_java(P.INTERNAL_HOST_CONTEXT)),
                        _finding("network_context", "source:ssrf_internal_host", number, P.INTERNAL_HOST_SUMMARY)))
    for i, ((summary, expr), anchors) in enumerate(zip(P.SENSITIVE_PATH_PATTERNS, _SENSITIVE_ANCHORS)):
        items.append(F.when(G.contains_any(fold, anchors) & line.rlike(to_java(expr)),
                            _finding("sensitive_path", P.SENSITIVE_PATH_SIGNAL, number, summary, i)))
    named = F.coalesce(*[F.when(low.contains(n), F.lit(n)) for n in P.IDENTITY_FILES])
    items.append(F.when(named.isNotNull() & line.rlike(to_java(P.TARGET_CALL)),
                        _finding("cognitive_file", "cognitive_tampering:file_target", number,
                                 F.concat(F.lit("Source targets agent identity file "), named))))
    return _present(items)


def _whole_json() -> Column:
    """Findings of a JSON configuration, from its whole text and its secret signals."""
    text = F.col("text")
    items = [F.when(G.hit("text", "fold", expr, anchors),
                    _finding(family, signal, T.line_of(text, F.regexp_instr(text, F.lit(to_java(expr)))), summary))
             for signal, family, summary, expr, anchors in P.JSON_PATTERNS]
    secrets = F.transform("secret_signals", lambda s: _finding("json_secret", s, None, P.JSON_SECRET_SUMMARY))
    return F.concat(secrets, _present(items))


def _identity_write() -> Column:
    """Does a source file name an identity file anywhere and hold a write call?"""
    low = F.col("lower")
    named = F.coalesce(*[F.when(low.contains(n), F.lit(n)) for n in P.IDENTITY_FILES])
    ok = named.isNotNull() & F.col("text").rlike(to_java(P.WRITE_CALL))
    return _present([F.when(ok, _finding(
        "cognitive_file", "cognitive_tampering:file_write", T.line_of(low, F.position(named, low)),
        F.concat(F.lit("Source references and may write agent identity file "), named)))])


def findings(files: DataFrame, ctx: ScanOptions) -> DataFrame:
    """``scan_id, path, family, signal, line, summary``: the earliest finding per file and signal.

    Contents are read once.  Each file gives one row for its whole text and, for source files, one
    row per line, all inside its task; only finding rows, reduced per file first, are shuffled.
    """
    texts = eligible(files).select("scan_id", "path", "is_source", T.utf8_text(F.col("content")).alias("body")).where("body is not null")
    split = F.when(F.col("is_source"), T.lines(F.col("body"))).otherwise(F.array().cast(NO_STRINGS))
    units = texts.select("scan_id", "path", "is_source",
                         F.posexplode(F.concat(F.array("body"), split)).alias("line", "text"))
    whole_json = (F.col("line") == 0) & ~F.col("is_source")
    rows = G.with_signals(units, "text", whole_json, families=["secret"])
    rows = rows.withColumns({"fold": G.folded(F.col("text")), "lower": F.lower("text")})
    found = (F.when(whole_json, _whole_json()).when(F.col("line") == 0, _identity_write())
             .otherwise(_line_findings(F.col("text"), F.col("fold"), F.col("lower"), F.col("line"))))
    every = rows.select("scan_id", "path", F.explode(found).alias("f"))
    return (every.groupBy("scan_id", "path", F.col("f.signal").alias("signal"))
            .agg(F.min(F.struct("f.line", "f.ordinal", "f.family", "f.summary")).alias("m"))
            .select("scan_id", "path", "m.family", "signal", "m.line", "m.summary"))


def findings_in_lines(lines: DataFrame) -> DataFrame:
    """Findings of source files that come as numbered lines (:func:`riskledger.sources.files.read_lines`).

    The columns of :func:`findings`, and its rows, except that a write call which goes over a line end is
    not seen.  Rows are reduced to one a file and signal before they are shuffled, so a file of any size is no
    more than its findings.
    """
    rows = lines.select("scan_id", "path", F.col("line").cast("int").alias("line"), "text").withColumns(
        {"fold": G.folded(F.col("text")), "lower": F.lower("text")})
    every = rows.select("scan_id", "path", F.explode(_line_findings(
        F.col("text"), F.col("fold"), F.col("lower"), F.col("line"))).alias("f"))
    order = ["line", "ordinal", "family", "summary"]
    first = (every.groupBy("scan_id", "path", F.col("f.signal").alias("signal"))
             .agg(F.min(F.struct(*[f"f.{c}" for c in order])).alias("m")))
    named = [F.min(F.when(F.col("lower").contains(n), F.col("line"))) for n in P.IDENTITY_FILES]
    files = rows.groupBy("scan_id", "path").agg(
        F.bool_or(F.col("text").rlike(to_java(P.WRITE_CALL))).alias("writes"),
        *[n.alias(f"named{i}") for i, n in enumerate(named)])
    target = F.coalesce(*[F.when(F.col(f"named{i}").isNotNull(), F.struct(
        F.col(f"named{i}").alias("line"), F.lit(n).alias("name"))) for i, n in enumerate(P.IDENTITY_FILES)])
    written = files.where("writes").withColumn("t", target).where("t is not null").select(
        "scan_id", "path", F.lit("cognitive_file").alias("family"), F.lit("cognitive_tampering:file_write").alias("signal"),
        F.col("t.line").alias("line"), F.concat(F.lit("Source references and may write agent identity file "), "t.name").alias("summary"))
    return first.select("scan_id", "path", "m.family", "signal", "m.line", "m.summary").unionByName(written)


def json_findings(files: DataFrame, ctx: ScanOptions) -> DataFrame:
    return findings(files.where(paths.is_json_config(paths.basename(F.col("path")))), ctx)


def source_findings(files: DataFrame, ctx: ScanOptions) -> DataFrame:
    return findings(files.where(paths.is_source_file(paths.basename(F.col("path")))), ctx)


def common_root(low: Column, high: Column) -> Column:
    """Longest common directory of a set of paths, given the smallest and the largest of them."""
    size = F.least(F.length(low), F.length(high))
    shared = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.struct(F.lit(0).alias("a"), size.alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s).when(
            F.left(low, F.shiftright(s["a"] + s["b"] + 1, 1)) == F.left(high, F.shiftright(s["a"] + s["b"] + 1, 1)),
            F.struct(F.shiftright(s["a"] + s["b"] + 1, 1).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), (F.shiftright(s["a"] + s["b"] + 1, 1) - 1).alias("b"))))["a"]
    prefix = F.left(low, shared)
    whole = (prefix == low) & ((low == high) | high.startswith(F.concat(low, F.lit("/"))))
    cut = paths.parent_dir(F.concat(prefix, F.lit("x")))
    return F.when(whole, low).otherwise(F.nullif(cut, F.lit("")))


def top_risky_files(found: DataFrame, n: int = names.TOP_RISKY_FILES) -> DataFrame:
    """``scan_id, path, findings, rank``: most findings first, then path."""
    counts = found.groupBy("scan_id", "path").agg(F.count("*").alias("findings"))
    return top_n(counts, ["scan_id"], [F.desc("findings"), F.asc("path")], n, ["path"])


def source_surface(files: DataFrame, ctx: ScanOptions) -> DataFrame:
    """One artifact row per scan that has source or JSON files next to agent files."""
    supported = eligible(files)
    counts = supported.groupBy("scan_id").agg(
        F.count_if("is_source").alias("scanned_source_file_count"),
        F.count_if(~F.col("is_source")).alias("scanned_json_file_count"),
        F.min("path").alias("_low"), F.max("path").alias("_high"))
    adjacent = (with_path_parts(files).groupBy("scan_id")
                .agg(F.bool_or(paths.content_allowed(F.col("name"))).alias("ai_adjacent_context")))
    found = cut(findings(supported, ctx))
    by_family = (found.groupBy("scan_id", "family").agg(F.count("*").alias("n"),
                                                        F.collect_set("signal").alias("signals"))
                 .groupBy("scan_id").agg(
                     F.array_sort(F.collect_list(F.struct("family", "n"))).alias("families"),
                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals")))
    top = (top_risky_files(found).groupBy("scan_id")
           .agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("top")))
    rows = counts.join(adjacent, "scan_id").join(by_family, "scan_id", "left").join(top, "scan_id", "left")
    if ctx.mode != "file":
        rows = rows.where("ai_adjacent_context")
    none = F.array().cast(NO_STRINGS)
    rows = rows.select(
        "scan_id", F.coalesce("signals", none).alias("signals"),
        F.coalesce(F.transform("families", lambda f: f["family"]), none).alias("matched_families"),
        F.map_from_entries(F.coalesce("families", F.array().cast("array<struct<family:string,n:bigint>>")))
        .alias("finding_counts"),
        F.coalesce(F.transform("top", lambda t: t["path"]), none).alias("top_risky_files"),
        "scanned_source_file_count", "scanned_json_file_count", "ai_adjacent_context",
        (F.col("_low") if ctx.mode == "file" else
         F.coalesce(common_root(F.col("_low"), F.col("_high")), paths.parent_dir(F.col("_low")))).alias("path"))
    facts = F.struct("ai_adjacent_context", F.map_entries("finding_counts").alias("finding_counts"), "matched_families",
                     "scanned_json_file_count", "scanned_source_file_count", "top_risky_files")
    digest = F.sha2(F.to_json(F.struct(facts.alias("metadata"), none.alias("risk_reasons"),
                                       F.col("signals").alias("signals"))), 256)
    return rows.withColumns({
        "content_digest": digest, "detector": F.lit("source_risks"), "rule_order": F.lit(0),
        "artifact_type": F.lit("source_risk_surface"), "origin": F.lit("project"),
        "confidence": F.when(F.size("signals") > 0, 0.65).otherwise(0.35)})
