"""The contract's records: fields in order, which of them are optional, and labels (fixed values)."""

SCAN_META = (
    "scanId string, endpointHostname string, scannedAt string, scannerVersion string, scanDurationMs bigint, "
    "scanRoots array<string>, hostNetwork struct<firewallEnabled:boolean,firewallMode:string,stealthMode:boolean,"
    "firewallRules:array<struct<appPath:string,allowed:boolean>>>")
RECORDS = {
    "prompts": (
        "id string, name string, sourceFilePath string, classification string, tokens bigint, contentHash string, "
        "lastChangedDate string, capabilities array<struct<text:string,level:string>>, "
        "secretRefs array<struct<label:string,detail:string,tone:string>>, "
        "injectionSurfaces array<struct<text:string,severity:string>>, dependencies array<string>, riskScore int"),
    "skills": (
        "id string, name string, type string, trustLevel string, overallGrade string, executionEnvironment string, "
        "description string, permissions array<struct<name:string,required:boolean>>, "
        "dependencies struct<libraries:array<string>,binaries:array<string>,apis:array<string>>, "
        "consumers array<struct<id:string,name:string,type:string,invocations:bigint>>, "
        "externalScannerResults array<struct<source:string,version:string,status:string,verdict:string,rawReport:string,"
        "findings:array<struct<rule_id:string,category:string,severity:string,label:string,detail:string>>>>, "
        "detectedSource struct<status:string,repoUrl:string,branch:string,path:string,remoteUrl:string>"),
    "mcpServers": (
        "id string, name string, transport string, network string, auth string, verified boolean, command string, "
        "tools array<struct<name:string,risk:string,description:string>>, dependentAgents array<string>, "
        "networkEvidence array<struct<source:string,category:string,detail:string,url:string>>, "
        "envVars array<struct<name:string,isSet:boolean,sourceKey:string>>"),
    "agents": (
        "id string, name string, sourceFilePath string, classification string, executionModel string, trustScore int, "
        "version string, author string, sourceRepo string, capabilities array<struct<name:string,enabled:boolean>>, "
        "tools array<struct<name:string,type:string>>, trustBreakdown array<struct<label:string,delta:int>>"),
    "agenticApps": (
        "id string, name string, sourceFilePath string, framework string, agentCount int, risk string, "
        "reviewStatus string, description string, agents array<struct<id:string,name:string>>, "
        "toolsByAgent array<array<string>>, workflow array<struct<step:bigint,agent:string,action:string>>, "
        "integrations array<struct<name:string,type:string,risk:string>>, verificationChecks array<string>, "
        "riskTags array<string>, riskSummary string"),
}
PARTS = "listPart int, listParts int"
OPTIONAL = {"skills": ["externalScannerResults", "detectedSource"]}
LEVELS, RISKS = ["info", "warn", "danger"], ["Low", "Medium", "High"]
# section.field or section.list.field -> allowed values
ENUMS = {
    "prompts.classification": ["System Prompt", "User Prompt", "Tool Prompt"],
    "prompts.capabilities.level": LEVELS,
    "prompts.secretRefs.tone": ["safe", "danger"],
    "prompts.injectionSurfaces.severity": ["low", "medium", "high"],
    "skills.type": ["Local Function", "HTTP Integration", "CLI Tool", "Remote Service"],
    "skills.trustLevel": ["Trusted", "Conditional", "Untrusted"],
    "skills.overallGrade": ["A", "B", "C", "F", "pending"],
    "skills.executionEnvironment": ["Local Process", "Container", "Remote API"],
    "mcpServers.transport": ["stdio", "sse", "streamable-http", "unknown"],
    "mcpServers.network": ["Local Only", "LAN", "Internet Exposed"],
    "mcpServers.auth": ["API Key", "OAuth", "mTLS", "None"],
    "mcpServers.tools.risk": RISKS,
    "agents.classification": ["Code", "Automation", "Research", "System"],
    "agents.executionModel": ["Autonomous", "User-in-the-loop", "Scheduled"],
    "agenticApps.risk": RISKS,
    "agenticApps.reviewStatus": ["Reviewed", "Unreviewed", "Flagged"],
}
FIREWALL_MODES = ["off", "on", "block-all", "unknown"]


def _split(ddl: str) -> list[tuple[str, str]]:
    """``(name, type)`` of the top-level fields."""
    depth, out, word = 0, [], ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(tuple(word.strip().split(" ", 1)))
            word = ""
        else:
            word += ch
    return out


def required(section: str) -> list[str]:
    return [name for name, _ in _split(RECORDS[section]) if name not in OPTIONAL.get(section, [])]


def report_ddl() -> str:
    """A whole document; record parts carry their numbers."""
    def struct(ddl):
        return "struct<" + ",".join(f"{name}:{kind}" for name, kind in _split(ddl)) + ">"
    sections = ", ".join(f"{s} array<{struct(ddl + ', ' + PARTS)}>" for s, ddl in RECORDS.items())
    return f"scanMeta {struct(SCAN_META)}, {sections}"
