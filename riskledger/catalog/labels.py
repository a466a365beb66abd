"""Labels, capability maps and contract enums (fixed values)."""

CAPABILITY = {
    "keyword:shell": "shell_execution", "keyword:browser": "browser_access",
    "keyword:api": "external_api_calls", "keyword:filesystem": "filesystem_access",
    "keyword:network": "network_access", "keyword:execute": "code_execution",
    "keyword:docker": "container_runtime", "keyword:system": "system_prompt",
    "keyword:permissions": "permission_scope", "keyword:dependencies": "dependency_execution",
    "keyword:tools": "tool_declarations", "keyword:secrets": "secret_references",
}
CAPABILITY_LEVEL = {
    "shell_execution": "danger", "code_execution": "danger", "container_runtime": "danger",
    "network_access": "warn", "external_api_calls": "warn", "browser_access": "warn",
    "secret_references": "warn",
}
CAPABILITY_LABEL = {
    "shell_execution": "Shell execution", "browser_access": "Browser access",
    "external_api_calls": "External API calls", "filesystem_access": "Filesystem read/write",
    "network_access": "Network access", "code_execution": "Code execution",
    "container_runtime": "Container runtime", "system_prompt": "System prompt control",
    "permission_scope": "Permission scope declarations",
    "dependency_execution": "Dependency execution", "tool_declarations": "Tool declarations",
    "secret_references": "Secret references",
}
# capability -> permissions it implies, in order
CAPABILITY_PERMISSIONS = {
    "shell_execution": ["Shell execution"], "code_execution": ["Shell execution"],
    "filesystem_access": ["Filesystem read/write"], "network_access": ["Network access"],
    "external_api_calls": ["Network access"], "browser_access": ["Network access"],
    "container_runtime": ["Shell execution", "Network access"],
    "secret_references": ["Secret access"],
}
AGENT_FLAGS = [
    ("Filesystem", ["filesystem_access"]), ("Browser", ["browser_access"]),
    ("Network", ["network_access", "external_api_calls"]),
    ("Shell", ["shell_execution", "code_execution"]), ("Database", ["database_access"]),
]
LOCAL_ANALYSIS_SIGNALS = [
    "credential_exposure_signal", "dangerous_combo:shell+network+fs",
    "dangerous_keyword:exfiltrate", "dangerous_keyword:reverse", "dangerous_keyword:steal",
    "dangerous_keyword:wipe", "dangerous_keyword:bypass", "keyword:shell", "keyword:browser",
    "keyword:api", "keyword:execute", "keyword:network", "keyword:filesystem",
]
LOCAL_ANALYSIS_PREFIXES = ["secret:", "ssrf:", "cognitive_tampering:"]

REASON_LABELS = {
    "keyword:api": "Makes external API calls",
    "keyword:shell": "Runs shell commands",
    "keyword:browser": "Controls a browser",
    "keyword:execute": "Executes code at runtime",
    "keyword:network": "Accesses the network",
    "keyword:filesystem": "Reads/writes the filesystem",
    "keyword:docker": "Uses container runtimes",
    "keyword:system": "Sets or overrides the system prompt",
    "keyword:permissions": "Requests elevated permissions",
    "keyword:tools": "Declares callable tools",
    "keyword:dependencies": "Installs or runs dependencies",
    "keyword:secrets": "References secrets or credentials",
    "keyword:instructions": "Contains instruction directives",
    "credential_exposure_signal": "Credential / secret exposure",
    "json_config:credential_connection_string":
        "JSON config embeds credentials in a connection string",
    "json_config:credential_value": "JSON config contains an embedded credential value",
    "json_config:metadata_url": "JSON config references a metadata or localhost URL",
    "json_config:internal_url": "JSON config references an internal-only URL",
    "json_config:c2_url": "JSON config references a known collector or C2 URL",
    "source:dynamic_import": "Source code uses import() with a non-literal argument",
    "source:nonliteral_require": "Source code uses require() with a non-literal argument",
    "source:nonliteral_spawn": "Source code spawns a process with a non-literal command",
    "source:ssrf_private_ip": "Source code makes a network call to a private or link-local IP",
    "source:ssrf_internal_host": "Source code makes a network call to an internal hostname",
    "source:sensitive_path_access": "Source code accesses sensitive local credential paths",
    "cognitive_tampering:file_target": "Source code targets agent identity or instruction files",
    "cognitive_tampering:file_write": "Source code may modify agent identity or instruction files",
    "cognitive_tampering:role_override": "Role-override prompt injection",
    "cognitive_tampering:instruction_injection": "Instruction override / prompt injection",
    "cognitive_tampering:delimiter_framing": "Prompt framing / delimiter injection",
    "cognitive_tampering:unicode_steganography": "Hidden unicode instruction markers",
    "cognitive_tampering:base64_encoded": "Base64-encoded instruction content",
    "mcp_server_declared": "Declares an MCP server",
    "dangerous_combo:shell+network+fs": "Shell + network + filesystem combined",
    "dangerous_keyword:exfiltrate": "References data exfiltration",
    "dangerous_keyword:wipe": "References destructive wiping",
    "dangerous_keyword:rm": "References file deletion",
    "dangerous_keyword:steal": "References data theft",
    "dangerous_keyword:upload": "References data upload",
    "dangerous_keyword:reverse": "References reverse connection",
    "dangerous_keyword:disable": "References disabling protections",
    "dangerous_keyword:bypass": "References bypassing controls",
    "extensions_directory_present": "Browser extensions directory found",
}
REASON_PREFIX_LABELS = [
    ("secret:", "Credential / secret exposure"),
    ("ssrf:", "Potential SSRF target or evasion pattern"),
    ("extension_count:", "Browser extensions installed"),
    ("mcp_server_count:", "Multiple MCP servers declared"),
]

TRANSPORT_DETAIL = {
    "stdio": "Local process pipe — no network listener",
    "sse": "HTTP Server-Sent Events — requires network endpoint",
    "streamable-http": "HTTP streaming — requires network endpoint",
}
# (any of these substrings, package, behavior); first row that fits wins
KNOWN_PACKAGES = [
    (["playwright"], "playwright",
     "Controls browser instances via CDP; browser may make arbitrary internet requests"),
    (["chrome-devtools"], "chrome-devtools",
     "Connects to Chrome via DevTools Protocol (local WebSocket); browser may make internet requests"),
    (["github-mcp", "github/github"], "github-mcp-server",
     "Outbound HTTPS to api.github.com and api.githubcopilot.com"),
    (["next-devtools"], "next-devtools-mcp",
     "Connects to local Next.js dev server; may proxy API calls to external services"),
    (["filesystem", "fs-mcp", "fs-server"], "filesystem",
     "Local filesystem access only; no outbound network connections"),
    (["sqlite"], "sqlite", "Local database access only; no outbound network connections"),
    (["puppeteer"], "puppeteer",
     "Controls headless Chromium; browser may make arbitrary internet requests"),
    (["terraform", "tfe"], "terraform",
     "Outbound HTTPS to HCP Terraform / Terraform Enterprise API"),
]
SECRET_FLAG_WORDS = ["api_key", "apikey", "secret", "token", "password", "credential", "auth",
                     "bearer", "access_token", "key", "cred", "passphrase"]
ENV_CREDENTIAL_WORDS = ["token", "key", "secret", "password", "auth", "credential"]

# tool -> (skill type, environment, binaries, description, permissions)
TOOL_SKILLS = {
    "shell": ("CLI Tool", "Local Process", ["bash"],
              "Executes shell commands via local bash interpreter with unrestricted system access",
              ["Shell execution", "Filesystem read/write"]),
    "bash": ("CLI Tool", "Local Process", ["bash"],
             "Executes shell commands via local bash interpreter with unrestricted system access",
             ["Shell execution", "Filesystem read/write"]),
    "browser": ("HTTP Integration", "Remote API", [],
                "Controls a browser instance for web navigation and interaction",
                ["Network access"]),
    "api": ("HTTP Integration", "Remote API", [],
            "Makes HTTP requests to external API services", ["Network access"]),
    "docker": ("CLI Tool", "Container", ["docker"],
               "Manages Docker containers and images via the Docker CLI",
               ["Shell execution", "Network access"]),
    "python": ("CLI Tool", "Local Process", ["python"],
               "Executes Python scripts via local interpreter with unrestricted filesystem access",
               ["Shell execution"]),
    "node": ("CLI Tool", "Local Process", ["node"],
             "Executes Node.js scripts via local runtime with unrestricted filesystem access",
             ["Shell execution"]),
    "filesystem": ("Local Function", "Local Process", [],
                   "Reads and writes files on the local filesystem",
                   ["Filesystem read/write"]),
}
GRADE_TRUST = {"A": "Trusted", "B": "Conditional", "C": "Untrusted", "F": "Untrusted"}

DISCLOSURE_LABELS = {
    "meta": "Scan metadata", "roots": "Scan root paths", "hostname": "Machine hostname",
    "host_security": "Host security context (macOS firewall state on macOS; empty elsewhere)", "version": "Scanner version",
    "prompts": "AI prompt configuration records", "skills": "Scanned skill records",
    "agents": "AI agent configuration records", "apps": "Agentic application records",
    "commands": "MCP server command(s)", "tools": "MCP tool name(s)",
    "dependents": "MCP dependent agent reference(s)",
    "logs": "Log-derived network evidence (URLs observed in application logs)", "env": "Environment variable name(s) (names only, not values)",
}
