"""File names, directory names and token lists (fixed values)."""

EXCLUDED_DIRS = [
    ".git", ".hg", ".svn", ".venv", "venv", "node_modules", "dist", "build", "__pycache__",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".idea", ".next", "target",
    ".cache", "cache", "Caches", ".cargo", ".rustup", ".npm", ".pnpm-store", ".yarn", ".gradle",
    ".m2", ".terraform", ".bundle", ".gem", ".nuget", ".swiftpm", ".build", "DerivedData",
    "vendor",
]
SYSTEM_EXCLUDED_DIRS = [
    "proc", "sys", "dev", "run", "snap", "boot", "tmp", "private", "cores", "Volumes", "Network",
    "automount", "System", "Library",
]
HOST_CONFIG_DIRS = [
    ".claude", ".cursor", ".aider", ".ollama", ".continue", ".vscode", ".vscode-insiders",
]
EDITOR_USER_DIRS = ["Code/User", "Code - Insiders/User", "Cursor/User"]
EDITOR_BASE = {"macos": "Library/Application Support", "linux": ".config",
               "windows": "AppData/Roaming"}
USER_SPACE_DIRS = {
    "macos": ["Desktop", "Documents", "Downloads", "Developer", "Projects", "Code", "Workspace",
              "Work", "src", "GitHub"],
    "linux": ["Desktop", "Documents", "Downloads", "projects", "code", "workspace", "work", "src",
              "git", "GitHub"],
    "windows": ["Desktop", "Documents", "Downloads", "Projects", "Code", "Workspace", "Source",
                "src", "GitHub"],
}
DEEP_PATH = 5

CONTENT_NAMES = [
    ".cursorrules", "agents.md", "AGENTS.md", "mcp.json", "mcp_config.json",
    "claude_desktop_config.json", "Dockerfile", "compose.yaml", "compose.yml",
    "docker-compose.yaml", "docker-compose.yml", "SKILL.md", "skill.md",
]
CONTENT_CONTAINS, CONTENT_SUFFIX = "prompt", ".instructions.md"
LOG_HORIZON_DAYS = 7
LOG_NAME_TOKENS = ["mcp", "copilot", "server", "exthost"]

MCP_NAMES = ["mcp.json", "mcp_config.json", "claude_desktop_config.json", "mcp-config.json",
             "mcp_settings.json"]
EXECUTION_TOKENS = ["/bin/", "npx", "uvx", "node", "python", "deno"]
SHELL_TOKENS = ["shell", "bash", "sh -c", "zsh"]
CREDENTIAL_TOKENS = ["api_key", "apikey", "secret", "token", "password", "credential", "auth"]

CONTAINER_NAMES = ["Dockerfile", "compose.yaml", "compose.yml", "docker-compose.yaml",
                   "docker-compose.yml"]
PROXIMITY_NAMES = [".cursorrules", "agents.md", "AGENTS.md", "mcp.json", "mcp_config.json"]
AI_TOKENS = [
    "langchain", "langgraph", "autogen", "crewai", "autogpt", "opendevin", "swe-agent", "aider",
    "cursor", "copilot", "openai", "anthropic", "ollama", "huggingface", "replicate",
    "together.ai", "groq", "mistral", "llm", "model", "embedding", "vector", "rag", "agent",
    "ai-tool", "mcp",
]
AGENTIC_TOKENS = ["langchain", "langgraph", "autogen", "crewai", "autogpt", "opendevin",
                  "swe-agent", "aider"]

SOURCE_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "go", "rs", "java", "rb", "sh"]
JSON_SKIP_NAMES = ["package.json", "package-lock.json", "tsconfig.json", "openclaw.plugin.json"]
TOP_RISKY_FILES = 5
TEXT_EXTENSIONS = [
    "md", "txt", "json", "yaml", "yml", "toml", "sh", "bash", "zsh", "py", "js", "ts", "mjs",
    "cjs", "rs", "go", "rb", "php", "java", "kt", "swift", "c", "cpp", "h", "cs", "html", "xml",
    "css", "sql", "env", "ini", "cfg", "conf", "lock",
]

DOC_PARTS = ["docs", "doc", "documentation", "reference", "concepts", "examples"]
SCOPE_MARKERS = [".vscode", ".vscode-insiders", ".cursor", ".claude", "Code/User", "Cursor/User"]

NOISY_URL_PARTS = [
    "localhost", "127.0.0.1", "vscode-cdn", "update.code", "telemetry",
    "dc.services.visualstudio.com", "marketplace.visualstudio.com", "gallerycdn.vsassets.io",
    "vortex.data.microsoft.com",
]
REGISTRY_URL_PARTS = ["registry.npmjs.org", "pypi.org", "api.mcp.github.com"]
LOCAL_URL_PARTS = ["localhost", "127.0.0.1", "0.0.0.0"]

MODES = ["host", "scan", "root", "workdir", "file"]
# detector -> (modes it runs in, modes in which its results may be reused)
DETECTOR_MODES = {
    "custom_rules": (MODES, ["host", "scan", "workdir", "file"]),
    "containers": (MODES, []),
    "mcp_configs": (MODES, ["host", "scan", "workdir", "file"]),
    "source_risks": (["workdir", "file"], ["file"]),
    "browser_footprints": (["host", "scan", "root"], []),
}
DETECTOR_RANK = {name: i for i, name in enumerate(DETECTOR_MODES)}
