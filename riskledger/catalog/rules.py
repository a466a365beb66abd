"""Built-in detection rules and the limits user rules must keep (fixed values)."""

MAX_NAME, MAX_TYPE, MAX_PREFIX, MAX_DESCRIPTION = 64, 64, 32, 200
MAX_MATCH_ENTRIES, MAX_MATCH_LEN = 64, 128
MAX_KEYWORDS, MAX_KEYWORD_LEN = 64, 64
MAX_PATTERNS, MAX_PATTERN_LEN = 32, 256
RESERVED_PREFIXES = ["filename_match", "secret", "ssrf", "cognitive_tampering"]
RESERVED_TYPES = ["cursor_rules", "agents_md", "prompt_config", "mcp_config", "container_config",
                  "container_candidate", "browser_footprint", "skill"]

_INSTRUCTION_WORDS = ["tools", "permissions", "system", "instructions", "shell", "browser", "api"]
_INSTRUCTION_DEEP = ["dependencies", "execute", "network", "filesystem", "docker", "secrets"]
_PROMPT_WORDS = ["tools", "permissions", "shell", "browser", "api", "dependencies"]
_PROMPT_DEEP = ["execute", "network", "filesystem", "docker", "secrets", "system"]


def _block(words, prefix, boost):
    return {"keywords": words, "signals_prefix": prefix, "boost_confidence": boost,
            "boost_threshold": 1}


def _rule(name, artifact_type, description, filenames, confidence, words, boost, deep):
    return {
        "detector": {"name": name, "description": description, "artifact_type": artifact_type},
        "match": {"filenames": filenames, "suffixes": [], "confidence": confidence},
        "keywords": _block(words, "keyword", boost),
        "deep_keywords": _block(deep, "deep_keyword", 0.9),
    }


BUILTIN_RULES = [
    _rule("cursor_rules", "cursor_rules", "Instruction file of an editor agent",
          [".cursorrules"], 0.7, _INSTRUCTION_WORDS, 0.9, _INSTRUCTION_DEEP),
    _rule("agents_md", "agents_md", "Instruction file of a repository's agents",
          ["agents.md", "AGENTS.md"], 0.7, _INSTRUCTION_WORDS, 0.9, _INSTRUCTION_DEEP),
    _rule("prompt_configs", "prompt_config", "Prompt or instruction file by its usual name",
          ["copilot-instructions.md", "*.prompt.md", "*.instructions.md", "*.prompt.yaml",
           "*.prompt.yml"], 0.65, _PROMPT_WORDS, 0.85, _PROMPT_DEEP),
    _rule("prompt_configs_weak", "prompt_config",
          "Text or YAML file with prompt in its name",
          ["*prompt*.md", "*prompt*.yaml", "*prompt*.yml", "*prompt*.txt"], 0.4, _PROMPT_WORDS,
          0.85, _PROMPT_DEEP),
    _rule("skills", "skill", "Skill definition of an agent",
          ["SKILL.md", "skill.md"], 0.75,
          ["tools", "permissions", "instructions", "dependencies", "workflow", "agent", "shell",
           "browser", "api", "filesystem", "network", "docker", "secrets", "execute", "system"],
          0.9, ["sudo", "token", "credential", "subprocess", "spawn", "http", "socket"]),
]
