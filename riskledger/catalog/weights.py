"""Risk weights, type bases and severity bands (fixed values)."""

SEVERITY_BANDS = [("critical", 90), ("high", 70), ("medium", 40), ("low", 10)]
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}

TYPE_BASE = {
    "cursor_rules": 10, "agents_md": 8, "skill": 8, "source_risk_surface": 4,
    "container_config": 12, "container_candidate": 3, "browser_footprint": 5, "mcp_config": 20,
}
TYPE_BASE_DEFAULT = 5
LOCAL_TYPE_BASE = {"cursor_rules": 4, "agents_md": 4, "skill": 4, "prompt_config": 3}
LOCAL_TYPE_BASE_DEFAULT = 1

CAPABILITY_WEIGHTS = {
    "keyword:shell": 15, "keyword:browser": 10, "keyword:api": 10, "keyword:permissions": 8,
    "keyword:system": 5, "keyword:tools": 5, "keyword:instructions": 3, "keyword:execute": 12,
    "keyword:network": 10, "keyword:filesystem": 5, "keyword:docker": 5, "keyword:secrets": 8,
    "keyword:dependencies": 3,
}
DECLARED_TOOL = {
    "keyword:shell": "shell", "keyword:browser": "browser", "keyword:api": "api",
    "keyword:filesystem": "filesystem", "keyword:docker": "docker", "keyword:execute": "python",
}
DECLARED_DISCOUNT = 0.5

SHARED_WEIGHTS = {
    "credential_exposure_signal": 25, "dangerous_combo:shell+network+fs": 30,
    "dangerous_keyword:exfiltrate": 35, "dangerous_keyword:reverse": 35,
    "dangerous_keyword:steal": 35, "dangerous_keyword:wipe": 30, "dangerous_keyword:bypass": 25,
    "keyword:shell": 15, "keyword:browser": 10, "keyword:api": 10, "keyword:network": 10,
    "keyword:execute": 12, "keyword:filesystem": 5,
}
SECRET_WEIGHTS = {
    "secret:aws:access_key": 25, "secret:aws:secret_access_key": 25,
    "secret:aws:session_token": 25, "secret:github:pat": 25, "secret:github:oauth_token": 25,
    "secret:github:fine_grained_pat": 25, "secret:github:app_token": 25,
    "secret:github:refresh_token": 25, "secret:gitlab:pat": 25,
    "secret:gitlab:project_token": 25, "secret:gitlab:oauth_token": 25,
    "secret:stripe:live_secret_key": 25, "secret:stripe:restricted_key": 25,
    "secret:npm:token": 25, "secret:pypi:token": 25,
    "secret:gcp:api_key": 20, "secret:gcp:client_secret": 20, "secret:azure:account_key": 20,
    "secret:azure:connection_string": 20, "secret:azure:secret_value": 20,
    "secret:azure:sas_token": 20, "secret:slack:bot_token": 20, "secret:slack:user_token": 20,
    "secret:slack:webhook": 20, "secret:twilio:auth_token": 20, "secret:twilio:api_key": 20,
    "secret:sendgrid:api_key": 20, "secret:mailgun:api_key": 20,
    "secret:auth:basic_header": 20, "secret:auth:bearer_header": 20,
    "secret:stripe:test_secret_key": 15, "secret:auth:jwt": 15,
}
CRYPTO_PREFIX, CRYPTO_WEIGHT = "secret:crypto:", 25
SSRF_WEIGHTS = {
    "ssrf:metadata:aws": 45, "ssrf:metadata:gcp": 45, "ssrf:metadata:azure": 45,
    "ssrf:metadata:alibaba": 45, "ssrf:scheme:gopher": 45,
    "ssrf:scheme:file": 25, "ssrf:scheme:dict": 25, "ssrf:encoding:octal_ipv4": 25,
    "ssrf:encoding:hex_ipv4": 25, "ssrf:encoding:decimal_host": 25,
    "ssrf:private_network:10": 20, "ssrf:private_network:172": 20,
    "ssrf:private_network:192": 20, "ssrf:private_network:localhost": 20,
}
TAMPERING_WEIGHTS = {
    "cognitive_tampering:role_override": 45, "cognitive_tampering:delimiter_framing": 45,
    "cognitive_tampering:instruction_injection": 35,
    "cognitive_tampering:unicode_steganography": 35, "cognitive_tampering:base64_encoded": 25,
}
TAMPERING_FILE_WEIGHTS = {
    "cognitive_tampering:file_write": 35, "cognitive_tampering:file_target": 25,
}
ENGINE_WEIGHTS = {
    "json_config:credential_connection_string": 20, "json_config:credential_value": 15,
    "json_config:metadata_url": 25, "json_config:internal_url": 15, "json_config:c2_url": 35,
    "source:dynamic_import": 20, "source:nonliteral_require": 20,
    "source:nonliteral_spawn": 30, "source:ssrf_private_ip": 25,
    "source:ssrf_internal_host": 20, "source:sensitive_path_access": 25,
    "mcp_server_declared": 20, "extensions_directory_present": 5,
    "dangerous_keyword:rm": 25, "dangerous_keyword:disable": 25, "dangerous_keyword:upload": 20,
}
# Signals ending in a count: (prefix, factor, maximum).
COUNT_WEIGHTS = [("extension_count:", 1, 10), ("mcp_server_count:", 5, 20)]

# Later tables give way to earlier ones, so they are merged in reverse.
RISK_WEIGHTS = {
    **ENGINE_WEIGHTS, **SHARED_WEIGHTS, **TAMPERING_FILE_WEIGHTS, **TAMPERING_WEIGHTS,
    **SSRF_WEIGHTS, **SECRET_WEIGHTS, **CAPABILITY_WEIGHTS,
}
LOCAL_WEIGHTS = {**SHARED_WEIGHTS, **SECRET_WEIGHTS, **SSRF_WEIGHTS, **TAMPERING_WEIGHTS}
