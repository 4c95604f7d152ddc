"""Fixed values.

Everything in this module is a constant whose exact value decides whether our
results agree with the behaviour we re-implement: type names, patterns, labels,
placeholder text, rule lists, ladders and message formats. They are stated here
plainly, in their natural order, and nowhere else. Logic lives in the operator
modules; this file holds data only.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — detection
# ---------------------------------------------------------------------------

# PII / credential types in report order, with the secret flag, the redaction
# placeholder and the singular / plural wording used in summaries.
PII_TYPES = [
    # type,          secret, placeholder,      singular,        plural
    ("email",        False, "«email»",       "email",         "emails"),
    ("ssn",          False, "«ssn»",         "SSN",           "SSNs"),
    ("private-key",  True,  "«private-key»", "private key",   "private keys"),
    ("aws-key",      True,  "«aws-key»",     "AWS key",       "AWS keys"),
    ("gh-token",     True,  "«token»",       "GitHub token",  "GitHub tokens"),
    ("jwt",          True,  "«jwt»",         "JWT",           "JWTs"),
    ("api-key",      True,  "«api-key»",     "API key",       "API keys"),
    ("credit-card",  False, "«card»",        "card number",   "card numbers"),
    ("ip",           False, "«ip»",          "IP address",    "IP addresses"),
    ("iban",         False, "«iban»",        "IBAN",          "IBANs"),
    ("mac",          False, "«mac»",         "MAC address",   "MAC addresses"),
    ("phone",        False, "«phone»",       "phone number",  "phone numbers"),
]

# Detection patterns in evaluation order (JavaScript / RE2 notation: `\b` is an
# ASCII word boundary, `\s` is the JavaScript whitespace set). Validators:
# "luhn" (mod 10 over 13-19 digits) and "mod97" (ISO 13616, length 15-34).
PATTERNS = [
    # type,         regex,                                                                       validator
    ("email",       r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",                         None),
    ("ssn",         r"\b\d{3}-\d{2}-\d{4}\b",                                                      None),
    ("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----[\s\S]*?"
                    r"-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",                  None),
    ("aws-key",     r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b",                                               None),
    ("gh-token",    r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b",                                          None),
    ("jwt",         r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",             None),
    ("api-key",     r"\bsk-[A-Za-z0-9_-]{16,}\b",                                                  None),
    ("api-key",     r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",                                           None),
    ("api-key",     r"\bAIza[0-9A-Za-z_-]{35}\b",                                                  None),
    ("api-key",     r"\b[sr]k_live_[0-9A-Za-z]{20,}\b",                                            None),
    ("credit-card", r"\b(?:\d[ -]?){13,19}\b",                                                     "luhn"),
    ("ip",          r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",      None),
    ("iban",        r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",                                           "mod97"),
    ("mac",         r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",                                None),
    ("phone",       r"(?:\+\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b",                   None),
]

# Cheap literal pre-checks per pattern (our own addition, not a semantic): a row
# that lacks the literal cannot match, so the regex is skipped for it.
PATTERN_GUARDS = [["@"], ["-"], ["-----BEGIN"], ["AKIA", "ASIA"], ["gh"], ["eyJ"], ["sk-"], ["xox"],
                  ["AIza"], ["k_live_"], None, ["."], None, [":", "-"], None]

# What any match of a pattern starts with (our own addition, not a semantic): tried ahead of the
# look-behinds that a boundary costs at every character.
PATTERN_STARTS = [r"[A-Za-z0-9._%+-]", r"\d", None, r"A[KS]IA", r"gh[pousr]_", r"eyJ", r"sk-", r"xox", r"AIza", r"[sr]k_", r"\d", r"\d",
                  r"[A-Z]{2}\d", r"[0-9A-Fa-f]{2}[:-]", r"[+(\d]"]

# The part of a text that a pattern needs (our own addition, not a semantic), see `detect.excerpt`.
PATTERN_EXCERPTS = ["at", "digits", None, None, None, None, None, None, None, None, "digits", "digits", "digits", "digits", "digits"]

# What a text holds wherever a pattern of the `digits` excerpt matches, whatever stands beside it (our own
# addition, not a semantic).
PATTERN_CORES = {1: r"\d{3}-\d{2}-\d{4}", 10: r"(?:\d[ -]?){12}\d", 11: r"\d\.\d{1,3}\.\d{1,3}\.\d", 12: r"[A-Z]{2}\d{2}[A-Z0-9]{11}",
                 13: r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}", 14: r"\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"}

# Fixed masked label for a private-key block, the sample cap default.
PRIVATE_KEY_MASK = "-----BEGIN PRIVATE KEY----- block"
DEFAULT_SAMPLE_CAP = 4

# Detail / inline report wording.
DETAIL_BULLET = "  • "
DETAIL_NOT_SHOWN = " (masked — not shown)"
DETAIL_ALLOWLISTED = "  • allowlisted (not counted): "
DETAIL_CAVEAT = "  Values are masked here; the full values are in what would be sent."

# ---------------------------------------------------------------------------
# FIXED VALUES — allowlist
# ---------------------------------------------------------------------------

DEFAULT_ALLOW = [
    "@example.com",
    "@example.org",
    "@example.net",
    "@example",
    "@test",
    "@invalid",
    "@localhost",
    "@local",
    "@users.noreply.github.com",
    "noreply@*",
    "no-reply@*",
    "donotreply@*",
    "do-not-reply@*",
    "127.0.0.0/8",
    "0.0.0.0",
    "255.255.255.255",
    "169.254.0.0/16",
]

# Characters a glob entry escapes before `*` becomes `.*`.
GLOB_SPECIALS = ".*+?^${}()|[]\\"

# ---------------------------------------------------------------------------
# FIXED VALUES — tool egress
# ---------------------------------------------------------------------------

LOCAL_TOOLS = ["read", "grep", "find", "ls", "edit", "write"]

EGRESS_CMD = (r"(?i)(?:^|[\s|&;(`$])(?:curl|wget|nc|ncat|netcat|scp|sftp|rsync|telnet|ftp|xh|httpie"
              r"|kubectl|aws|gcloud|az)\b|>\s*/dev/tcp/|\bgit\s+push\b|\bssh\s")

URL_RE = r"(?i)\bhttps?://[^\s\"'`)<>]+"

SEGMENT_SPLIT = r"\|\||&&|[;\n|]"

# Shell-token edges and optional leading directory for sensitive-file references.
TOK_START = r"(?:^|[\s\"'`=@<(|])"
TOK_END = r"(?:\z|[\s\"'`)>;,|&])"
FILE_DIR = r"(?:[\w.~/-]*/)?"

SENSITIVE_FILES = [
    (".env file",               TOK_START + FILE_DIR + r"\.env(?:\.[\w-]+)?" + TOK_END),
    ("SSH key material",        TOK_START + FILE_DIR + r"\.ssh(?:/[\w.-]+)?" + TOK_END),
    ("SSH private key",         TOK_START + FILE_DIR + r"id_(?:rsa|dsa|ecdsa|ed25519)" + TOK_END),
    ("AWS credentials",         FILE_DIR + r"\.aws/(?:credentials|config)" + TOK_END),
    ("kubeconfig",              FILE_DIR + r"\.kube/config" + TOK_END),
    ("stored credentials",      TOK_START + FILE_DIR + r"\.(?:npmrc|netrc|pypirc|git-credentials|docker/config\.json)" + TOK_END),
    ("key or certificate file", TOK_START + FILE_DIR + r"[\w.-]+\.(?:pem|key|p12|pfx|jks|keystore|kdbx)" + TOK_END),
    ("secrets file",            TOK_START + FILE_DIR + r"(?:secrets?|credentials?)\.(?:json|ya?ml|env|txt|toml|csv)" + TOK_END),
]

# Ledger wording.
UNNAMED_HOST = "(unnamed host)"
USER_COMMAND_ACTOR = "! command"

# ---------------------------------------------------------------------------
# FIXED VALUES — providers and the privacy ladder
# ---------------------------------------------------------------------------

# The server-proxied TEE provider (tee-verified only with a host-verified
# signal, else zdr-policy) is keyed `proxied-tee` here.
PROVIDERS = [
    # id,          label,                                  tier,           posture_aware, attestable, local, base_url
    ("proxied-tee", "Proxied TEE (developer key)",         "tee-verified", True,  False, False, None),
    ("tinfoil",    "Tinfoil (private TEE inference)",      "tee-verified", False, True,  False, "https://inference.tinfoil.sh/v1"),
    ("nearai",     "NEAR AI (private TEE inference)",      "tee-verified", False, True,  False, "https://cloud-api.near.ai/v1"),
    ("venice",     "Venice (no-retention inference)",      "zdr-policy",   False, False, False, "https://api.venice.ai/api/v1"),
    ("fireworks",  "Fireworks (no-retention inference)",   "zdr-policy",   False, False, False, "https://api.fireworks.ai/inference/v1"),
    ("openrouter", "OpenRouter",                           "zdr-enforced", True,  False, False, "https://openrouter.ai/api/v1"),
    ("ollama",     "Ollama (local)",                       "local",        False, False, True,  "http://localhost:11434/v1"),
    ("custom",     "Custom (OpenAI-compatible)",           "standard",     False, False, False, None),
]

TIERS = [
    # tier,            label,               verifiability,   posture,   rank, exposure
    ("tee-verified",   "Verified TEE",      "cryptographic", "green",   0,    0),
    ("tee-unverified", "TEE (unconfirmed)", "none",          "yellow",  3,    2),
    ("local",          "On-device",         "observable",    "green",   1,    0),
    ("zdr-enforced",   "ZDR (enforced)",    "observable",    "green",   2,    1),
    ("zdr-policy",     "ZDR (by policy)",   "policy",        "yellow",  4,    2),
    ("standard",       "Standard",          "none",          "neutral", 5,    3),
]

# Badge glyph per traffic-light posture, and the pending marker.
POSTURE_GLYPH = [("green", "🛡"), ("yellow", "⚠"), ("red", "⛔"), ("neutral", "•")]
PENDING_BADGE = "⋯ checking privacy"

# Picker capability badge per tier (tee-verified depends on attestable).
CAPABILITY_BADGE = [
    # tier,            attestable, glyph, label
    ("tee-verified",   True,  "◆",  "Verifiable TEE"),
    ("tee-verified",   False, "🛡", "Verified TEE"),
    ("local",          None,  "🛡", "On-device"),
    ("zdr-enforced",   None,  "🛡", "ZDR (enforced)"),
    ("tee-unverified", None,  "⚠",  "TEE (unconfirmed)"),
    ("zdr-policy",     None,  "⚠",  "ZDR (by policy)"),
    ("standard",       None,  "•",  "Standard"),
]

# Attestation evidence markers.
REPORT_ADDRESS_KEYS = ["signing_address", "signingAddress", "address"]
MIN_NONCE_LEN = 16
SEV_REPORT_MIN_BYTES = 0x90
SEV_KEY_OFFSET = 0x50
SEV_KEY_END = 0x70

# ---------------------------------------------------------------------------
# FIXED VALUES — tool surface
# ---------------------------------------------------------------------------

BUILTIN_TOOLS = ["bash", "read", "write", "edit", "grep", "find", "ls"]
SHELL_TOOLS = ["bash"]
URL_PARAM = r"(?i)^(?:url|uri|endpoint|host|hostname|origin|webhook|server|base_?url|address)$"
URL_IN_TEXT = r"(?i)\bhttps?://"
SCHEMA_CONTAINERS = ["items", "additionalProperties", "oneOf", "anyOf", "allOf", "$defs"]
SCHEMA_MAX_DEPTH = 6

PROVENANCE = [
    # provenance, label,          attention order
    ("project",   "project",      0),
    ("temporary", "temporary",    1),
    ("unknown",   "unattributed", 2),
    ("package",   "package",      3),
    ("user",      "user",         4),
    ("builtin",   "builtin",      5),
]
REACH_LABEL = [
    ("local",   "local files only"),
    ("shell",   "shell (unbounded)"),
    ("network", "network (declared)"),
    ("unknown", "unassessed"),
]
CONCERN = [
    ("project",   "supplied by this project{where}, not by you — it arrived with the repository"),
    ("temporary", "supplied by a CLI override for this run{where}, not by your configuration"),
    ("unknown",   "no source metadata — there is no record of where this came from"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — configuration
# ---------------------------------------------------------------------------

CONFIG_ENUMS = [
    # key,                 allowed values in protectiveness order (weakest first), default
    ("piiPolicy",          ["off", "warn", "redact"], "warn"),
    ("toolExfilPolicy",    ["off", "warn", "block"],  "warn"),
    ("toolResultPolicy",   ["off", "warn", "redact"], "warn"),
    ("downgradePolicy",    ["off", "warn", "block"],  "warn"),
    ("toolSurfacePolicy",  ["off", "report", "warn"], "warn"),
]
# The allowed values in the order in which messages list them.
CONFIG_ENUM_SHOWN = {
    "piiPolicy": "warn|redact|off", "toolExfilPolicy": "warn|block|off", "toolResultPolicy": "warn|redact|off",
    "downgradePolicy": "warn|block|off", "toolSurfacePolicy": "warn|report|off",
}
CONFIG_BOOLS = ["enforceOpenRouterZdr", "showBadge", "installDispatcher", "registerProviders",
                "useDispatcherTransport", "modelPicker", "piiAllowDefaults"]
PROTECTIVE_WHEN_TRUE = ["showBadge", "installDispatcher", "useDispatcherTransport",
                        "registerProviders", "modelPicker"]
CONFIG_STRINGS = ["badgeKey", "modelPickerCommand", "toolSurfaceCommand"]
BADGE_SINKS = ["status", "widget", "title", "notify"]
PROJECT_MAY_NOT_SET = [
    ("piiAllow",           "an allowlist entry can hide PII from the gate entirely"),
    ("badgeSinks",         "a sink list can hide the posture badge"),
    ("toolSurfaceCommand", "renaming the command can hide the tool-surface listing"),
    ("modelPickerCommand", "renaming the command can hide the privacy-ranked model picker"),
]
CODE_ONLY_OPTIONS = ["onPosture", "resolveTier", "renderBadge", "proxiedTeeVerified",
                     "piiUnattended", "renderPiiAutoRedact"]

# ---------------------------------------------------------------------------
# FIXED VALUES — gate wording
# ---------------------------------------------------------------------------

EGRESS_WARNING = ("⚠ {label} is about to send {what} off this machine{dest}. "
                  "A private (TEE/ZDR) model does NOT protect a tool call. Best-effort detection, not a guarantee.")
EGRESS_REASON = "blocked {kind} exfiltration via {label}"
USER_COMMAND_LABEL = "this ! command"
LEDGER_PII_NOTE = "{n} carried PII/credentials"
LEDGER_BLOCKED_NOTE = "{n} blocked"

# Serializable option defaults (key, default as text).
CONFIG_DEFAULTS = [
    ("piiPolicy", "warn"), ("toolExfilPolicy", "warn"), ("toolResultPolicy", "warn"), ("downgradePolicy", "warn"),
    ("toolSurfacePolicy", "warn"), ("enforceOpenRouterZdr", "false"), ("showBadge", "true"),
    ("installDispatcher", "true"), ("registerProviders", "true"), ("useDispatcherTransport", "true"),
    ("modelPicker", "true"), ("piiAllowDefaults", "true"), ("piiAllow", ""), ("badgeSinks", "status,widget,title"),
    ("badgeKey", "privacy-badge"), ("modelPickerCommand", "models"), ("toolSurfaceCommand", "surface"),
]
BOOL_TRUE = ["1", "true", "yes", "on"]
BOOL_FALSE = ["0", "false", "no", "off"]
