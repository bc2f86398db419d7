"""Values the results depend on: signatures, word lists, weights, thresholds.

Everything in this module is a fixed value. The operators and the SQL
counterparts both read it from here, so a change shows up on both sides.
"""

from __future__ import annotations

import string
from typing import NamedTuple


class Signature(NamedTuple):
    """One credential pattern.

    ``regex`` is the pattern in portable syntax. ``anchors`` and ``min_length``
    are necessary conditions only: a string without any of the anchors, or
    shorter than ``min_length``, cannot match. They spare the regex engine and
    never change the result. ``scan_regex`` is an equivalent form that the JVM
    engine runs in linear time, where the plain one would not. ``short_run``
    marks values that need no run of LONG_RUN characters of RUN_CLASS; ``hint``
    is a cheap necessary pattern for one of those without a single rare literal.
    """

    provider: str
    regex: str
    tier: str
    anchors: tuple[str, ...] = ()
    min_length: int = 0
    scan_regex: str | None = None
    short_run: bool = False
    hint: str | None = None


# Provider, pattern and confidence tier, in priority order.
SIGNATURES: tuple[Signature, ...] = (
    Signature(
        "AWS Access Key",
        r"(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}",
        "CRITICAL",
        anchors=("A3T", "AKIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA"),
        min_length=20,
        short_run=True,
        hint=r"A[3KGIRNS][A-Z0-9]{18}",
    ),
    Signature("Google API Key", r"AIza[0-9A-Za-z\-_]{35}", "CRITICAL", ("AIza",), 39),
    Signature(
        "GitHub Token",
        r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36}",
        "CRITICAL",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        40,
    ),
    Signature("GitLab Personal Access Token", r"glpat-[0-9a-zA-Z\-_]{20}", "CRITICAL", ("glpat-",), 26, short_run=True),
    Signature("Stripe Live Key", r"sk_live_[0-9a-zA-Z]{24}", "CRITICAL", ("sk_live_",), 32),
    Signature("OpenAI API Key", r"sk-[a-zA-Z0-9]{48}", "CRITICAL", ("sk-",), 51),
    Signature("OpenAI Project Key", r"sk-proj-[a-zA-Z0-9\-_]{20,}", "CRITICAL", ("sk-proj-",), 28, short_run=True),
    Signature("Slack Token", r"xox[baprs]-([0-9a-zA-Z]{10,48})?", "HIGH", ("xox",), 16, short_run=True),
    Signature("Twilio Account SID", r"AC[a-f0-9]{32}", "HIGH", ("AC",), 34),
    Signature("Mailgun API Key", r"key-[0-9a-zA-Z]{32}", "HIGH", ("key-",), 36),
    Signature("PyPI Upload Token", r"pypi-AgEI[a-zA-Z0-9\-_]{50,}", "CRITICAL", ("pypi-AgEI",), 59),
    Signature(
        "Discord Bot Token",
        r"[A-Za-z0-9]{24,}\.[A-Za-z0-9]{6}\.[A-Za-z0-9_-]{27,}",
        "HIGH",
        (".",),
        59,
        r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+\.[A-Za-z0-9]{6}\.[A-Za-z0-9_-]{27,}",
        short_run=True,
        hint=r"\.[A-Za-z0-9]{6}\.[A-Za-z0-9_-]{27}",
    ),
    Signature("Telegram Bot Token", r"[0-9]{8,10}:[a-zA-Z0-9_-]{35}", "HIGH", (":",), 44),
    Signature(
        "UUID-like Secret",
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        "LOW",
        ("-",),
        36,
    ),
    Signature("Generic 32-char Candidate", r"\b[a-zA-Z0-9]{32}\b", "MEDIUM", (), 32),
    Signature("Generic 40-char Hex Candidate", r"\b[a-fA-F0-9]{40}\b", "MEDIUM", (), 40),
    Signature("Generic 64-char Hex Candidate", r"\b[a-fA-F0-9]{64}\b", "MEDIUM", (), 64),
)

# Every pattern above only consumes characters of TOKEN_CLASS, and every match
# that survives the length rule holds a run of MIN_VALUE_LENGTH characters of
# RUN_CLASS. Recovery uses both facts to look at long runs only.
# Listed one by one, the JVM engine tests a class with a single bit lookup.
RUN_CLASS = "[" + string.ascii_letters + string.digits + r"_\-]"
TOKEN_CLASS = "[" + string.ascii_letters + string.digits + r"_.:\-]"
LONG_RUN = 32

# Noise rule.
MIN_VALUE_LENGTH = 16
# Anything that any signature matches, to hide it in text that is shown.
ANY_VALUE = "|".join(f"(?:{s.regex})" for s in SIGNATURES).replace(r"\b[", "(?<![A-Za-z0-9_])[").replace(
    r"\b)", "(?![A-Za-z0-9_]))"
)
HIDDEN = "********"
VALUE_RUN = "%s{%d}" % (RUN_CLASS, MIN_VALUE_LENGTH)
RUN_AT_AN_END = "^{0}{{{1},}}|{0}{{{1},}}$".format(RUN_CLASS, MIN_VALUE_LENGTH)
WINDOW_SENTENCE = "Context: "
TRUSTED_TIERS = ("CRITICAL", "HIGH")
MIN_ENTROPY = 2.5

# Widths of the text windows around a candidate.
CONTEXT_WINDOW = 120
ASSET_WINDOW = 360

# File kinds.
CONFIG_NAMES = (".env", "docker-compose.yml", "docker-compose.yaml")
CONFIG_SUFFIXES = (".env", ".ini", ".cfg", ".conf", ".properties", ".json", ".toml", ".yaml", ".yml")
JAVASCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx")
JVM_SUFFIXES = (".java", ".kt", ".kts")
OTHER_CODE_SUFFIXES = (".go", ".rs", ".rb", ".php", ".cs", ".cpp", ".c", ".h")
DOCUMENT_SUFFIXES = (".md", ".rst", ".txt")
LINE_TOKEN_LANGUAGES = ("javascript", "jvm", "tree_sitter_candidate")

# Grammar name by suffix.
GRAMMARS = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".cs": "c_sharp", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".c": "c", ".h": "c",
}

# Substrings that mark a documentation or test path.
DOC_OR_TEST_PATH_MARKERS = (
    "api_keys", "api_keys.md", "test_", "tests/", "/test/", "/tests/", "__tests__", "/spec/",
    "/docs/", "/doc/", "/examples/", "/example/", "readme", "usage.md", "fixture", "sample", "mock",
)
# Substrings of a file name that mark a template.
TEMPLATE_NAME_MARKERS = ("api_keys.md", "example", "sample", "template")

# Word lists of the feature layer (substring tests, lower case).
SENSITIVE_NAME_TERMS = (
    "key", "token", "secret", "password", "passwd", "credential", "auth", "apikey", "api_key",
    "client_secret", "access", "private",
)
AUTH_CALL_TERMS = ("auth", "login", "connect", "client", "session", "credential", "api", "token")
SECRET_TERMS = (
    "password", "passwd", "token", "secret", "credential", "api_key", "apikey", "access_key",
    "private_key", "client_secret", "auth",
)
HASH_OR_ID_TERMS = (
    "checksum", "hash", "md5", "sha1", "sha256", "uuid", "guid", "image", "png", "svg", "color",
    "background", "selector", "class",
)
PLACEHOLDER_TERMS = (
    "example", "sample", "dummy", "test", "testing", "changeme", "change_me", "your_key",
    "your-token", "replace", "placeholder", "only_add", "leave_others_empty", "leave_empty",
    "delete", "abcdefghijklmnopqrstuvwxyz", "1234567890", "foo", "bar", "fake", "mock",
)
TEMPLATE_TERMS = (
    "only add", "leave others empty", "leave empty", "delete", "replace", "example", "sample",
    "template", "your ",
)
SECRET_LIST_TERMS = (
    "access key id", "secret access key", "api-key:", "apikey:", "secret_key:", "api:", "github:",
    "amazon:",
)

# Asset patterns in portable syntax, in the order they are read.
DATABASE_REGEX = r"\b(?:postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc)://[^\s'\"<>]+"
URL_REGEX = r"https?://[^\s'\"<>]+"
HOST_REGEX = r"\b(?:[a-zA-Z0-9-]+\.)+(?:com|net|org|io|dev|cloud|local|internal)\b"
ASSET_TRAILING = ".,);]"

# Rule baseline, added and subtracted in this order.
BASELINE_MODEL = "heuristic-baseline-v1"
TIER_BASE_SCORES = (("CRITICAL", 0.66), ("HIGH", 0.55), ("MEDIUM", 0.36), ("LOW", 0.22))
TIER_BASE_DEFAULT = 0.25
HIGH_ENTROPY = 4.0
BASELINE_ADDS = (
    (0.10, "variable_is_sensitive", "sensitive variable name"),
    (0.10, "call_is_auth_related", "auth/client call context"),
    (0.08, "is_assignment_context", "assignment/config binding"),
    (0.08, "has_secret_term_nearby", "nearby secret terminology"),
    (0.04, "entropy", "high entropy"),
    (0.08, "has_downstream_usage", "data-flow usage"),
    (0.08, "has_asset_reference", "secret-asset association"),
)
BASELINE_SUBTRACTS = (
    (0.30, "has_placeholder_signal", "placeholder/example context"),
    (0.24, "has_template_language", "template instructions"),
    (0.18, "is_documentation_or_test_path", "documentation/test path"),
    (0.18, "is_weak_documentation_context", "weak documentation context"),
    (0.20, "has_hash_or_identifier_term", "hash/id context"),
    (0.10, "is_uuid_like", "uuid-like structure"),
)
GENERIC_HEX_PENALTY = (0.10, "generic hexadecimal candidate")
DOC_TEMPLATE_PENALTY = (0.28, "documentation template without usage or asset evidence")
MAX_CONFIDENCE = 0.99
APPROVE_THRESHOLD = 0.62
VALIDATION_THRESHOLD = 0.82

# Risk score.
RISK_PROVIDER_PREFIXES = ("AWS", "Google", "GitHub", "GitLab", "Stripe", "OpenAI", "Slack", "PyPI")
RISK_PROVIDER_WEIGHT = 0.10
RISK_ADDS = (
    (0.08, "call_is_auth_related"),
    (0.06, "variable_is_sensitive"),
    (0.08, "has_downstream_usage"),
    (0.08, "has_asset_reference"),
    (0.04, "has_database_asset"),
)
RISK_DOC_PENALTY = 0.10
RISK_BANDS = (("CRITICAL", 0.85), ("HIGH", 0.72), ("MEDIUM", 0.55))

# Model inputs in order, and the values derived for them.
FEATURE_ORDER = (
    "length", "entropy", "digit_ratio", "alpha_ratio", "symbol_ratio", "is_hex", "is_uuid_like",
    "signature_confidence_score", "provider_is_generic", "provider_is_critical_type",
    "has_ast_context", "has_variable_name", "variable_is_sensitive", "call_is_auth_related",
    "is_assignment_context", "has_downstream_usage", "downstream_call_count",
    "has_secret_term_nearby", "secret_term_proximity_score", "has_asset_reference",
    "asset_reference_count", "has_database_asset", "has_url_asset", "has_host_asset",
    "has_hash_or_identifier_term", "has_placeholder_signal", "has_template_language",
    "is_template_file", "is_documentation_or_test_path", "is_weak_documentation_context",
    "language_is_python", "language_is_config", "language_is_documentation",
    "parse_error_present",
)
TIER_SCORES = (("CRITICAL", 1.0), ("HIGH", 0.75), ("MEDIUM", 0.5), ("LOW", 0.25))
CRITICAL_PROVIDER_TERMS = ("aws", "google", "github", "gitlab", "stripe", "openai", "slack", "pypi")
PROXIMITY_SPAN = 120.0
NUMERIC_TRUE = ("true", "yes", "y", "1", "real_secret")
NUMERIC_FALSE = ("false", "no", "n", "0", "false_positive")

# Approval thresholds of the supervised gate.
UUID_PROVIDER = "UUID-like Secret"
OPERATIONAL_UUID_TERMS = ("connector_id", "job_id", "policy_id", "screenshot", ".png")
NAMED_DUMP_PATHS = ("reconx/keys.md",)
GENERIC_REJECT_THRESHOLD = 0.995
GENERIC_BOUND_THRESHOLD = 0.90
GENERIC_ASSET_THRESHOLD = 0.94
SUPERVISED_MODEL = "spark-logistic-regression-v1"

# Check routes.
PASSIVE_TYPES = (
    "aws access key", "github token", "gitlab personal access token", "stripe live key",
    "openai api key", "openai project key", "slack token", "twilio account sid",
    "mailgun api key", "pypi upload token", "discord bot token", "telegram bot token",
)
PROVIDER_ROUTES = ("shodan", "google", "scrapingbee")
PASSIVE_DETAILS = (
    "Skipped active validation for ",
    "; manual review recommended to avoid unsafe third-party credential testing.",
)
GENERIC_LONG_DETAILS = "No provider-specific validator available; format-only review only."
GENERIC_SHORT_DETAILS = "Candidate too short for provider-agnostic review."

# Label bootstrap.
PROVIDER_SPECIFIC_TYPES = tuple(s.provider for s in SIGNATURES if s.tier in ("CRITICAL", "HIGH"))
GENERIC_TYPES = tuple(s.provider for s in SIGNATURES if s.tier not in ("CRITICAL", "HIGH"))
CODE_PATH_HINTS = (".env", ".py", ".sh", ".yml", ".yaml", ".go", ".php", ".c", ".conf", "docker-compose")
CODE_LANGUAGES = ("python", "config", "yaml", "shell", "tree_sitter_candidate")
DOC_PATH_HINTS = (".md", "readme", "usage", "api_keys", "keys.md", "docs/")
EXPLICIT_PLACEHOLDER_TERMS = (
    "fake_key", "false_key", "example", "example.com", "only add the keys", "leave others empty",
    "delete", "xxxx", "xxx@xxx.com", "edit this", "you can change this", "changeme", "test key",
)
REALISTIC_TERMS = (
    "api_key", "apikey", "secret_key", "access key", "token=", "token:", "password", "shodan_key",
    "shodan_api_key", "github token", "github:", "opencti_token", "cloudflare:   key", "wpscan:",
    "securitytrails:", "virustotal:", "alienvault:", "censys_api_secret", "censys_api_id",
    "connect", "environment:",
)
HASH_NOISE_TERMS = (
    "md5", "sha1", "sha256", "hash", "gist.githubusercontent.com", ".png", "go.mod h1:", "license",
    "file hash lookup", "identify un hash",
)
OPERATIONAL_ID_TERMS = ("connector_id", "job_id", "policy_id", "trace_id", "image(", ".png", "screenshot")
SENSITIVE_NAME_REGEX = (
    r"(api[_-]?key|secret[_-]?key|access[_-]?key|token|password|client[_-]?secret"
    r"|shodan|censys|opencti|openrouter|gemini|google)"
)
SENSITIVE_BINDING_REGEX = (
    r"([A-Za-z0-9_.-]*" + SENSITIVE_NAME_REGEX + r"[A-Za-z0-9_.-]*)"
    r"\s*[:=]\s*[\"']?[A-Za-z0-9_./:+-]{8,}"
)
FLAG_TRUE = ("1", "1.0", "true", "yes", "y")
ONE_HOT_TRUE = ("1", "1.0", "true", "yes", "y", "real_secret")
TARGET_POSITIVES = 25
REVIEW_QUEUE_LIMIT = 80

# Label spellings for training and evaluation.
POSITIVE_LABELS = ("1", "true", "yes", "y", "real", "real_secret", "secret")
NEGATIVE_LABELS = ("0", "false", "no", "n", "false_positive", "negative", "fp")
IGNORED_LABELS = ("", "nan", "review")
TEST_FRACTION = 0.25
SPLIT_SEED = 42

# Search paging.
HITS_PER_PAGE = 100

# Report suffixes.
REPORT_SUFFIXES = {
    "raw_hits": "1_SCAN_RAW",
    "findings": "2_HYBRID_FINDINGS",
    "confirmed": "3_VALID_KEYS_CONFIRMED",
}

# Search pattern lists.
SEARCH_PATTERNS = {
    "shodan": """
        SHODAN_API_KEY SHODAN_KEY SHODAN_ACCESS_KEY SHODAN_ACCESS_TOKEN SHODAN_TOKEN
        SHODAN_SECRET_KEY SHODAN_CLIENT_KEY SHODAN_CLIENT_SECRET SHODAN_PRIVATE_KEY
        SHODAN_PUBLIC_KEY SHODAN_API_TOKEN SHODAN_MASTER_KEY SHODAN_MASTER_API_KEY
        SHODAN_SERVICE_KEY SHODAN_SERVICE_TOKEN SHODAN_SECURITY_KEY SHODAN_GATEWAY_KEY
        SHODAN_GATEWAY_TOKEN SHODAN_DATA_API_KEY SHODAN_PLATFORM_API_KEY SHODAN_PLATFORM_TOKEN
        SHODAN_AUTH_KEY SHODAN_AUTH_TOKEN SHODAN_AUTH_SECRET SHODAN_INTEGRATION_KEY
        SHODAN_INTEGRATION_TOKEN SHODAN_BACKEND_API_KEY SHODAN_SERVER_API_KEY
        SHODAN_CORE_API_KEY SHODAN_ENGINE_KEY SHODAN_ENGINE_SECRET SHODAN_LOOKUP_API_KEY
        SHODAN_SEARCH_API_KEY SHODAN_QUERY_API_KEY SHODAN_QUERY_TOKEN SHODAN_MONITOR_API_KEY
        SHODAN_MONITOR_TOKEN SHODAN_SCAN_API_KEY SHODAN_SCAN_SECRET SHODAN_NETWORK_API_KEY
        SHODAN_NETWORK_TOKEN SHODAN_IOT_API_KEY SHODAN_IOT_SECRET SHODAN_INTEL_API_KEY
        SHODAN_INTEL_TOKEN SHODAN_SDK_API_KEY SHODAN_SDK_TOKEN SHODAN_SERVICE_SECRET
    """.split(),
    "openai": """
        OPENAI_API_KEY CHATGPT_API_KEY CHATGPT_KEY OPENAI_KEY OPENAI_API_TOKEN CHATGPT_API_TOKEN
        OPENAI_SECRET OPENAI_SECRET_KEY OPENAI_PRIVATE_KEY AI_API_KEY LLM_API_KEY GENAI_API_KEY
        OPENAI_API_KEY_DEV OPENAI_API_KEY_STAGING OPENAI_API_KEY_PROD OPENAI_API_KEY_TEST
        CHATGPT_API_KEY_DEV CHATGPT_API_KEY_PROD
    """.split(),
    "scrapingbee": """
        SCRAPINGBEE_API_KEY SCRAPINGBEE_KEY SCRAPINGBEE_TOKEN SCRAPINGBEE_API_TOKEN
        SCRAPINGBEE_SCRAPER_API_KEY SCRAPING_SERVICE_SCRAPINGBEE_KEY SCRAPER_API_KEY_SCRAPINGBEE
        SCRAPING_API_KEY_SCRAPINGBEE SCRAPINGBEE_SERVICE_KEY SCRAPINGBEE_SERVICE_TOKEN
        EXTERNAL_SCRAPINGBEE_API_KEY INTEGRATION_SCRAPINGBEE_API_KEY SCRAPINGBEE_API_KEY_DEV
        SCRAPINGBEE_API_KEY_STAGING SCRAPINGBEE_API_KEY_PROD SCRAPINGBEE_API_KEY_TEST
        SCRAPINGBEE_SECRET SCRAPINGBEE_SECRET_KEY SCRAPINGBEE_PRIVATE_KEY
    """.split(),
}
