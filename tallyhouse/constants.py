"""Labels, aliases, thresholds and patterns that define the results."""

# Source labels.
CLAUDE_CODE = "Claude Code"
CODEX_CLI = "Codex CLI"
GEMINI_CLI = "Gemini CLI"
HERMES_AGENT = "Hermes Agent"
OPENCODE = "OpenCode"
OPENCLAW = "OpenClaw"
DEEPSEEK_HARNESS = "DeepSeek Harness"
CC_SWITCH = "CC-Switch"

# Proxy application type -> source label; anything else passes through.
APP_TYPE_SOURCES = {
    "claude": CLAUDE_CODE,
    "claude-desktop": CLAUDE_CODE,
    "claude_desktop": CLAUDE_CODE,
    "claude desktop": CLAUDE_CODE,
    "codex": CODEX_CLI,
    "opencode": OPENCODE,
}

# Sources whose local history outranks proxy day rollups.
LOCAL_FIRST_SOURCES = [CLAUDE_CODE, CODEX_CLI, OPENCODE]

# Reasoning tiers that may follow a model name in parentheses.
REASONING_TIERS = ["minimal", "low", "medium", "high", "xhigh", "auto", "none"]

# Provider aliases after lower-casing and "-" -> "_".
PROVIDER_ALIASES = {
    "x_ai": "xai",
    "xai": "xai",
    "z_ai": "zai",
    "zai": "zai",
    "moonshot": "moonshotai",
    "moonshotai": "moonshotai",
    "meta": "meta_llama",
    "meta_llama": "meta_llama",
    "azure": "azure_ai",
    "azure_ai": "azure_ai",
    "anthropic": "anthropic",
    "vertex": "anthropic",
    "vertex_ai": "anthropic",
    "together": "together_ai",
    "together_ai": "together_ai",
    "fireworks": "fireworks_ai",
    "fireworks_ai": "fireworks_ai",
    "google": "google",
    "gemini": "google",
    "openai": "openai",
    "openai_codex": "openai",
    "mistral": "mistralai",
    "mistralai": "mistralai",
    "deepseek": "deepseek",
    "qwen": "qwen",
}

# Fixed values: (keywords, provider), first match wins. The price catalogue knows fewer families.
PROVIDER_KEYWORDS = [
    (["claude", "anthropic"], "anthropic"),
    (["gpt", "openai"], "openai"),
    (["gemini", "google"], "google"),
    (["grok"], "xai"),
    (["deepseek"], "deepseek"),
    (["mimo", "xiaomi"], "xiaomi"),
    (["mistral", "mixtral"], "mistral"),
    (["llama"], "meta_llama"),
    (["qwen"], "qwen"),
    (["glm"], "zai"),
]
NOT_IN_CATALOGUE = ["xiaomi", "zai"]

# Providers whose catalogue prefix differs from their own name.
CATALOGUE_PREFIXES = {"meta_llama": "meta-llama", "xai": "x-ai"}

# Catalogue keys of subscription plans, never used as prices.
EXCLUDED_PRICE_PREFIX = "github_copilot/"

# Fuzzy price matching.
FUZZY_MIN_LENGTH = 5
FUZZY_PROVIDER_BONUS = 10_000
FUZZY_SLASH_BONUS = 100
FUZZY_PENALTIES = {"openrouter/": 5_000, "vertex_ai/": 2_000, "bedrock/": 2_000}

# Heat levels 1..4 end at these totals, 5 lies beyond, 0 means no usage.
HEAT_LIMITS = [10_000, 100_000, 1_000_000, 100_000_000]
HEATMAP_DAYS_BACK = 364

# List lengths of the reports.
TOP_MODELS = 8
DRILL_MODELS = 6
OTHER_MODEL = "__other__"

# Default chart granularity by days in the range (more than -> granularity).
GRANULARITY_LIMITS = [(730, "yearly"), (365, "monthly"), (90, "weekly")]

# Export bundle header.
BUNDLE_FORMAT = "tallyhouse-bundle"
BUNDLE_VERSION = 1

# Quota window codes of captured plan responses, in display order.
QUOTA_WINDOWS = [(3, "5h"), (6, "week"), (5, "month")]
QUOTA_SCRIPT_KEYS = [("rollingUsage", "5h"), ("weeklyUsage", "week"), ("monthlyUsage", "month")]
# fixed value: where the harness keeps the folders of its sessions, below its home
HARNESS_PROJECTS = "storages/session_projcache.json"
