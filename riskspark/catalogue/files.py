"""Which paths matter. Fixed values."""

# Basenames that are always critical.
CRITICAL_BASENAMES = (
    ".env", "package.json", "pnpm-lock.yaml", "package-lock.json", "yarn.lock", "pyproject.toml",
    "requirements.txt", "setup.py", "setup.cfg", "poetry.lock", "uv.lock", "Cargo.toml", "Cargo.lock",
    "build.rs", "go.mod", "go.sum", "Gemfile", "Gemfile.lock", "gems.locked", "Rakefile", "extconf.rb",
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "init.gradle",
    "init.gradle.kts", "gradlew", "gradlew.bat", "gradle-wrapper.properties", "Makefile", "Dockerfile",
    "docker-compose.yml", "compose.yml", "compose.yaml", "AGENTS.md", "CLAUDE.md", ".mcp.json", "mcp.json",
    "README.md",
)
ROOT_DOCUMENTS = ("README", "README.md", "README.markdown", "index.html", "index.htm")
DOCUMENT_PREFIXES = ("docs/", "documentation/")
DOCUMENT_SUFFIXES = (".md", ".markdown", ".html", ".htm")
CRITICAL_PREFIXES = (
    ".github/workflows/", ".cursor/rules", "scripts/", "bin/", "tools/", ".mcp/", ".cargo/", "gradle/", "buildSrc/",
)
CRITICAL_SUFFIXES = (".go", ".gemspec")
SKIP_DIRS = (".git", "node_modules", "vendor", "target", "dist", "build", "__pycache__", ".venv", "venv")
FIXTURE_MARKER = ".scan-fixtures"
COMPOSE_NAMES = ("docker-compose.yml", "compose.yml", "compose.yaml")
COMMAND_TARGET_TOOLS = ("bash", "sh", "python", "node", "powershell", "pwsh")

# Limits.
MAX_TEXT_BYTES = 2 * 1024 * 1024
NUL_PROBE_BYTES = 4096
SNAPSHOT_MAX_FILES = 5000
SNAPSHOT_MAX_DEPTH = 32
SNAPSHOT_MAX_FILE_BYTES = 1024 * 1024
SNAPSHOT_MAX_BYTES = 32 * 1024 * 1024
MAX_CHAIN_DEPTH = 5
MAX_NODES = 100
