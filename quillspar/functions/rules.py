"""Rule sets, as ordered tables.

All values in this module are fixed values that results depend on: keywords, labels, patterns and thresholds, in the
order in which they apply.
"""

from __future__ import annotations

#: Domain, keywords; the first keyword found in a lower-cased path wins.
DOMAINS = (
    ("Authentication & Identity", ("auth", "login", "signup", "session", "user", "account", "oauth", "sso")),
    ("Analytics & Reporting", ("dashboard", "analytics", "chart", "report", "metric", "stat", "insight")),
    ("Content Management", ("article", "newsletter", "news", "research", "content", "blog", "post", "cms")),
    ("Search & Discovery", ("search", "filter", "query", "index", "catalog", "browse")),
    ("Notifications", ("alert", "notification", "email", "sms", "webhook", "push", "message")),
    ("Payments & Billing", ("payment", "subscription", "billing", "stripe", "checkout", "invoice")),
    ("API Layer", ("api", "endpoint", "handler", "controller", "middleware")),
    ("UI Components", ("component", "ui", "button", "form", "modal", "dialog", "layout", "widget")),
    ("React Hooks", ("hook", "hooks", "use")),
    ("State Management", ("store", "state", "redux", "zustand", "context", "atom")),
    ("Shared Utilities", ("lib", "util", "helper", "common", "shared", "tool")),
    ("Data Layer", ("data", "database", "db", "prisma", "sql", "model", "schema", "migration", "seed")),
    ("Configuration", ("config", "setting", "env", "constant")),
    ("Testing", ("test", "spec", "fixture", "mock", "stub", "e2e", "cypress", "playwright")),
    ("Background Jobs", ("job", "queue", "worker", "cron", "task", "scheduler", "background")),
    ("Core Engine", ("core", "kernel", "foundation", "engine")),
    ("Rendering & Output", ("render", "template", "format", "output")),
    ("Publishing & Delivery", ("publish", "deploy", "release", "distribute")),
    ("Analysis & Detection", ("analyz", "inspect", "detect", "lint", "scan", "parse")),
    ("Plugin System", ("plugin", "extension", "addon", "module")),
    ("Delivery", ("deliver", "dispatch", "send", "transport")),
    ("Documentation", ("doc", "generate", "markdown", "readme")),
    ("Integrations", ("integrat", "connect", "adapter", "bridge", "gateway")),
    ("CLI & Commands", ("cli", "command", "bin", "terminal", "shell", "prompt")),
    ("AI & Machine Learning", ("ai", "ml", "llm", "gpt", "openai", "anthropic", "gemini")),
    ("Services", ("service", "provider", "client", "sdk")),
)
#: Type, keywords.
MODULE_TYPES = (
    ("test", ("test", "spec", "__test")),
    ("api", ("api", "endpoint")),
    ("ui", ("component", "widget")),
    ("library", ("lib", "util", "helper", "common", "shared")),
    ("hooks", ("hook",)),
    ("state", ("store", "state", "redux", "zustand")),
    ("route", ("page", "route", "view")),
    ("config", ("config", "setting", "env")),
    ("core", ("core", "kernel", "foundation")),
    ("renderer", ("render", "template", "format")),
    ("publisher", ("publish", "output", "export")),
    ("analyzer", ("analyz", "inspect", "detect")),
    ("plugin", ("plugin", "extension", "addon")),
    ("delivery", ("deliver", "dispatch", "send")),
    ("documentation", ("doc", "generate")),
    ("integration", ("integrat", "connect", "adapter")),
    ("cli", ("cli", "command", "bin")),
    ("ai", ("ai", "ml", "model", "prompt")),
    ("auth", ("auth", "login", "session")),
    ("data", ("data", "db", "model", "schema")),
    ("middleware", ("middleware",)),
    ("service", ("service",)),
    ("app", ("app",)),
)
#: Category on the system map, keywords.
MAP_CATEGORIES = (
    ("test", ("test", "spec")),
    ("core", ("core", "kernel")),
    ("analyzer", ("analyz", "detect", "inspect")),
    ("renderer", ("render", "format", "template")),
    ("publisher", ("publish", "output")),
    ("delivery", ("deliver", "dispatch")),
    ("integration", ("integrat", "connect", "adapter")),
    ("util", ("util", "helper", "lib", "common")),
    ("ai", ("ai", "llm", "prompt")),
    ("docs", ("doc", "generate")),
    ("plugin", ("plugin", "extension")),
    ("config", ("config", "setting")),
    ("cli", ("cli", "bin", "command")),
    ("api", ("api", "endpoint")),
    ("ui", ("component", "ui")),
    ("page", ("page", "route", "view")),
    ("state", ("store", "state")),
    ("middleware", ("middleware",)),
    ("service", ("service",)),
)
#: What a module is described as (our wording), keywords.
DESCRIPTIONS = (
    ("core logic", ("core",)),
    ("utilities", ("util",)),
    ("API handlers", ("api",)),
    ("UI components", ("component",)),
    ("hooks", ("hook",)),
    ("pages", ("page",)),
    ("libraries", ("lib",)),
    ("services", ("service",)),
    ("data models", ("model",)),
    ("state", ("store", "state")),
    ("settings", ("config",)),
    ("tests", ("test",)),
    ("styles", ("style", "css")),
    ("types", ("type",)),
    ("middleware", ("middleware",)),
    ("authentication", ("auth",)),
    ("rendering", ("render",)),
    ("publishing", ("publish",)),
    ("analysis", ("analyz",)),
    ("delivery", ("delivery",)),
    ("integrations", ("integrat",)),
    ("documentation", ("doc",)),
    ("command line", ("bin", "cli")),
    ("plugins", ("plugin", "extension")),
    ("prompts", ("prompt",)),
    ("providers", ("provider",)),
    ("generators", ("generate", "section")),
    ("machine learning", ("ai", "ml")),
)
#: Purpose of a flow's step, keywords.
STEP_PURPOSES = (
    ("Data acquisition", ("import", "load", "read", "fetch", "get")),
    ("Input validation", ("valid", "check", "verify")),
    ("Data transformation", ("transform", "convert", "map", "parse")),
    ("Data persistence", ("save", "write", "store", "persist", "create", "update", "delete")),
    ("Event/message dispatch", ("send", "emit", "dispatch", "notify", "publish")),
    ("Output generation", ("render", "display", "show", "format")),
    ("Security check", ("auth", "login", "permission")),
    ("Performance optimization", ("cache", "memo")),
    ("Observability", ("log", "track", "metric")),
)
#: Extension, language.
LANGUAGES = (
    (".js", "JavaScript"), (".mjs", "JavaScript"), (".cjs", "JavaScript"), (".jsx", "JavaScript"), (".ts", "TypeScript"), (".tsx", "TypeScript"),
    (".py", "Python"), (".pyw", "Python"), (".pyi", "Python"), (".go", "Go"), (".rs", "Rust"), (".java", "Java"), (".c", "C"), (".h", "C"),
    (".cpp", "C++"), (".hpp", "C++"), (".cc", "C++"), (".cxx", "C++"), (".cs", "C#"), (".rb", "Ruby"), (".php", "PHP"), (".swift", "Swift"),
    (".kt", "Kotlin"), (".kts", "Kotlin"), (".scala", "Scala"), (".sh", "Shell"), (".bash", "Shell"), (".zsh", "Shell"), (".sql", "SQL"),
)
#: Kind, label, package names any of which shows it.
PACKAGES = (
    ("framework", "Next.js", ("next",)), ("framework", "React", ("react",)), ("framework", "Vue", ("vue",)), ("framework", "Angular", ("angular", "@angular/core")),
    ("framework", "Express", ("express",)), ("framework", "Fastify", ("fastify",)), ("framework", "NestJS", ("nestjs", "@nestjs/core")), ("framework", "Svelte", ("svelte",)),
    ("framework", "Solid", ("solid-js",)), ("framework", "Hono", ("hono",)), ("framework", "Koa", ("koa",)), ("framework", "Hapi", ("hapi", "@hapi/hapi")), ("framework", "Electron", ("electron",)),
    ("test", "Vitest", ("vitest",)), ("test", "Jest", ("jest",)), ("test", "Mocha", ("mocha",)), ("test", "Playwright", ("playwright",)), ("test", "Cypress", ("cypress",)), ("test", "Ava", ("ava",)),
    ("build", "Vite", ("vite",)), ("build", "Webpack", ("webpack",)), ("build", "Rollup", ("rollup",)), ("build", "esbuild", ("esbuild",)), ("build", "Turborepo", ("turbo",)),
    ("build", "tsup", ("tsup",)), ("build", "SWC", ("swc", "@swc/core")), ("build", "Parcel", ("parcel",)), ("language", "TypeScript", ("typescript",)),
    ("language", "Node.js", ("node-fetch", "fs-extra", "dotenv", "commander", "yargs", "chalk", "inquirer", "ora", "execa")),
)
#: Manifest, text found in it in any case (empty: the file itself), kind, label.
MANIFESTS = (
    ("pyproject.toml", "", "language", "Python"), ("pyproject.toml", "django", "framework", "Django"), ("pyproject.toml", "fastapi", "framework", "FastAPI"), ("pyproject.toml", "flask", "framework", "Flask"),
    ("pyproject.toml", "pytest", "test", "pytest"), ("pyproject.toml", "poetry", "build", "Poetry"), ("requirements.txt", "", "language", "Python"), ("requirements.txt", "django", "framework", "Django"),
    ("requirements.txt", "fastapi", "framework", "FastAPI"), ("requirements.txt", "flask", "framework", "Flask"), ("requirements.txt", "pytest", "test", "pytest"), ("setup.py", "", "language", "Python"),
    ("go.mod", "", "language", "Go"), ("go.mod", "gin-gonic", "framework", "Gin"), ("go.mod", "echo", "framework", "Echo"), ("go.mod", "fiber", "framework", "Fiber"),
    ("Cargo.toml", "", "language", "Rust"), ("Cargo.toml", "actix", "framework", "Actix"), ("Cargo.toml", "rocket", "framework", "Rocket"), ("Cargo.toml", "tokio", "framework", "Tokio"),
)
#: Service, category, patterns any of which shows it. Patterns that name a particular tool's own variables are left out.
SERVICES = (
    ("OpenAI API", "AI/ML", (r"api\.openai\.com", r"chat/completions", r"OPENAI.*API_KEY")),
    ("Notion API", "Publishing", (r"api\.notion\.com", r"NOTION_TOKEN", r"notion.*pages")),
    ("npm Registry", "Package Management", (r"registry\.npmjs\.org", r"npm.*latest")),
    ("GitHub API", "Version Control", (r"api\.github\.com", r"GITHUB_TOKEN")),
)
#: Id, category, severity, CWE, pattern (RE2 form: a lookahead is replaced by the character it forbids or the end).
SECURITY = (
    ("eval-usage", "Code Injection", "high", "CWE-95", r"(?:^|[^A-Za-z0-9_])eval\s*\("),
    ("new-function", "Code Injection", "high", "CWE-95", r"new\s+Function\s*\("),
    ("set-timeout-string", "Code Injection", "medium", "CWE-95", r"(?:setTimeout|setInterval)\s*\(\s*['\"`]"),
    ("innerhtml-assignment", "Cross-Site Scripting (XSS)", "high", "CWE-79", r"\.innerHTML\s*[=+](?:[^=]|$)"),
    ("outerhtml-assignment", "Cross-Site Scripting (XSS)", "high", "CWE-79", r"\.outerHTML\s*[=+](?:[^=]|$)"),
    ("document-write", "Cross-Site Scripting (XSS)", "high", "CWE-79", r"document\.write(?:ln)?\s*\("),
    ("dangerously-set-inner-html", "Cross-Site Scripting (XSS)", "medium", "CWE-79", r"dangerouslySetInnerHTML"),
    ("sql-concatenation", "SQL Injection", "high", "CWE-89", r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+[^\n]*?\+\s*(?:\w+|['\"`])"),
    ("sql-template-literal", "SQL Injection", "medium", "CWE-89", r"(?i)`(?:SELECT|INSERT|UPDATE|DELETE|DROP)\s+[^`]*\$\{"),
    ("exec-usage", "Command Injection", "high", "CWE-78", r"(?:exec|execSync)\s*\(\s*(?:`[^`]*\$\{|['\"][^)]*\+)"),
    ("shell-true", "Command Injection", "medium", "CWE-78", r"shell\s*:\s*true"),
    ("path-traversal", "Path Traversal", "medium", "CWE-22", r"path\.(?:join|resolve)\s*\([^)]*req\.(?:params|query|body)"),
    ("prototype-assignment", "Prototype Pollution", "high", "CWE-1321", r"__proto__\s*[=\[]"),
    ("object-merge-unsafe", "Prototype Pollution", "low", "CWE-1321", r"(?:deepMerge|deepExtend|merge|assign)\s*\("),
    ("hardcoded-password", "Hardcoded Credentials", "high", "CWE-798", r"(?i)(?:password|passwd|secret|api_?key|token)\s*[:=]\s*['\"][^'\"]{8,}['\"]"),
    ("math-random-security", "Insecure Randomness", "low", "CWE-330", r"Math\.random\s*\(\s*\)"),
    ("regex-dos", "ReDoS", "low", "CWE-1333", r"new\s+RegExp\s*\(\s*(?:\w+|['\"`])"),
)
SEVERITIES = ("high", "medium", "low")
#: Library, pattern.
GRAPHQL_LIBRARIES = (
    ("Apollo Server", r"ApolloServer|@apollo/server|apollo-server"),
    ("GraphQL Yoga", r"graphql-yoga|createYoga"),
    ("Mercurius", r"mercurius"),
    ("graphql-js", r"graphql\b.*\bbuildSchema\b|\bGraphQLSchema\b|\bGraphQLObjectType\b"),
    ("type-graphql", r"type-graphql|@Resolver|@Query|@Mutation"),
    ("Nexus", r"nexus|makeSchema|objectType\("),
    ("Pothos", r"pothos|SchemaBuilder"),
    ("Hasura", r"hasura"),
    ("Relay", r"relay-runtime|RelayEnvironment"),
    ("urql", r"urql|@urql"),
    ("Apollo Client", r"ApolloClient|@apollo/client|apollo-client|useQuery|useMutation"),
)
RESOLVERS = (r"(?:Query|Mutation|Subscription)\s*:\s*\{", r"resolvers?\s*=\s*\{", r"createResolversMap", r"\bresolveType\b", r"fieldResolver")
#: Paths that analyses skip; security also skips CONFIG_FILE.
SKIPPED = r"node_modules/|\.test\.[jt]sx?$|\.spec\.[jt]sx?$|(?:^|[^A-Za-z0-9_])tests?/|(?:^|[^A-Za-z0-9_])dist/|(?:^|[^A-Za-z0-9_])build/|\.min\.[jt]s$|\.d\.ts$"
CONFIG_FILE = r"\.config\.[jt]s$"
CODE_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
HTTP_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE")
#: Document keys that completeness is measured against.
DOCUMENT_KEYS = (
    "system_overview", "module_catalog", "api_surface", "route_map", "system_map", "arch_diff", "executive_summary", "business_domains",
    "architecture_overview", "data_flows", "change_impact", "developer_onboarding", "graphql_schema", "type_graph", "dependency_graph", "architecture_drift",
)
#: Characters that may not stand in a scan pattern.
SHELL_CHARACTERS = (";", "|", "&", "`", "$", "(", ")", "<", ">")
IMPACT_ROOTS = ("app", "components", "lib", "hooks", "store", "services", "packages", "src")
NOISE = r"^node_modules|^package-lock\.json$|^yarn\.lock$|^pnpm-lock\.yaml$|^\.git/"
BUILT_IN_TYPES = ("Array", "Promise", "Record", "Partial", "Required", "Omit", "Pick", "Readonly", "Map", "Set", "Date", "RegExp", "Error", "Buffer")
PRIMITIVES = ("string", "number", "boolean", "void", "null", "undefined", "never", "any", "unknown", "object", "bigint", "symbol", "true", "false")
CHATTY = (
    r"(?im)^(?:[-*]\s*)?if you (?:want|need|would like|prefer)[^.\n]*[.\n]",
    r"(?im)^(?:[-*]\s*)?(?:shall|should) I [^.\n]*[.\n]",
    r"(?im)^(?:[-*]\s*)?(?:let me know|feel free)[^.\n]*[.\n]",
    r"(?im)^(?:[-*]\s*)?I can (?:also |additionally )?(?:produce|create|generate|help|provide|suggest|recommend)[^.\n]*[.\n]",
    r"(?im)^(?:[-*]\s*)?(?:would you like|do you want)[^.\n]*[.\n]",
    r"(?im)^(?:[-*]\s*)?(?:here is|here's) (?:a |the )?(?:summary|overview|breakdown)[^.\n]*:\s*$",
)
#: Key, audience, how far generated text may go (yes, hybrid, no), of each document of the plan.
DOCUMENTS = (
    ("executive_summary", "non-technical", "yes"), ("system_overview", "mixed", "yes"), ("business_domains", "mixed", "yes"), ("architecture_overview", "technical", "yes"),
    ("module_catalog", "technical", "hybrid"), ("route_map", "mixed", "hybrid"), ("api_surface", "technical", "hybrid"), ("data_flows", "mixed", "yes"), ("arch_diff", "mixed", "yes"),
    ("system_map", "mixed", "hybrid"), ("developer_onboarding", "technical", "yes"), ("graphql_schema", "technical", "no"), ("type_graph", "technical", "no"), ("dependency_graph", "technical", "no"),
    ("architecture_drift", "mixed", "no"), ("security_hotspots", "technical", "no"), ("code_health", "mixed", "no"),
)
CORE_DOCUMENTS = ("system_overview", "module_catalog", "route_map")
#: Pattern (our names), alternatives of which each is a set of keywords that all must be there.
PATTERNS = (
    ("app router", (("app/",),)), ("pages router", (("pages/",),)), ("layered components", (("component", "lib"),)), ("hooks", (("hook",),)),
    ("central state", (("store",), ("state",), ("redux",), ("zustand",))), ("api routes", (("api",), ("endpoint",))), ("core", (("core",), ("kernel",))),
    ("plugins", (("plugin",), ("extension",))), ("middleware", (("middleware",),)), ("renderers", (("render",), ("template",))), ("publishing", (("publish",), ("output",))),
    ("analysis", (("analyz",), ("detect",), ("inspect",))), ("command line", (("cli",), ("command",), ("bin",))), ("shared utilities", (("util",), ("helper",), ("lib",))),
    ("integrations", (("integrat",), ("adapter",), ("connect",))), ("ai", (("ai",), ("prompt",), ("provider",))), ("delivery", (("deliver",), ("dispatch",))), ("tests", (("test",), ("spec",))),
)
#: Of these patterns a module holding one of the keywords must have this many importers (in) or imports (out) to be verified.
VERIFIED = {"core": (("in", "core"),), "plugins": (("in", "plugin"), ("out", "plugin"), ("in", "loader")), "renderers": (("out", "render"),), "publishing": (("out", "publish"),), "shared utilities": (("in", "util"), ("in", "helper"), ("in", "lib"))}
LEAST_VERIFIED = 3

#: Document and the file it is published under.
MARKDOWN_FILES = (
    ("executive_summary", "executive_summary.md"), ("system_overview", "system_overview.md"), ("business_domains", "business_domains.md"), ("architecture_overview", "architecture_overview.md"),
    ("module_catalog", "module_catalog.md"), ("api_surface", "api_surface.md"), ("data_flows", "data_flows.md"), ("arch_diff", "architecture_diff.md"), ("route_map", "route_map.md"), ("system_map", "system_map.md"),
    ("change_impact", "change_impact.md"), ("developer_onboarding", "developer_onboarding.md"), ("graphql_schema", "graphql_schema.md"), ("type_graph", "type_graph.md"), ("dependency_graph", "dependency_graph.md"),
    ("architecture_drift", "architecture_drift.md"), ("security_hotspots", "security_hotspots.md"), ("code_health", "code_health.md"),
)
