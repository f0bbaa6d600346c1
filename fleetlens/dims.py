"""Default dictionaries of the detectors.

Fixed values: word lists, file names, patterns and formats that must stay as
they are for the results to be right. Operators take them as arguments.
"""

# --- scan -------------------------------------------------------------------

IGNORED_DIRS = (
    "readme_context", "insumos", ".git", ".svn", ".hg", ".idea", ".vscode",
    "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".venv", "venv", "env", "dist", "build", "coverage", ".next", ".nuxt",
    ".cache", "vendor", "site-packages",
)

IGNORED_FILES = (
    ".DS_Store", "Thumbs.db", "README_CANDIDATE.md", "readme_report.md",
    "delete_files.md",
)

TEXT_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp",
    ".cs", ".go", ".rs", ".php", ".rb", ".swift", ".kt", ".kts", ".html", ".htm",
    ".css", ".scss", ".sass", ".less", ".sql", ".json", ".yaml", ".yml", ".toml",
    ".ini", ".cfg", ".md", ".txt", ".sh", ".bat", ".ps1",
)

LANGUAGE_OF_EXTENSION = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "React", ".ts": "TypeScript",
    ".tsx": "React+TS", ".java": "Java", ".c": "C", ".cpp": "C++", ".h": "C/C++",
    ".hpp": "C++", ".cs": "C#", ".go": "Go", ".rs": "Rust", ".php": "PHP",
    ".rb": "Ruby", ".swift": "Swift", ".kt": "Kotlin", ".kts": "Kotlin",
    ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS",
    ".sass": "SASS", ".less": "LESS", ".sql": "SQL", ".json": "JSON",
    ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".ini": "INI",
    ".cfg": "Config", ".md": "Markdown", ".txt": "Text", ".sh": "Shell",
    ".bat": "Batch", ".ps1": "PowerShell",
}

PYTHON_LANGUAGES = ("Python",)
SCRIPT_LANGUAGES = ("JavaScript", "React", "TypeScript", "React+TS")
SQL_LANGUAGES = ("SQL",)

EXCLUDED_PATH_PATTERNS = (
    r"(^|/)vendor/",
    r"(^|/)bower_components/",
    r"(^|/)third_party/",
    r"(^|/)site-packages/",
    r"(^|/)platforms/(android|ios|browser|electron|windows)/",
    r"(^|/)_staging/",
)

THIRD_PARTY_PATTERNS = (
    r"(^|/)plugins?/",
    r"(^|/)lib/external/",
    r"(^|/)assets/vendor/",
    r"\.min\.(js|css)$",
    r"(^|/)dist/",
)

IMPORTANT_FILES = (
    "README.md", "README", "README.txt", "requirements.txt",
    "requirements-dev.txt", "pyproject.toml", "package.json",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml", "Makefile", ".env.example",
    ".env.dev.example", ".env.production.example",
)

MAX_CENSUS_KB = 300_000
MAX_CONTEXT_CHARS = 30_000

# --- technologies -----------------------------------------------------------

TECHNOLOGY_PATTERNS = {
    "React": (r"\breact\b",),
    "Vite": (r"\bvite\b",),
    "Vue": (r"\bvue\b",),
    "Angular": (r"@angular/",),
    "Flask": (r"\bflask\b",),
    "FastAPI": (r"\bfastapi\b",),
    "Django": (r"\bdjango\b",),
    "Express": (r"\bexpress\b",),
    "Node.js": (r"\bnode\b",),
    "PostgreSQL": (r"\bpostgresql\b", r"\bpsycopg\b"),
    "MySQL": (r"\bmysql\b",),
    "SQLite": (r"\bsqlite\b",),
    "MongoDB": (r"\bmongodb\b", r"\bmongoose\b"),
    "Redis": (r"\bredis\b",),
    "Docker": (r"\bdocker\b",),
    "Leaflet": (r"\bleaflet\b",),
    "Mapbox": (r"\bmapbox\b",),
    "Tailwind": (r"\btailwind\b",),
    "Pandas": (r"\bpandas\b",),
    "NumPy": (r"\bnumpy\b",),
    "OpenCV": (r"\bcv2\b", r"\bopencv\b"),
    "YOLO": (r"\byolo\b",),
    "SQLAlchemy": (r"\bsqlalchemy\b",),
}

PRIORITY_FILES = (
    "package.json", "requirements.txt", "pyproject.toml", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml",
)

MODULE_TO_TECH = {
    "react": "React", "react-dom": "React", "react-router": "React",
    "react-router-dom": "React", "vite": "Vite", "vitejs": "Vite",
    "plugin-react": "Vite", "vue": "Vue", "core": None,
    "tailwindcss": "Tailwind", "tailwind": "Tailwind",
    "flask": "Flask", "fastapi": "FastAPI", "uvicorn": "FastAPI",
    "django": "Django", "express": "Express",
    "psycopg2": "PostgreSQL", "psycopg2-binary": "PostgreSQL",
    "psycopg": "PostgreSQL", "asyncpg": "PostgreSQL", "pg": "PostgreSQL",
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL",
    "mysqlclient": "MySQL", "pymysql": "MySQL", "mysql": "MySQL",
    "mysql2": "MySQL", "mysql-connector-python": "MySQL",
    "sqlite3": "SQLite", "aiosqlite": "SQLite", "better-sqlite3": "SQLite",
    "pymongo": "MongoDB", "motor": "MongoDB", "mongoose": "MongoDB",
    "redis": "Redis", "ioredis": "Redis", "sqlalchemy": "SQLAlchemy",
    "flask-sqlalchemy": "SQLAlchemy",
    "leaflet": "Leaflet", "react-leaflet": "Leaflet", "folium": "Leaflet",
    "mapbox-gl": "Mapbox", "react-map-gl": "Mapbox",
    "pandas": "Pandas", "geopandas": "Pandas", "numpy": "NumPy",
    "opencv-python": "OpenCV", "opencv-python-headless": "OpenCV",
    "cv2": "OpenCV", "ultralytics": "YOLO", "yolov5": "YOLO", "yolov8": "YOLO",
}

PREFIX_TO_TECH = (
    ("@angular/", "Angular"),
    ("angular", "Angular"),
    ("@vitejs/", "Vite"),
    ("@tailwindcss/", "Tailwind"),
)

ASSET_TO_TECH = (
    ("leaflet", "Leaflet"),
    ("mapbox", "Mapbox"),
    ("openlayers", "Leaflet"),
    ("react", "React"),
    ("vue", "Vue"),
    ("tailwind", "Tailwind"),
    ("bootstrap", None),
)

PROVENANCE_ORDER = ("declared", "imported", "vendored", "mentioned")
CONCLUSIVE_PROVENANCE = ("declared", "imported", "vendored")
PROVENANCE_CONFIDENCE = {
    "declared": "high", "imported": "high", "vendored": "medium", "mentioned": "low",
}

# --- capabilities -----------------------------------------------------------

CAPABILITY_KEYWORDS = {
    "Autenticación": (
        "login", "logout", "signin", "jwt", "oauth", "authenticate",
        "authorization", "credentials",
    ),
    "Mapas / cartografía": (
        "leaflet", "mapbox", "openlayers", "geojson", "cartografia", "latitud",
        "longitude", "latitude",
    ),
    "Exportación": (
        "export", "exportar", "xlsx", "openpyxl", "to_csv", "to_excel", "download",
    ),
    "Carga de archivos": ("upload", "multipart", "formdata", "filereader", "uploadfile"),
    "Reportes / analítica": ("reporte", "dashboard", "analytics", "estadistica"),
    "Procesamiento de datos": ("pandas", "numpy", "dataframe", "etl", "geopandas"),
    "IA / Machine Learning": (
        "tensorflow", "pytorch", "yolo", "sklearn", "scikit-learn", "openai", "anthropic",
    ),
}

CAPABILITY_SUPPORT_TECH = {
    "Mapas / cartografía": ("Leaflet", "Mapbox"),
    "Procesamiento de datos": ("Pandas", "NumPy"),
    "IA / Machine Learning": ("YOLO", "OpenCV"),
}

CAPABILITY_SUPPORT_DEPS = {
    "Autenticación": (
        "pyjwt", "python-jose", "passlib", "bcrypt", "authlib", "jsonwebtoken",
        "passport", "next-auth", "flask-login", "django-allauth", "argon2-cffi",
        "oauthlib",
    ),
    "Mapas / cartografía": (
        "geopandas", "shapely", "pyproj", "folium", "gdal", "rtree", "pyogrio",
        "geoalchemy2",
    ),
    "Exportación": (
        "openpyxl", "xlsxwriter", "xlsx", "exceljs", "reportlab", "weasyprint",
        "python-docx", "papaparse", "csv-writer", "pandas",
    ),
    "Carga de archivos": (
        "python-multipart", "multer", "formidable", "busboy", "aiofiles",
        "django-storages",
    ),
    "Reportes / analítica": (
        "recharts", "chart.js", "chartjs", "plotly", "d3", "apexcharts",
        "matplotlib", "seaborn", "reportlab",
    ),
    "Procesamiento de datos": ("polars", "pyarrow", "dask", "duckdb"),
    "IA / Machine Learning": (
        "tensorflow", "torch", "pytorch", "scikit-learn", "sklearn", "ultralytics",
        "openai", "anthropic", "transformers", "langchain",
    ),
}

CAPABILITY_EXCLUDED_PATH = (
    r"(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|"
    r"\.eslintrc|eslint\.config\.|\.prettierrc|tsconfig\.json)"
)

# --- manifests --------------------------------------------------------------

MANIFEST_KIND = {
    "package.json": "npm", "requirements.txt": "python",
    "requirements-dev.txt": "python", "requirements-prod.txt": "python",
    "pyproject.toml": "python", "Pipfile": "python", "composer.json": "php",
    "Gemfile": "ruby", "go.mod": "go", "Cargo.toml": "rust",
    "Dockerfile": "docker", "docker-compose.yml": "compose",
    "docker-compose.yaml": "compose", "Makefile": "make",
}

REQUIREMENTS_FILES = ("requirements.txt", "requirements-dev.txt", "requirements-prod.txt")
COMPOSE_FILES = ("docker-compose.yml", "docker-compose.yaml")
MANIFEST_IGNORED_PATH = r"(^|/)(node_modules|vendor|bower_components|dist|build|\.venv|venv)/"
PYPROJECT_METADATA = (
    "name", "version", "description", "readme", "requires-python", "license",
    "authors", "homepage",
)

# --- key files, deployment --------------------------------------------------

IMPORTANT_KEYWORDS = (
    "package.json", "requirements.txt", "pyproject.toml", "dockerfile",
    "docker-compose", "main.py", "app.py", "server.py", "index.js", "index.ts",
    "vite.config", "next.config", "angular.json", "manage.py", "routes",
    "router", "api", "database", "db", "model", "schema", "service",
    "controller", "config", "settings", "auth", "login", "deploy", "docker",
    "workflow",
)
CORE_MANIFESTS = (
    "package.json", "requirements.txt", "pyproject.toml", "dockerfile",
    "docker-compose.yml", "docker-compose.yaml",
)
DEPLOYMENT_TOKENS = (
    "docker", "compose", "workflow", "deploy", "vercel", "railway", "render", "netlify",
)

# --- personal data ----------------------------------------------------------

RUT = r"\b\d{1,2}\.?\d{3}\.?\d{3}-[\dkK]\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IMPERSONAL_EMAIL = (
    r"(@users\.noreply\.github\.com$"
    r"|^(no-?reply|noreply|donotreply|postmaster|webmaster|admin|"
    r"root|info|contacto|soporte|support)@"
    r"|@(example|test|localhost|invalid|domain)\."
    r"|@(example|test)\.(com|org|net)$"
    r"|@sentry\.io$)"
)
PHONE_CL = r"\+56\s?9\s?\d{4}\s?\d{4}\b"
SENSITIVE_FIELD = (
    r"\b(rut|run|dni|pasaporte|correo|email|e_mail|telefono|celular|fono"
    r"|direccion|domicilio|nombre_completo|apellido_paterno|apellido_materno"
    r"|fecha_nacimiento|genero|etnia|pueblo_originario|afiliacion|sindicato"
    r"|prevision|isapre|afp|diagnostico|licencia_medica)\b"
)
SPECIAL_CATEGORY = (
    r"\b(salud|diagnostico|sindical|sindicato|afiliacion politica|"
    r"pueblo originario|etnia|discapacidad)\b"
)
TEST_PATH = (
    r"(^|/)(tests?|__tests__|spec|fixtures?|mocks?|seeds?|"
    r"factories|stubs?|demo|ejemplos?)(/|$)|"
    r"(seed|fixture|mock|sample|ejemplo)[^/]*$"
)
SPREADSHEET_EXTENSIONS = (".csv", ".xlsx", ".xls", ".ods", ".dbf")

# --- cleanup ----------------------------------------------------------------

PROTECTED_PATHS = (
    r"(^|/)README(\.(md|txt|rst))?$",
    r"(^|/)LICEN[SC]E",
    r"(^|/)COPYING",
    r"(^|/)CHANGELOG",
    r"(^|/)CONTRIBUTING",
    r"(^|/)\.git(ignore|attributes|modules)",
    r"(^|/)\.github/",
    r"(^|/)package\.json$",
    r"(^|/)package-lock\.json$",
    r"(^|/)requirements[^/]*\.txt$",
    r"(^|/)pyproject\.toml$",
    r"(^|/)Pipfile",
    r"(^|/)poetry\.lock$",
    r"(^|/)composer\.(json|lock)$",
    r"(^|/)go\.(mod|sum)$",
    r"(^|/)Cargo\.(toml|lock)$",
    r"(^|/)Dockerfile",
    r"(^|/)docker-compose",
    r"(^|/)Makefile$",
    r"(^|/)migrations?/",
    r"(^|/)alembic/",
    r"(^|/)flyway",
    r"(^|/)tests?/",
    r"(^|/)__tests__/",
    r"(^|/)spec/",
    r"(^|/)\.env",
    r"(^|/)CLAUDE\.md$",
    r"(^|/)(vite|next|nuxt|astro|svelte|tailwind|postcss|webpack"
    r"|rollup|babel|jest|vitest|playwright|cypress|eslint"
    r"|prettier|commitlint|lint-staged|drizzle|knexfile"
    r"|metro|capacitor|ionic|craco|jsconfig|tsconfig)"
    r"[.\w-]*\.(js|cjs|mjs|ts|json|yaml|yml)$",
    r"(^|/)(setup|conftest|manage|wsgi|asgi|gunicorn|celery)\.py$",
    r"(^|/)(setup|tox|pytest|alembic|mypy|pyrightconfig)\.(cfg|ini|toml|json)$",
)
GENERATOR_ARTEFACT = r"(^|/)(README_CANDIDATE\.md|readme_report\.md|readme_context/)"
BUILD_RESIDUE = (
    r"((^|/)__pycache__/|(^|/)node_modules/|(^|/)\.venv/|(^|/)venv/"
    r"|(^|/)\.pytest_cache/|(^|/)\.mypy_cache/|\.pyc$|\.pyo$"
    r"|(^|/)\.DS_Store$|(^|/)Thumbs\.db$)"
)
VARIANT_SUFFIX = (
    r"(\s*-\s*cop(?:y|ia)|\s*\(\d+\)|\s*-\s*copy|_old|_OLD|_bak|_backup"
    r"|_viejo|_antiguo|_v\d+|~|\.bak|\.orig)"
)
NON_CODE_EXTENSIONS = (
    ".md", ".txt", ".rst", ".adoc", ".csv", ".xlsx", ".xls", ".parquet", ".pdf",
    ".zip", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".html", ".htm",
    ".css", ".scss", ".sass", ".less", ".sql",
)
ENTRY_POINTS = (
    r"if\s+__name__\s*==\s*[\"']__main__[\"']",
    r"^#!",
    r"@app\.route",
    r"createRoot|ReactDOM\.render",
)
CONVENTIONAL_STEMS = (
    "main", "app", "index", "server", "manage", "setup", "conftest", "__init__",
    "wsgi", "asgi", "run",
)
CATEGORY_ARTEFACT = "artefacto del generador"
CATEGORY_BUILD = "resto de build o entorno"
CATEGORY_VARIANT = "variante o respaldo"
CATEGORY_ORPHAN = "huerfano aparente"

# --- README contract --------------------------------------------------------

BLOCK_BEGIN = r"<!--\s*AI:BEGIN\s+id=([\w.-]+)(?:\s+sha=([0-9a-f]+))?\s*-->"
BLOCK_END = r"<!--\s*AI:END(?:\s+id=([\w.-]+))?\s*-->"
LOCK_MARK = r"<!--\s*ai-readme:lock\s*-->"
FINGERPRINT_MARK = r"<!--\s*ai-readme-fingerprint:\s*sha256:([0-9a-f]{8,64})\s*-->"
FINGERPRINT_PREFIX = "<!-- ai-readme-fingerprint: sha256:"
PLACEHOLDER_SIZE = 200
MAIN_BLOCK = "readme"
CONFIG_KEYS = (
    "enabled", "lang", "ignore_paths", "declared", "artifacts", "cleanup", "insumos",
)
CONFIG_LANGUAGES = ("en", "es")

# --- claims -----------------------------------------------------------------

IGNORED_ENV_NAMES = ("README", "API", "URL", "HTTP", "HTTPS", "UTF8", "UTF_8", "ASCII")
GENERIC_WORDS = (
    "api", "http", "https", "get", "post", "put", "patch", "delete", "readme",
    "json", "yaml", "html", "css", "js", "ts", "python", "project", "system",
    "software",
)
TECHNOLOGY_ALIASES = (
    ("postgres", "PostgreSQL"), ("postgresql", "PostgreSQL"), ("sqlite", "SQLite"),
    ("redis", "Redis"), ("fastapi", "FastAPI"), ("flask", "Flask"),
    ("django", "Django"), ("react", "React"), ("vite", "Vite"),
    ("express", "Express"), ("node.js", "Node.js"), ("nodejs", "Node.js"),
    ("leaflet", "Leaflet"), ("mapbox", "Mapbox"), ("tailwind", "Tailwind"),
    ("pandas", "Pandas"), ("numpy", "NumPy"), ("opencv", "OpenCV"),
    ("yolo", "YOLO"), ("sqlalchemy", "SQLAlchemy"), ("docker", "Docker"),
    ("vue", "Vue"), ("angular", "Angular"),
)
ENV_CLAIM = r"\b([A-Z][A-Z0-9_]{2,})\b"
ENDPOINT_CLAIM = r"\b(GET|POST|PUT|PATCH|DELETE)\s+`?(/[A-Za-z0-9_./:{}\-?=&]+)`?"
TABLE_CLAIM = r"`([a-zA-Z_][a-zA-Z0-9_]*)`"
COMMAND_CLAIMS = (
    r"^\s*(python(?:3)?\s+[^\n]+)$",
    r"^\s*(pip(?:3)?\s+[^\n]+)$",
    r"^\s*(npm\s+[^\n]+)$",
    r"^\s*(npx\s+[^\n]+)$",
    r"^\s*(uvicorn\s+[^\n]+)$",
    r"^\s*(docker\s+[^\n]+)$",
    r"^\s*(docker-compose\s+[^\n]+)$",
)
NPM_COMMANDS = ("npm install", "npm i", "npm ci", "yarn install", "yarn", "pnpm install")
DOCKER_COMMANDS = (
    "docker compose up", "docker-compose up", "docker compose up -d",
    "docker-compose up -d", "docker compose build", "docker-compose build",
)
MINIMUM_README = 300
REQUIRED_CONCEPTS = ("descripción", "instalación", "ejecución")
UNCERTAIN_PHRASES = (
    "probablemente", "posiblemente", "parece utilizar", "podría utilizar",
    "se espera que", "aparentemente",
)

# --- derived documents ------------------------------------------------------

REQUIRED_DOCUMENTS = ("00-PROBLEMA.md", "01-SOLUCION.md", "MANIFIESTO.yaml")
CITATION = r"\[([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]{1,8})(?::(\d+))?\]"
NOT_A_CITATION = (
    "INFERIDO", "PENDIENTE", "VERIFICAR",
    "00-PROBLEMA.md", "01-SOLUCION.md", "MANIFIESTO.yaml",
)
SECTION_MARK = r"^=====\s*([\w.\-]+)\s*=====\s*$"
DERIVED_MARK = "DERIVADO DEL CODIGO"
PENDING_SHA = "[PENDIENTE] sin calcular"
REPORT_SECTION = "INFORME"

# --- environment example ----------------------------------------------------

RUNTIME_ENV = (
    "PATH", "HOME", "USER", "USERNAME", "SHELL", "PWD", "LANG", "LC_ALL",
    "TERM", "TMPDIR", "TEMP", "TMP", "OS", "HOSTNAME",
    "PYTHONPATH", "PYTHONHOME", "VIRTUAL_ENV", "CONDA_PREFIX",
    "NODE_ENV", "npm_lifecycle_event",
    "CI", "GITHUB_ACTIONS", "GITHUB_TOKEN", "GITHUB_REPOSITORY",
    "RUNNER_OS", "RUNNER_TEMP",
    "SCRIPT_NAME", "HTTP_USER_AGENT", "REQUEST_METHOD", "QUERY_STRING",
    "REMOTE_ADDR", "SERVER_NAME", "SERVER_PORT", "CONTENT_TYPE",
)
SECRET_HINT = "secreto: no lo escribas aqui, ponlo en el .env real"
ENV_HINTS = (
    ("PASSWORD", SECRET_HINT), ("SECRET", SECRET_HINT), ("TOKEN", SECRET_HINT),
    ("KEY", SECRET_HINT), ("_URL", "URL completa"), ("_HOST", "nombre de host"),
    ("_PORT", "puerto"), ("_USER", "nombre de usuario"), ("_NAME", "nombre"),
    ("_PATH", "ruta en el sistema de archivos"),
    ("DATABASE", "conexion a la base de datos"),
)
DEFAULT_ENV_HINT = "sin valor por defecto conocido"
