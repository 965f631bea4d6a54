"""Fixed values the results depend on.

Everything in this module is a constant that must keep its exact value (and,
where it is a list, its order) for the outputs to agree with the recorded
results. Operators take these as default arguments, so a caller can pass other
rules without touching the code.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — patterns, keyword lists, labels, weights. Do not edit.
# ---------------------------------------------------------------------------

# Log line patterns (Java regex syntax; also valid RE2 for the DuckDB oracle).
HTTP_PATTERN = r'(GET|POST|PUT|DELETE|PATCH)\s+(/[^\s,"]*)'
SQL_PATTERN = r"(?i)(select|insert|update|delete)\s+.*?(from|into|set)\s+(\w+)"

# DDL patterns.
CREATE_TABLE_PATTERN = r"(?is)CREATE\s+TABLE\s+(\w+)\s*\((.+?)\);"
FOREIGN_KEY_PATTERN = r"(?i)FOREIGN\s+KEY\s*\((\w+)\)\s+REFERENCES\s+(\w+)\s*\((\w+)\)"
COLUMN_SPLIT_PATTERN = r",\s*\n"
CONSTRAINT_KEYWORDS = ["PRIMARY", "FOREIGN", "UNIQUE", "INDEX", "KEY", "CONSTRAINT"]

# Schema-file candidates, highest priority first (relative to a project root).
DDL_CANDIDATES = [
    "src/main/resources/db/h2/schema.sql",
    "src/main/resources/schema.sql",
    "src/main/resources/db/hsqldb/schema.sql",
    "src/main/resources/db/mysql/schema.sql",
]

# Table domain (step 2B): first rule with a keyword that is a substring wins.
TABLE_DOMAIN_RULES = [
    ("veterinarian", ["vet", "specialty", "specialt"]),
    ("owner_pet", ["owner", "pet"]),
    ("appointment", ["visit", "appointment"]),
    ("reference", ["type", "status", "categor"]),
]
TABLE_DOMAIN_DEFAULT = "other"

# Class domain (step 2D): lowercase substring, first rule wins.
CLASS_DOMAIN_RULES = [
    ("owner-pet-visit", ["owner", "pet", "visit"]),
    ("veterinaire", ["vet", "specialty"]),
    ("systeme", ["cache", "web", "crash", "welcome", "runtime", "application"]),
]
CLASS_DOMAIN_DEFAULT = "autre"

# Stereotype by class-name suffix (case-sensitive), first rule wins.
STEREOTYPE_RULES = [
    ("Controleur", ["Controller"]),
    ("Repository", ["Repository", "Repo"]),
    ("Service", ["Service"]),
    ("Utilitaire", ["Formatter"]),
    ("Validateur", ["Validator"]),
    ("Configuration", ["Configuration"]),
    ("Application", ["Application", "RuntimeHints"]),
]
STEREOTYPE_DEFAULT = "Entite"

# Display rank of a stereotype in the by-domain sheet; anything else is 5.
STEREOTYPE_RANK = [("Controleur", 1), ("Repository", 2), ("Service", 3), ("Entite", 4)]
STEREOTYPE_RANK_DEFAULT = 5

# Words removed (anywhere, in this order) from the lowercase class name before
# matching it against table names.
TABLE_STEM_REMOVALS = ["controller", "service", "repository", "repo", "formatter", "validator"]

# Call types that mark a class as using injection.
INJECTION_CALL_TYPES = ["autowired", "constructor_injection"]
INJECTION_ANNOTATIONS = ["Autowired", "Inject"]

# CamelCase stop words for class-name tokens (case-sensitive).
CAMEL_STOP_WORDS = ["Controller", "Service", "Repository", "Repo", "Impl", "Manager", "Handler", "Bean", "Helper"]

# The 14 matrix columns, in order; the last 12 are numeric.
MATRIX_COLUMNS = [
    "class_name", "related_table",
    "calls_out", "calls_in", "deps_unique", "has_autowired",
    "db_columns", "db_fk_out", "db_fk_in", "db_relations",
    "log_frequency",
    "is_controller", "is_service", "is_repository",
]
NUMERIC_COLUMNS = MATRIX_COLUMNS[2:]
# Counts (bigint); the other numeric columns are 0/1 flags.
COUNT_COLUMNS = [c for c in NUMERIC_COLUMNS if not c.startswith(("has_", "is_"))]

# Composite fusion weights.
W_NUMERIC = 0.70
W_TFIDF = 0.30

# Null related table as printed by each sink.
NONE_RAW = "none"
NONE_READABLE = "aucune"
NONE_BY_DOMAIN = "—"

# Readable sheet headings, in column order.
READABLE_HEADINGS = [
    "Classe Java",
    "Domaine metier",
    "Role Spring",
    "Table SQL liee",
    "Appels sortants (nb methodes appelees)",
    "Appels entrants (nb classes qui appellent cette classe)",
    "Dependances injectees (Autowired/Constructeur)",
    "Nb colonnes dans la table SQL",
    "Nb relations entre tables (cles etrangeres)",
    "Frequence dans les logs HTTP",
]

# By-domain sheet headings, in column order.
BY_DOMAIN_HEADINGS = [
    "Domaine metier (Microservice candidat)",
    "Classe Java",
    "Role Spring",
    "Table SQL geree",
    "Couplage sortant (appels vers autres classes)",
    "Couplage entrant (appels recus)",
    "Injecte des dependances",
    "Frequence utilisation (logs)",
]
YES = "Oui"
NO = "Non"

# Artifacts listed in the manifest (file name, step label).
ARTIFACTS = [
    ("call_graph.json", 1),
    ("db_features.json", 1),
    ("logs_features.json", 1),
    ("feature_matrix.csv", 2),
    ("feature_normalized.csv", 3),
    ("tfidf_matrix.csv", 3),
    ("composite_features.csv", 3),
]

# Quality thresholds.
MEAN_TOLERANCE = 0.01
CONSTANT_SCALE = 0.001
PREVIEW_ROWS = 5
TOP_PAIRS = 5

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------
