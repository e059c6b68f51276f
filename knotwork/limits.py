"""Fixed values of the engine: limits, thresholds and names that results depend on."""

MAX_KEYWORDS, SEEDS_PER_KEYWORD, MAX_SEEDS = 8, 5, 15
DEFAULT_HOPS, MAX_HOPS = 1, 2
DEFAULT_NODES, MAX_NODES = 80, 150
RELS, RELS_LARGE = 160, 300  # the second where over DEFAULT_NODES nodes are asked for
PATH_PAIRS, PATH_LENGTH, RELS_PER_HOP = 10, 4, 2000
FACT_CHARS, FACTS_PER_NODE = 160, 24
FLOOR, ANCHOR_DISTANCE, ANCHOR_MIN_CHARS, CONTAINED_MIN_CHARS = 0.5, 1, 3, 4
BM25_K1, BM25_B = 1.2, 0.75
CITATION_DENSITY = 0.5
INSERT_BATCH, DELETE_BATCH, PAIRS_REPORTED = 500, 2000, 10
HELD_AT_REJECTIONS, REASON_CHARS = 3, 500
CRAWL_DELAY_MS, CRAWL_PAGES = 1000, 10
LOW_QUALITY_CHARS = 200
VIEW_NODES, VIEW_NODES_MAX, VIEW_RELS, VIEW_RELS_MAX = 300, 1000, 600, 2000
SYSTEM_LABEL = "RKEntity"
SYSTEM_PROPS = ["name", "name_key", "kgid", "reviewed_files", "input_files"]
RESERVED_PROPS = ["name_key", "kgid", "reviewed_files", "input_files"]
LABEL_RULE, TYPE_RULE = "^[A-Z][A-Za-z0-9]{1,39}$", "^[A-Z][A-Z0-9_]{1,39}$"
REQUIRED_META = ["input_file", "schema_version", "engine", "generated_at"]
# What stderr says of a used-up quota (a bare 429 may be part of an address), and what a database's errors say.
RATE_LIMIT = r"(?i)rate[ _-]?limit|usage limit|quota exceeded|too many requests|사용량 한도|한도에 도달|(?:http|status)[^0-9]{0,10}429"
DATABASE_AUTH, DATABASE_PAUSED = "(?i)Unauthorized|authentication", "(?i)ServiceUnavailable|routing|Connection was closed|Failed to connect|ECONNREFUSED|ETIMEDOUT"
DATABASE_ERROR_NAME = "Neo4jError"
DATABASE_AUTH_CODES = ["Neo.ClientError.Security.Unauthorized", "Neo.ClientError.Security.AuthenticationRateLimit"]
DATABASE_GONE_CODES = ["ServiceUnavailable", "SessionExpired"]
DATABASE_TIMEOUT_CODES = ["Neo.ClientError.Transaction.TransactionTimedOut", "Neo.ClientError.Transaction.TransactionTimedOutClientConfiguration"]
DATABASE_CONNECTION, DATABASE_TIMEOUT, DATABASE_UNREACHABLE = "(?i)connection|routing|ECONNREFUSED|ENOTFOUND|certificate|TLS", "(?i)timeout|timed out", "(?i)ECONNREFUSED|ENOTFOUND|EHOSTUNREACH|ETIMEDOUT"
# Words that mark a result's lines worth showing.
RESULT_LINES = "상태:|시드|인용|과잉|그래프에 없는|절단|viewer|delivered"
TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "yclid", "igshid", "mc_cid", "mc_eid", "ref_src", "spm"]
