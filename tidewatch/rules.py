"""Rule tables.

Everything in this module is a fixed value: results are only right when these
lists, numbers and patterns are exactly these. They are plain text in natural
order; the logic that applies them lives in ``functions`` and ``operators``.

Regular expressions are for the JVM engine. ``(?U)`` makes ``\\s \\d \\w \\b``
Unicode-aware and ``(?d)`` makes ``\\n`` the only line end.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Scoring and workflow constants
# --------------------------------------------------------------------------
SLA_HOURS = {"CRITICAL": 24, "HIGH": 72, "MEDIUM": 168, "LOW": 720}
SLA_HOURS_DEFAULT = 720
SECTOR_WEIGHT = {
    "GOVERNMENT": "1.5",
    "HEALTHCARE": "1.4",
    "FINANCE": "1.4",
    "EDUCATION": "1.1",
    "RESEARCH": "1.2",
    "OTHER": "1.0",
}
VENDOR_RISK = {
    "wordpress": "1.3",
    "joomla": "1.3",
    "drupal": "1.1",
    "nic egov": "1.2",
    "spring boot": "1.1",
}
RESCAN_TTL_DAYS = {
    "GOVERNMENT": 7,
    "HEALTHCARE": 7,
    "FINANCE": 7,
    "EDUCATION": 14,
    "RESEARCH": 14,
    "OTHER": 30,
}
RESCAN_TTL_DEFAULT = 30
NEXT_SCAN_DAYS_FAST = 7
NEXT_SCAN_DAYS = 30
FAST_SCAN_SECTORS = ("GOVERNMENT", "EDUCATION")
SCORE_THRESHOLD = 50
MIN_SIGNALS = 2
ESCALATION_WAIT_HOURS = 72
DISCLOSURE_WINDOW_HOURS = 24
ENTROPY_CUT = 3.5
CONTACT_MAILBOXES = ("security", "abuse", "cert", "webmaster")

# --------------------------------------------------------------------------
# False-positive phrase lists
# --------------------------------------------------------------------------
# A body of up to so many characters may be an error message in plain words; a longer one has to be a page to be one.
ERROR_TEXT_CHARS = 8000
# A page begins with one of these, or has a fifth of its text in tags (a twentieth if it is served as HTML).
PAGE_STARTS = ("<!doctype html", "<html", "<head", "<body")
PAGE_TAG_SHARE = 5
TYPED_PAGE_TAG_SHARE = 20
FIREWALL_PHRASES = (
    "cloudflare",
    "ray id:",
    "cf-ray:",
    "cloudfront",
    "access denied | akamai",
    "incapsula incident id",
    "sucuri website firewall",
    "barracuda networks",
    "your ip has been blocked",
    "suspicious activity detected",
    "ddos protection by",
    "error 1020",
    "error 1006",
)
SOFT_404_PHRASES = (
    "page not found",
    "404 not found",
    "file not found",
    "does not exist",
    "no such file",
    "not available",
    "access denied",
    "permission denied",
    "403 forbidden",
    "you do not have permission",
    "unauthorized",
    "login required",
    "please log in",
    "sign in to continue",
    "session expired",
    "authentication required",
    "error occurred",
    "something went wrong",
    "this page is protected",
    "restricted access",
    "the page you requested",
    "the page you are looking for",
)
HTML_MARKERS = ("<!doctype html", "<html", "<head>", "<body>", "<title>", "<meta ")
LOGIN_MARKERS = (
    'type="password"',
    "type='password'",
    'name="password"',
    "name='password'",
    "forgot password",
    "remember me",
    "keep me logged in",
)
RAW_FILE_ENTITIES = ("ENV_FILE", "GIT_REPO", "PRIVATE_KEY", "DATABASE_DUMP", "API_KEY")
GENERIC_RAW_ENTITIES = ("GIT_REPO", "ENV_FILE", "PRIVATE_KEY")

# --------------------------------------------------------------------------
# Path rules
# columns: path, severity, entity, finding type, validator
# --------------------------------------------------------------------------
_PATH_RULES = """
/.env                          CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/.env.backup                   CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/.env.production               CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/.env.prod                     CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/.env.local                    CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/.env.staging                  CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/.env.dev                      CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/.env.old                      CRITICAL  ENV_FILE        ENV_BACKUP_EXPOSED       env
/.env.bak                      CRITICAL  ENV_FILE        ENV_BACKUP_EXPOSED       env
/.env~                         CRITICAL  ENV_FILE        ENV_BACKUP_EXPOSED       env
/.env.example                  HIGH      ENV_FILE        ENV_TEMPLATE_EXPOSED     env
/env                           CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/config.env                    CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/env.txt                       HIGH      ENV_FILE        ENV_TEXT_EXPOSED         env
/app/.env                      CRITICAL  ENV_FILE        ENV_FILE_EXPOSED         env
/.git/HEAD                     CRITICAL  GIT_REPO        GIT_REPO_EXPOSED         git
/.git/config                   CRITICAL  GIT_REPO        GIT_REPO_EXPOSED         git
/.git/COMMIT_EDITMSG           CRITICAL  GIT_REPO        GIT_REPO_EXPOSED         git
/.git/logs/HEAD                CRITICAL  GIT_REPO        GIT_REPO_EXPOSED         git
/.git/refs/heads/main          CRITICAL  GIT_REPO        GIT_REPO_EXPOSED         git
/.git/refs/heads/master        CRITICAL  GIT_REPO        GIT_REPO_EXPOSED         git
/.git/objects/pack/            CRITICAL  GIT_REPO        GIT_PACK_EXPOSED         git
/id_rsa                        CRITICAL  PRIVATE_KEY     PRIVATE_KEY_EXPOSED      key
/.ssh/id_rsa                   CRITICAL  PRIVATE_KEY     PRIVATE_KEY_EXPOSED      key
/server.key                    CRITICAL  PRIVATE_KEY     PRIVATE_KEY_EXPOSED      key
/private.key                   CRITICAL  PRIVATE_KEY     PRIVATE_KEY_EXPOSED      key
/private.pem                   CRITICAL  PRIVATE_KEY     PRIVATE_KEY_EXPOSED      key
/ssl/server.key                CRITICAL  PRIVATE_KEY     PRIVATE_KEY_EXPOSED      key
/cert/privkey.pem              CRITICAL  PRIVATE_KEY     PRIVATE_KEY_EXPOSED      key
/.aws/credentials              CRITICAL  AWS_CREDS       AWS_CREDENTIALS_EXPOSED  aws
/.aws/config                   HIGH      AWS_CONFIG      AWS_CONFIG_EXPOSED       config
/azureProfile.json             CRITICAL  AZURE_CREDS     AZURE_PROFILE_EXPOSED    json
/latest/meta-data/             CRITICAL  CLOUD_METADATA  AWS_METADATA_EXPOSED     metadata
/computeMetadata/v1/           CRITICAL  CLOUD_METADATA  GCP_METADATA_EXPOSED     metadata
/.kube/config                  CRITICAL  KUBE_CONFIG     KUBECONFIG_EXPOSED       kube
/kubeconfig                    CRITICAL  KUBE_CONFIG     KUBECONFIG_EXPOSED       kube
/heapdump.hprof                CRITICAL  MEMORY_DUMP     JAVA_HEAPDUMP_EXPOSED    binary
/core                          CRITICAL  MEMORY_DUMP     CORE_DUMP_EXPOSED        binary
/actuator/heapdump             CRITICAL  SPRING_BOOT     HEAPDUMP_EXPOSED         binary
/actuator/env                  CRITICAL  SPRING_BOOT     SPRING_ENV_EXPOSED       json
/actuator/mappings             HIGH      SPRING_BOOT     SPRING_MAPPINGS_EXPOSED  json
/actuator/beans                HIGH      SPRING_BOOT     SPRING_BEANS_EXPOSED     json
/actuator/health               MEDIUM    SPRING_BOOT     SPRING_HEALTH_EXPOSED    json
/.bash_history                 CRITICAL  SHELL_HISTORY   BASH_HISTORY_EXPOSED     shell
/backup.sql                    HIGH      DATABASE_DUMP   DATABASE_DUMP_EXPOSED    sql
/dump.sql                      HIGH      DATABASE_DUMP   DATABASE_DUMP_EXPOSED    sql
/db.sql                        HIGH      DATABASE_DUMP   DATABASE_DUMP_EXPOSED    sql
/database.sql                  HIGH      DATABASE_DUMP   DATABASE_DUMP_EXPOSED    sql
/mysqldump.sql                 HIGH      DATABASE_DUMP   DATABASE_DUMP_EXPOSED    sql
/db_backup.sql                 HIGH      DATABASE_DUMP   DATABASE_DUMP_EXPOSED    sql
/backup.zip                    HIGH      DATABASE_DUMP   BACKUP_EXPOSED           sql
/backup.tar.gz                 HIGH      DATABASE_DUMP   BACKUP_EXPOSED           sql
/site_backup.zip               HIGH      DATABASE_DUMP   BACKUP_EXPOSED           sql
/www.zip                       HIGH      DATABASE_DUMP   BACKUP_EXPOSED           sql
/wp-config.php                 HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/wp-config.php.bak             HIGH      CONFIG_FILE     CONFIG_BACKUP_EXPOSED    config
/wp-config.php.save            HIGH      CONFIG_FILE     CONFIG_BACKUP_EXPOSED    config
/wp-config.txt                 HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/config.php                    HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/config.php.bak                HIGH      CONFIG_FILE     CONFIG_BACKUP_EXPOSED    config
/configuration.php             HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/config/database.yml           HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/database.yml                  HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/web.config                    HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/config.yml                    HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/config.yaml                   HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/application.yml               HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/application.properties        HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/settings.py                   HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/local_settings.py             HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/appsettings.json              HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/appsettings.Production.json   HIGH      CONFIG_FILE     CONFIG_FILE_EXPOSED      config
/docker-compose.yml            HIGH      CONFIG_FILE     DOCKER_COMPOSE_EXPOSED   config
/index.php~                    HIGH      SOURCE_CODE     SOURCE_BACKUP_EXPOSED    none
/phpmyadmin/                   HIGH      ADMIN_PANEL     ADMIN_PANEL_EXPOSED      admin
/phpmyadmin                    HIGH      ADMIN_PANEL     ADMIN_PANEL_EXPOSED      admin
/pma/                          HIGH      ADMIN_PANEL     ADMIN_PANEL_EXPOSED      admin
/adminer.php                   HIGH      ADMIN_PANEL     ADMIN_PANEL_EXPOSED      admin
/.svn/entries                  HIGH      GIT_REPO        SVN_REPO_EXPOSED         none
/.svn/wc.db                    HIGH      GIT_REPO        SVN_REPO_EXPOSED         none
/storage/framework/sessions/   HIGH      SESSION_DATA    SESSION_EXPOSED          directory
/.github/workflows/            MEDIUM    CI_CONFIG       GITHUB_ACTIONS_EXPOSED   directory
/.gitlab-ci.yml                MEDIUM    CI_CONFIG       GITLAB_CI_EXPOSED        none
/phpinfo.php                   MEDIUM    CONFIG_FILE     PHPINFO_EXPOSED          phpinfo
/info.php                      MEDIUM    CONFIG_FILE     PHPINFO_EXPOSED          phpinfo
/test.php                      MEDIUM    CONFIG_FILE     PHPINFO_EXPOSED          phpinfo
/.htpasswd                     MEDIUM    CONFIG_FILE     HTPASSWD_EXPOSED         config
/.DS_Store                     MEDIUM    CONFIG_FILE     DS_STORE_EXPOSED         dsstore
/error_log                     MEDIUM    OTHER           ERROR_LOG_EXPOSED        log
/error.log                     MEDIUM    OTHER           ERROR_LOG_EXPOSED        log
/debug.log                     MEDIUM    OTHER           DEBUG_LOG_EXPOSED        log
/application.log               MEDIUM    OTHER           ERROR_LOG_EXPOSED        log
/logs/error.log                MEDIUM    OTHER           ERROR_LOG_EXPOSED        log
/storage/logs/laravel.log      MEDIUM    OTHER           ERROR_LOG_EXPOSED        log
/backup/                       HIGH      OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/backups/                      HIGH      OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/export/                       HIGH      OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/uploads/                      MEDIUM    OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/files/                        MEDIUM    OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/data/                         MEDIUM    OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/temp/                         MEDIUM    OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/tmp/                          MEDIUM    OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/reports/                      MEDIUM    OPEN_DIRECTORY  OPEN_DIRECTORY_LISTING   directory
/composer.json                 LOW       CONFIG_FILE     COMPOSER_EXPOSED         none
/composer.lock                 LOW       CONFIG_FILE     COMPOSER_EXPOSED         none
/package.json                  LOW       CONFIG_FILE     PACKAGE_JSON_EXPOSED     none
/requirements.txt              LOW       CONFIG_FILE     REQUIREMENTS_EXPOSED     none
/Gemfile                       LOW       CONFIG_FILE     GEMFILE_EXPOSED          none
"""


@dataclass(frozen=True)
class PathRule:
    path: str
    severity: str
    entity: str
    finding_type: str
    validator: str


PATH_RULES = tuple(PathRule(*line.split()) for line in _PATH_RULES.strip().splitlines())

# Lengths that the binary and DS_Store validators compare with, in characters. Markup in the first
# BINARY_HEAD_CHARS shows that a page was sent instead of a dump; what follows in a dump may hold markup of its own.
BINARY_HEAD_CHARS = 200
HEAP_DUMP_CHARS = 1_000
CORE_DUMP_CHARS = 10_000
DS_STORE_CHARS = 100_000


# --------------------------------------------------------------------------
# Content rules (personal data and secrets)
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class ContentRule:
    """One content rule.

    The gate is a cheap condition on the uncleaned text that must hold before the
    pattern is tried: one of ``gate_contains``, or ``gate_rlike``, which always
    implies a run of four digits. Cleaning only replaces text by spaces, so it
    cannot create what a gate looks for.
    ``value_group`` is the group whose text is checked and hashed.
    ``local``: whatever the rule finds or masks has a digit or an @, and white space in
    it stands directly before a digit; see ``functions.text.split_marked``.
    """

    name: str
    entity: str
    severity: str
    pattern: str
    keywords: tuple[str, ...] = ()
    min_occurrences: int = 1
    check: str | None = None
    require_keyword: bool = False
    digits: bool = False
    value_group: int = 0
    gate_contains: tuple[str, ...] = ()
    gate_rlike: str | None = None
    local: bool = False


CONTENT_RULES = (
    ContentRule(
        "AADHAAR",
        "AADHAAR",
        "CRITICAL",
        r"(?U)(?<!\d)[2-9]\d{3}(?:[\s \-]\d{4}[\s \-]\d{4}|\d{8})(?!\d)",
        keywords=(
            "aadhaar",
            "aadhar",
            "uid no",
            "uid:",
            "uidai",
            "unique identification",
            "enrolment no",
            "enrollment no",
            "आधार",
        ),
        check="verhoeff",
        require_keyword=True,
        digits=True,
        gate_rlike=r"[2-9]\p{Nd}{3}",
        local=True,
    ),
    ContentRule(
        "PAN",
        "PAN",
        "CRITICAL",
        r"(?U)\b[A-Z]{5}[0-9]{4}[A-Z]\b",
        keywords=("pan", "permanent account", "income tax", "pan card"),
        gate_rlike="[A-Z]{5}[0-9]{4}[A-Z]",
        local=True,
    ),
    ContentRule(
        "VOTER_ID",
        "VOTER_ID",
        "HIGH",
        r"(?U)\b[A-Z]{3}[0-9]{7}\b",
        keywords=("voter", "election", "epic", "electoral", "booth"),
        min_occurrences=2,
        gate_rlike="[A-Z]{3}[0-9]{7}",
        local=True,
    ),
    ContentRule(
        "DRIVING_LICENSE",
        "DRIVING_LICENSE",
        "HIGH",
        r"(?U)\b[A-Z]{2}\d{2}\s?\d{4}\s?\d{7}\b",
        keywords=("driving", "dl number", "license", "licence"),
        digits=True,
        gate_rlike=r"\p{Nd}{7}",
        local=True,
    ),
    ContentRule(
        "ABHA_ID",
        "ABHA_ID",
        "HIGH",
        r"(?U)\b\d{2}-\d{4}-\d{4}-\d{4}\b",
        keywords=("abha", "health id", "ndhm", "abdm", "ayushman"),
        digits=True,
        gate_rlike=r"\p{Nd}{2}-\p{Nd}{4}-",
        local=True,
    ),
    ContentRule(
        "INDIAN_PASSPORT",
        "PASSPORT",
        "CRITICAL",
        r"(?U)\b[A-PR-WYa-pr-wy][0-9]{7}\b",
        keywords=("passport", "travel", "immigration", "visa"),
        gate_rlike="[A-Za-z][0-9]{7}",
        local=True,
    ),
    ContentRule(
        "AWS_ACCESS_KEY",
        "AWS_KEY",
        "CRITICAL",
        r"(?U)\bAKIA[0-9A-Z]{16}\b",
        keywords=("aws", "access_key", "secret", "amazon"),
        gate_contains=("AKIA",),
    ),
    ContentRule(
        "STRIPE_LIVE_KEY",
        "STRIPE_KEY",
        "CRITICAL",
        r"(?U)\bsk_live_[0-9a-zA-Z]{24,}\b",
        keywords=("stripe", "payment"),
        gate_contains=("sk_live_",),
    ),
    ContentRule(
        "PRIVATE_KEY_BLOCK",
        "PRIVATE_KEY",
        "CRITICAL",
        r"-----BEGIN (RSA|EC|OPENSSH|DSA)? ?PRIVATE KEY-----",
        gate_contains=("-----BEGIN",),
    ),
    ContentRule(
        "GENERIC_SECRET_FIELD",
        "SECRET_FIELD",
        "HIGH",
        r'(?Ud)"(password|passwd|secret|api[_-]?key|access[_-]?token)"\s*:\s*".{6,}"',
        gate_contains=('password"', 'passwd"', 'secret"', 'key"', 'token"'),
    ),
    ContentRule(
        "INDIAN_PHONE",
        "PHONE_NUMBER",
        "LOW",
        r"(?U)\b(?:\+91|0091|91)?[\s\-]?[6-9]\d{9}\b",
        keywords=("mobile", "phone", "contact", "helpline"),
        min_occurrences=15,
        digits=True,
        gate_rlike=r"[6-9]\p{Nd}{9}",
        local=True,
    ),
)

# Off by default: too noisy without a structured source.
OPTIONAL_CONTENT_RULES = (
    ContentRule(
        "CREDIT_CARD",
        "CREDIT_CARD",
        "CRITICAL",
        r"(?U)\b[0-9]{4}(?:[\s\-]?[0-9]{4}){3}\b",
        keywords=("card", "credit", "debit", "visa", "mastercard", "rupay"),
        check="luhn",
        digits=True,
        gate_rlike="[0-9]{4}",
        local=True,
    ),
    ContentRule(
        "GENERIC_API_KEY",
        "API_KEY",
        "HIGH",
        r"(?U)\b(?:api[_-]?key|token|secret)\b\s*[=:]\s*[\"']?([A-Za-z0-9_\-]{16,})",
        keywords=("api", "key", "token"),
        check="entropy",
        value_group=1,
        gate_contains=("key", "token", "secret"),
    ),
    ContentRule(
        "BANK_ACCOUNT",
        "BANK_ACCOUNT",
        "HIGH",
        r"(?U)\b[0-9]{9,18}\b",
        keywords=("account no", "account number", "a/c no", "ifsc"),
        require_keyword=True,
        digits=True,
        gate_rlike="[0-9]{9}",
        local=True,
    ),
    ContentRule(
        "UPI_ID",
        "UPI_ID",
        "MEDIUM",
        r"(?U)\b[A-Za-z0-9._\-]{2,64}@[A-Za-z]{3,20}\b(?![.@])",
        keywords=("upi", "vpa", "bhim"),
        require_keyword=True,
        gate_contains=("@",),
        local=True,
    ),
    ContentRule(
        "EMAIL",
        "EMAIL",
        "LOW",
        r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
        keywords=("email", "e-mail", "contact"),
        gate_contains=("@",),
        local=True,
    ),
)

# What masking removes where it is wider than the detection pattern: the body of
# a key block and everything a quoted credential holds.
MASK_OVERRIDES = {
    "PRIVATE_KEY_BLOCK": r"(?s)-----BEGIN[A-Z ]*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END[A-Z ]*-----|\z)",
    "GENERIC_SECRET_FIELD": r'(?U)"(?:password|passwd|secret|api[_-]?key|access[_-]?token)"\s*:\s*"[^"\n]*"?',
    "INDIAN_PHONE": r"(?U)(?:\+91|0091|91)?[\s\-]?[6-9]\d{9}(?!\d)",
    "GENERIC_API_KEY": r"(?Ui)\b(?:api[_-]?key|token|secret)\b\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{8,}",
}

# --------------------------------------------------------------------------
# Country-origin score
# --------------------------------------------------------------------------
PILOT_TLDS = (".gov.in", ".nic.in", ".edu.in", ".ac.in", ".res.in")
COUNTRY_TLDS = (
    ".gov.in",
    ".nic.in",
    ".edu.in",
    ".ac.in",
    ".res.in",
    ".in",
    ".co.in",
    ".net.in",
    ".org.in",
    ".gen.in",
    ".firm.in",
    ".ind.in",
    ".mil.in",
    ".int.in",
)
OTHER_TLDS = (".com", ".org", ".net")
DEFAULT_TLD = ".in"
GOVERNMENT_TLDS = (".gov.in", ".nic.in")
HOME_COUNTRY = "India"
HOME_ASNS = (
    "AS9829",
    "AS45609",
    "AS24560",
    "AS18101",
    "AS55836",
    "AS17813",
    "AS17762",
    "AS45271",
    "AS55923",
    "AS4755",
    "AS6453",
    "AS38266",
    "AS132717",
    "AS45820",
)
ORIGIN_POINTS = {
    "tld": 40,
    "pilot_tld_bonus": 10,
    "ip_geo_india": 20,
    "indian_asn": 10,
    "devanagari_content": 15,
    "hindi_meta": 10,
    "indian_phone": 15,
    "gst_number": 15,
    "payment_gateway": 15,
}
ORIGIN_PATTERNS = {
    "devanagari_content": "[ऀ-ॿ]{4,}",
    "hindi_meta": r"(?id)lang=[\"']hi[\"']|content-language.*hi",
    "indian_phone": r"(?U)(?:\+91|0)[6-9]\d{9}\b",
    "gst_number": r"(?U)\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z0-9]\b",
    "payment_gateway": r"(?i)razorpay|paytm\.com|cashfree|payu\.in|ccavenue|instamojo|billdesk|easebuzz",
}

# --------------------------------------------------------------------------
# Sector keywords, first sector with a hit wins
# --------------------------------------------------------------------------
SECTOR_KEYWORDS = {
    "GOVERNMENT": ("gov", "nic", "ministry", "dept", "department", "mca", "india.gov", "mygov", "dpiit", "ncert", "niti", "pib"),
    "EDUCATION": ("edu", "ac.in", "university", "college", "school", "iit", "nit", "iisc", "jnu", "iim", "du.", "mu.", "amu", "bhu"),
    "HEALTHCARE": ("health", "hospital", "medical", "aiims", "pgimer", "nhm", "mohfw", "nha", "pmjay", "clinic", "pharma"),
    "FINANCE": ("bank", "finance", "nbfc", "rbi", "sebi", "irdai", "pfrda", "sbi.", "hdfc", "icici", "axis", "kotak", "npci", "upi"),
    "RESEARCH": ("res.in", "csir", "isro", "drdo", "icar", "icmr", "barc"),
}
DEFAULT_SECTOR = "OTHER"
# Keywords that count at either end of a compound host label as well.
COMPOUND_SECTOR_WORDS = (
    "ministry", "university", "college", "school", "health", "hospital", "medical", "clinic", "pharma", "bank", "finance",
)


# --------------------------------------------------------------------------
# Vendor signatures, first signature with enough signals wins
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class VendorSignature:
    """``gates`` are lower-case literals, one of which every signal needs."""

    vendor: str
    risk: str
    gates: tuple[str, ...]
    signals: tuple[str, ...]
    version: str | None = None
    min_signals: int = 1


VENDOR_SIGNATURES = (
    VendorSignature(
        "WordPress",
        "HIGH",
        ("wordpress", "/wp-content/", "/wp-includes/", "wp-json/wp/v"),
        (
            r"/wp-content/(?:themes|plugins|uploads)/",
            r"/wp-includes/",
            r"wp-json/wp/v",
            r"(?i)<meta[^>]+generator[^>]+WordPress",
            r"(?i)wordpress",
        ),
        r"(?i)WordPress[/ ]([0-9.]+)",
    ),
    VendorSignature(
        "Joomla",
        "HIGH",
        ("joomla", "/components/com_", "/media/jui/", "/media/system/js/"),
        (
            r"/components/com_[a-z]",
            r"/media/jui/",
            r"/media/system/js/",
            r"(?i)<meta[^>]+generator[^>]+Joomla",
            r"(?i)joomla",
        ),
        r"(?i)Joomla[!/ ]([0-9.]+)",
    ),
    VendorSignature(
        "Drupal",
        "MEDIUM",
        ("drupal", "/sites/"),
        (
            r"Drupal\.settings",
            r"/sites/(?:default|all)/(?:files|modules|themes)/",
            r"(?i)<meta[^>]+generator[^>]+Drupal",
            r"(?i)drupal",
        ),
        r"(?i)Drupal[/ ]([0-9.]+)",
    ),
    VendorSignature(
        "NIC-eGov",
        "MEDIUM",
        ("national informatics centre", "egov", "portal"),
        (
            r"(?i)National Informatics Centre",
            r"(?iU)eGov(?:ernance)?\s+Framework",
            r"(?iU)NIC\s+(?:eGov|Portal)",
        ),
    ),
    VendorSignature(
        "Spring-Boot",
        "MEDIUM",
        ("whitelabel error page", "/actuator", "spring framework"),
        (r"Whitelabel Error Page", r"/actuator(?:/health)?", r"(?i)Spring Framework"),
        r"(?i)Spring-Boot[/ ]([0-9.]+)",
    ),
    VendorSignature(
        "Struts",
        "HIGH",
        (".action", "struts"),
        (r"(?d)\.action(\?|$)", r"(?i)struts", r"(?i)org\.apache\.struts"),
        r"(?i)Struts[/ ]([0-9.]+)",
        min_signals=2,
    ),
    VendorSignature(
        "Magento",
        "HIGH",
        ("/skin/frontend/", "mage.", "magento"),
        (r"/skin/frontend/", r"Mage\.", r"(?i)magento"),
        r"(?i)Magento[/ ]([0-9.]+)",
    ),
    VendorSignature("Django", "LOW", ("csrfmiddlewaretoken", "django"), (r"csrfmiddlewaretoken", r"(?i)django"), min_signals=2),
    VendorSignature(
        "Laravel",
        "LOW",
        ("laravel",),
        (r"laravel_session", r"(?id)X-Powered-By.*Laravel", r"(?i)laravel"),
        r"(?i)Laravel[/ ]([0-9.]+)",
    ),
    VendorSignature(
        "ASP.NET",
        "LOW",
        ("__viewstate", "__eventvalidation", ".aspx", "x-aspnet-version"),
        (r"__VIEWSTATE", r"__EVENTVALIDATION", r"(?id)\.aspx(\?|$|#)", r"(?i)X-AspNet-Version"),
        r"(?i)ASP\.NET[/ ]([0-9.]+)",
    ),
    VendorSignature("PHP", "LOW", ("php/",), (r"(?i)PHP/[0-9.]+",), r"(?i)PHP/([0-9.]+)"),
    VendorSignature(
        "OpenCart",
        "MEDIUM",
        ("/catalog/view/theme/", "route=common/home"),
        (r"/catalog/view/theme/", r"route=common/home"),
        r"(?i)OpenCart[/ ]([0-9.]+)",
    ),
    VendorSignature("TYPO3", "MEDIUM", ("typo3",), (r"(?i)typo3", r"/typo3conf/"), r"(?i)TYPO3[/ ]([0-9.]+)"),
)

# --------------------------------------------------------------------------
# Seed names used for a TLD whose certificate feed is empty
# --------------------------------------------------------------------------
SEED_NAMES = {
    ".gov.in": (
        "india.gov.in", "mygov.in", "uidai.gov.in", "meity.gov.in", "mca.gov.in", "incometax.gov.in", "gst.gov.in",
        "epfindia.gov.in", "nha.gov.in", "mohfw.gov.in", "education.gov.in", "pib.gov.in", "dpiit.gov.in",
    ),
    ".nic.in": ("nic.in", "services.nic.in"),
    ".edu.in": ("iit.edu.in",),
    ".ac.in": ("du.ac.in", "iisc.ac.in", "jnu.ac.in", "iitb.ac.in", "iitd.ac.in"),
    ".res.in": ("csir.res.in", "isro.res.in"),
    ".in": ("flipkart.com", "myntra.com", "snapdeal.com"),
    ".co.in": ("airtel.co.in", "bsnl.co.in"),
}

# --------------------------------------------------------------------------
# Passive-name feeds: source, payload shape, needs a key
# --------------------------------------------------------------------------
FEEDS = (
    ("crt.sh", "ct", False),
    ("AlienVault", "passive_dns", False),
    ("HackerTarget", "csv_lines", False),
    ("RapidDNS", "html_cells", False),
    ("BufferOver", "csv_in_json", False),
    ("ThreatCrowd", "plain_names", False),
    ("Shodan", "labels", True),
    ("Censys", "nested_names", True),
    ("ZoomEye", "list_name", True),
    ("SecurityTrails", "labels", True),
    ("VirusTotal", "data_id", True),
    ("BinaryEdge", "events", True),
    ("WhoisXML", "records_domain", True),
    ("Chaos", "labels", True),
)
