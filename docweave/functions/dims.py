"""Small policy tables that callers may replace; the defaults are fixed values.

Each function gives a local table whose size Spark knows, so joins with it become broadcasts
while it is small, and a caller's large table is joined by a shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Words that a question's terms leave out.
STOPWORDS = """
a an are can could do does for how i in is me my of on please should the to what where with
از است این آن با برای به باید چی چطوری چطور چگونه در را رو روی شروع شود که کجا کار می میشه من ولی و یا یک کنم کنیم کنید خواهم
""".split()

# Groups of terms that stand for each other, by the term that calls them.
NEXT = ["next.js", "nextjs", "next", "نکست"]
DEPLOY = ["deploy", "deployed", "deployment", "استقرار", "دیپلوی", "مستقر"]
ENVIRONMENT = ["env", "environment", "environment variable", "environment variables", "variable", "variables", "متغیر محیطی", "متغیرهای محیطی"]
BUILD = ["build", "built", "بیلد", "ساخت"]
FAILURE = ["error", "errors", "fail", "failed", "failure", "log", "logs", "logging", "خطا", "مشکل", "لاگ"]
ALIASES = {
    "app": ["application", "برنامه", "پروژه"],
    "application": ["app", "برنامه", "پروژه"],
    "applications": ["app", "application", "برنامه", "پروژه"],
    "project": ["app", "application", "برنامه", "پروژه"],
    "پروژه": ["app", "application", "برنامه"],
    "database": ["دیتابیس"],
    "databases": ["دیتابیس"],
    "deploy": DEPLOY,
    "deployed": DEPLOY,
    "deployment": DEPLOY,
    "استقرار": DEPLOY,
    "دیپلوی": DEPLOY,
    "مستقر": DEPLOY,
    "domain": ["دامنه"],
    "domains": ["دامنه"],
    "email": ["ایمیل"],
    "next.js": NEXT,
    "nextjs": NEXT,
    "next": NEXT,
    "نکست": NEXT,
    "env": ENVIRONMENT,
    "environment": ENVIRONMENT,
    "variable": ENVIRONMENT,
    "variables": ENVIRONMENT,
    "متغیر": ENVIRONMENT,
    "متغیرهای": ENVIRONMENT,
    "محیطی": ENVIRONMENT,
    "build": BUILD,
    "built": BUILD,
    "بیلد": BUILD,
    "log": FAILURE,
    "logging": FAILURE,
    "logs": FAILURE,
    "error": FAILURE,
    "errors": FAILURE,
    "fail": FAILURE,
    "failed": FAILURE,
    "failure": FAILURE,
    "خطا": FAILURE,
    "مشکل": FAILURE,
    "لاگ": FAILURE,
}

# Phrases and patterns of questions that need no retrieval, by intent, in order.
INTENTS = {
    "greeting": ["hello", "hey", "hi", "good morning", "good evening", "سلام", "درود", "سلام علیک", "سلام خوبی", "خوبی"],
    "thanks": ["thanks", "thank you", "thank you very much", "ممنون", "مرسی", "متشکرم", "خیلی ممنون"],
    "acknowledgement": ["باشه", "اوکی", "اوکیه", "ok", "okay", "got it"],
}
GREETING_PATTERN = "^(?:سلام|درود)(?: خوبی)?(?: می ?تونی کمکم کنی)?$"
META_PATTERNS = [
    "^هنوز (?:سوال ?مو|سوالم|سوال را) نگفتم(?: که)?$",
    "^هنوز نگفتم چی می ?خوام(?: که)?$",
    "^می ?تونی کمکم کنی$",
    "^(?:فعلا فقط )?(?:یه|یک) سوال دارم$",
    "^(?:صبر کن|ادامه بده)$",
    "^can you help me$",
    "^i (?:haven t|have not) asked my question yet$",
    "^i have a question$",
    "^(?:wait|continue)$",
]

# Wording that tells a report of trouble, and what it must say to be looked into.
TROUBLE = r"(?i)(?:\b(?:fail(?:ed|ing|s)?|error|broken|stuck|does(?:n['’]?t| not) (?:work|build|deploy|start|run)|won['’]?t|cannot|can['’]?t)\b|خطا|مشکل|کار نمی|نمی[‌ ]?(?:شود|شه|کنه|کند)|ناموفق)"
FRAMEWORK = r"(?i)\b(?:next(?:\.js)?|nuxt(?:\.js)?|react|vue|angular|node(?:\.js)?|python|django|flask|fastapi|php|laravel|go|golang|java|spring|dotnet|\.net|docker|static)\b"
FRAMEWORK_FIELD = r"(?i)Framework/runtime:\s*\S+"
STAGE = r"(?i)\b(?:build|deploy(?:ment)?|runtime)\b|ساخت|بیلد|استقرار|دیپلوی|زمان اجرا"
DETAIL = r"(?:\b(?:exit code|status code|stack trace|traceback|exception|stderr|stdout|log)\b|\b[A-Z][A-Z0-9_]{3,}\b|\b\d{3}\b|```|لاگ|پیام خطا|کد خطا)"

# Frameworks and services that a path names, by category.
FRAMEWORKS = "angular django docker dotnet flask go laravel nextjs nodejs php python react static vue".split()
SERVICES = "elastic-search mariadb mongodb mssql mysql postgresql rabbitmq redis".split()

# The code, HTTP status and retryability of each cause of failure, by phase.
FAILURES = [
    ("invalid_request", "before", "INVALID_INPUT", 400, False),
    ("rate_limit_exceeded", "before", "RATE_LIMITED", 429, True),
    ("model_configuration", "before", "MODEL_UNAVAILABLE", 503, False),
    ("service_configuration", "before", "INTERNAL_ERROR", 500, False),
    ("retrieval_configuration", "before", "RETRIEVAL_FAILED", 503, False),
    ("retrieval", "starting", "RETRIEVAL_FAILED", 503, True),
    ("timeout", "starting", "TIMEOUT", 504, True),
    ("timeout", "streaming", "TIMEOUT", 504, True),
    ("provider_429", "starting", "RATE_LIMITED", 429, True),
    ("provider_429", "streaming", "RATE_LIMITED", 429, True),
    ("provider_408", "starting", "TIMEOUT", 504, True),
    ("provider_504", "starting", "TIMEOUT", 504, True),
    ("provider_5xx", "starting", "MODEL_UNAVAILABLE", 503, True),
    ("provider_5xx", "streaming", "MODEL_UNAVAILABLE", 503, True),
    ("provider_4xx", "starting", "MODEL_UNAVAILABLE", 503, False),
    ("provider_4xx", "streaming", "MODEL_UNAVAILABLE", 503, False),
    ("cancelled", "starting", "STREAM_INTERRUPTED", 500, True),
    ("cancelled", "streaming", "STREAM_INTERRUPTED", 500, True),
]


KINDS = {int: pa.int32(), bool: pa.bool_(), str: pa.string(), float: pa.float64()}


def written(spark: SparkSession, rows: list[tuple], **columns: type) -> DataFrame:
    """A table written out here; Spark knows its size and so decides by it whether to broadcast it."""
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], KINDS[kind]) for k, (name, kind) in enumerate(columns.items())}))


def stopwords(spark: SparkSession, words: list[str] | None = None) -> DataFrame:
    return written(spark, [(w,) for w in (STOPWORDS if words is None else words)], term=str)


def aliases(spark: SparkSession, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of term, place and alias (a text of one or more words)."""
    found = ALIASES if groups is None else groups
    return written(spark, [(t, k, a) for t, own in found.items() for k, a in enumerate(own)], term=str, place=int, alias=str)


def taxonomy(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Rows of category, segment and kind (framework or service)."""
    found = rows if rows is not None else [("paas", f, "framework") for f in FRAMEWORKS] + [("dbaas", s, "service") for s in SERVICES]
    return written(spark, found, category=str, segment=str, kind=str)


def categories(spark: SparkSession, names: list[str]) -> DataFrame:
    return written(spark, [(n,) for n in names], category=str)


def origins(spark: SparkSession, rows: list[tuple[str, str | None]]) -> DataFrame:
    """Hosts that links may name, with the path that they must lie under, if any."""
    return written(spark, rows, host=str, path_prefix=str)


def intents(spark: SparkSession) -> DataFrame:
    return written(spark, [(p, i, k) for k, (i, own) in enumerate(INTENTS.items()) for p in own], phrase=str, intent=str, turn=int)


def failures(spark: SparkSession) -> DataFrame:
    return written(spark, FAILURES, cause=str, phase=str, code=str, status=int, retryable=bool)


def prices(spark: SparkSession, rows: list[tuple[str, str, float, float]]) -> DataFrame:
    """Prices of a token that goes in and of one that comes out, by provider and model."""
    return written(spark, rows, provider=str, model=str, input_price=float, output_price=float)
