"""Column builders for text: normal forms, tokens, hashes, redaction, checks. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN = "[a-z0-9][a-z0-9._+#/:-]*"
CJK = "[㐀-䶿一-鿿豈-﫿]"
#: Python's str.strip() set that occurs in practice, for trim().
BLANKS = " \t\n\r\x0b\x0c"
#: Code points that the compatibility form may change, alone or by what stands before them; all others stay as they are.
UNSETTLED = "[\\x{A0}\\x{A8}\\x{AA}\\x{AF}\\x{B2}-\\x{B5}\\x{B8}-\\x{BA}\\x{BC}-\\x{BE}\\x{132}-\\x{3040}\\x{3097}-\\x{33FF}\\x{A640}-\\x{ABFF}\\x{D7B0}-\\x{10FFFF}]"


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form, by the JVM; texts without an UNSETTLED code point are passed through."""
    formed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(UNSETTLED), formed).otherwise(text)


def normalize(text: Column) -> Column:
    """The compatibility form in lower case."""
    return F.lower(nfkc(text))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def latin_tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(LATIN), F.lit(0))


def cjk_tokens(normal: Column, ngram: int = 2) -> Column:
    """Single characters of each run, then its n-grams for n = 2 .. ngram."""

    def grams_of(run: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1)))
        return F.when(F.length(run) >= n, F.transform(at, lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def of_run(run: Column) -> Column:
        grams = [F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))]
        for n in range(2, ngram + 1):
            grams.append(grams_of(run, n))
        return reduce(F.concat, grams)

    runs = F.regexp_extract_all(normal, F.lit(CJK + "+"), F.lit(0))
    return F.when(normal.rlike(CJK), F.flatten(F.transform(runs, of_run))).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column, ngram: int = 2) -> Column:
    """All Latin tokens in order, then all CJK tokens."""
    normal = normalize(text)
    return F.concat(latin_tokens(normal), cjk_tokens(normal, ngram))


def strip_ws(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def query_hash(query: Column) -> Column:
    return F.sha2(collapse_ws(query).cast("binary"), 256)


def cache_key(version: Column, mode: Column, rewrite: Column, k: Column, query: Column) -> Column:
    return F.concat(F.lit("rag:retrieval:v"), F.concat_ws(":", version.cast("string"), mode, rewrite, k.cast("string"), query_hash(query)))


# What is taken out of messages, in this order.
REDACTIONS = (
    (r"sk-[A-Za-z0-9_-]{8,}", "sk-***"),
    (r"(?i)bearer\s+[A-Za-z0-9._-]{8,}", "Bearer ***"),
    (r"(?i)\b(api[_-]?key|token|secret|password|passwd)\b\s*[:=]\s*\S+", "$1=***"),
    (r"gh[pousr]_[A-Za-z0-9]{16,}", "gh* ***"),
    (r"AKIA[0-9A-Z]{16}", "AKIA***"),
)


def safe_message(text: Column, limit: int = 200) -> Column:
    """One line without control characters and secrets, at most ``limit`` characters."""
    line = strip(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "))
    for pattern, put in REDACTIONS:
        line = F.regexp_replace(line, pattern, put)
    line = collapse_ws(line)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))).otherwise(line)


def valid_request_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._:-]{1,64}\z"), F.lit(False))


def normalize_session(value: Column) -> Column:
    """Stripped session id; null unless it has 1 to 128 characters."""
    s = strip(value)
    return F.when(F.length(s).between(1, 128), s)


def normalize_mode(value: Column) -> Column:
    m = F.lower(strip(value))
    return F.when(m.isin("rag", "chat"), m).otherwise("rag")


def retrieval_mode(value: Column) -> Column:
    m = F.lower(strip(value))
    return F.when(m.isin("dense", "bm25", "hybrid"), m).otherwise("bm25")


def source_group(source: Column) -> Column:
    head = F.split_part(source, F.lit("__"), F.lit(1))
    return F.when(F.coalesce(source, F.lit("")) == "", "?").when(head == "", source).otherwise(head)


# Words that a keyword list does not need.
TERM_STOPWORDS = ("关键词", "查询", "用户", "问题", "以下", "一个", "什么", "怎么", "如何", "的", "了")
TERM_EDGES = "：:。.「」\"'*-#"


def parse_terms(raw: Column, most: int = 8) -> Column:
    """Keywords of a free answer: split, edges off, no short ones or stop-words, each once, the first ``most``."""
    pieces = F.transform(F.split(raw, r"[\s,，、;；/|]+"), lambda p: F.btrim(p, F.lit(TERM_EDGES)))
    return F.slice(F.array_distinct(F.filter(pieces, lambda t: (F.length(t) >= 2) & ~t.isin(*TERM_STOPWORDS))), 1, most)


def json_object(text: Column) -> Column:
    """From the first { to the last } after code fences are off; null if there is none."""
    plain = F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    found = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def clip_score(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# What a refusal says.
REFUSALS = ("无法确定", "无法从", "无法根据", "没有相关", "未提供", "未提及", "没有足够", "无法得知", "不知道", "不清楚")


def refusal_flag(answer: Column, patterns: tuple[str, ...] = REFUSALS) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(answer, F.lit("")).contains(p) for p in patterns))


def basic_correct(answer: Column, reference: Column) -> Column:
    """The reference as a whole, or else its first three words of two characters or more, stand in the answer."""
    ref, pred = strip_ws(reference), strip_ws(answer)
    found = F.filter(F.regexp_extract_all(ref, F.lit(r"[a-z0-9.+#_-]+|[一-鿿]{2,}"), F.lit(0)), lambda t: F.length(t) >= 2)
    first = F.slice(found, 1, 3)
    return (ref != "") & (pred.contains(ref) | ((F.size(first) > 0) & F.forall(first, lambda t: pred.contains(t))))


def char_overlap(question: Column, evidence: Column) -> Column:
    """Share of the question's characters (blanks aside) that stand in the evidence."""
    q, e = strip_ws(question), strip_ws(evidence)
    chars = F.regexp_extract_all(q, F.lit("(?s)."), F.lit(0))
    return F.when(q == "", 0.0).otherwise(F.size(F.filter(chars, lambda c: e.contains(c))) / F.length(q))


def char_containment(content: Column, evidence: Column) -> Column:
    c, e = strip_ws(content), strip_ws(evidence)
    return F.when(e == "", 0.0).when(c.contains(e), 1.0).otherwise(char_overlap(e, c))


def token_containment(content_tokens: Column, evidence_tokens: Column) -> Column:
    """Share of the evidence's distinct tokens that the content has."""
    e = F.array_distinct(evidence_tokens)
    return F.when(F.size(e) == 0, 0.0).otherwise(F.size(F.array_intersect(e, content_tokens)) / F.size(e))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def format_value(value: Column, limit: int = 120) -> Column:
    """A value of a log line: quoted if it has blanks or quotes, cut if it is long."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(value.isNull(), "-").when(value.rlike('[ \\t\\r\\n"]'), quoted).when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - 3), F.lit("..."))).otherwise(value)


def format_event(fields: dict[str, Column]) -> Column:
    return F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), format_value(v)) for k, v in fields.items()))


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.coalesce(data, F.lit("")), F.lit("\n\n"))


def sse_events(streams: DataFrame, text: str) -> DataFrame:
    """The rows with seq, event and data of each frame of a stream's text; comments are skipped, data lines of a frame joined, the event of a frame without one is message."""
    frames = F.filter(F.split(F.col(text), r"\r?\n\r?\n"), lambda f: f.rlike("(?m)^data:"))
    field = lambda f, name: F.regexp_extract_all(f, F.lit(rf"(?m)^{name}:[ ]?(.*)$"), F.lit(1))
    parsed = F.transform(frames, lambda f: F.struct(F.coalesce(F.try_element_at(field(f, "event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(field(f, "data"), "\n").alias("data")))
    return streams.select("*", F.posexplode(parsed).alias("seq", "x")).select(*streams.columns, "seq", "x.event", "x.data")


# Class names and hints of the error table, HTTP status of each type.
ERROR_NAMES = {
    "LLM_TIMEOUT": ("TimeOut", "TimeoutError", "APITimeoutError", "ReadTimeout", "ConnectTimeout", "WriteTimeout", "PoolTimeout"),
    "LLM_RATE_LIMITED": ("RateLimitError", "TooManyRequestsError"),
    "LLM_AUTH_ERROR": ("AuthenticationError", "PermissionDeniedError", "ForbiddenError"),
    "VALIDATION_ERROR": ("BadRequestError", "NotFoundError", "UnprocessableEntityError", "InvalidRequestError", "ConflictError"),
    "LLM_UPSTREAM_ERROR": ("APIConnectionError", "ConnectionError", "ConnectionResetError", "BrokenPipeError", "ChunkedEncodingError", "RemoteProtocolError", "ReadError", "ProtocolError"),
}
ERROR_HINTS = {
    "LLM_TIMEOUT": ("timeout", "timed out", "deadline exceeded"),
    "LLM_RATE_LIMITED": ("rate limit", "rate_limit", "too many requests", "429"),
    "LLM_AUTH_ERROR": ("api key", "apikey", "unauthorized", "invalid key", "401", "403", "forbidden"),
    "VALIDATION_ERROR": ("bad request", "invalid request", "malformed", "400", "422"),
    "LLM_UPSTREAM_ERROR": ("connection reset", "connection refused", "connection aborted", "temporarily unavailable", "network", "dns", "name resolution"),
}
ERROR_STATUS = {
    "LLM_TIMEOUT": 504, "LLM_UPSTREAM_ERROR": 502, "LLM_RATE_LIMITED": 502, "LLM_AUTH_ERROR": 502, "RATE_LIMITED": 429, "RETRIEVAL_ERROR": 500,
    "DATABASE_ERROR": 500, "VALIDATION_ERROR": 400, "STREAM_CANCELLED": 499, "REDIS_UNAVAILABLE": 200, "INTERNAL_ERROR": 500,
}
RETRYABLE = ("LLM_TIMEOUT", "LLM_RATE_LIMITED", "LLM_UPSTREAM_ERROR")


def classify_error(name: Column, text: Column, status: Column) -> Column:
    """Type of an error: own dependencies first, then the status, the class name, hints in the text."""
    low, said = F.lower(name), F.lower(safe_message(text, 400))
    out = F.when(low.contains("redis") | said.contains("redis"), "REDIS_UNAVAILABLE")
    out = out.when(low.contains("sqlalchemy") | low.contains("operationalerror") | low.contains("dbapi") | said.contains("pymysql"), "DATABASE_ERROR")
    valid = status.between(100, 599)
    out = out.when(valid & (status == 429), "LLM_RATE_LIMITED").when(valid & status.isin(401, 403), "LLM_AUTH_ERROR")
    out = out.when(valid & status.between(400, 499), "VALIDATION_ERROR").when(valid & (status >= 500), "LLM_UPSTREAM_ERROR")
    for kind, names in ERROR_NAMES.items():
        out = out.when(name.isin(*names), kind)
    for kind, hints in ERROR_HINTS.items():
        out = out.when(reduce(lambda a, b: a | b, (said.contains(h) for h in hints)), kind)
    return out.otherwise("INTERNAL_ERROR")


def http_status(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in ERROR_STATUS.items() for x in p))[kind], F.lit(500))
