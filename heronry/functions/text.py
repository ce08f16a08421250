"""Text columns: tokens, redaction, injection scan, normal forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not indexed.
STOP_WORDS = tuple(
    "a an the is are was were be been being have has had do does did will would could should may might must can shall "
    "of in on at to for with by from as into about over after under between through "
    "find show explain describe what how why when where who which that this these those "
    "and or but not no nor so if then me my we our you your he she it its they them their there here "
    "section content purpose definition implementation code method function class use used using get set return returns".split()
)
CJK = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{20000}-\\x{2A6DF}]"

# Patterns of credentials, and what they are replaced by.
CREDENTIALS = (
    ("(?i)(api[_-]?key|token|secret)(\\s*[:=]\\s*['\"]?)[A-Za-z0-9_\\-]{16,}(['\"]?)", "$1$2<api-key>$3"),
    ("(?i)(password|passwd|pwd)(\\s*[:=]\\s*['\"]?)[^\\s'\"<>]{4,}(['\"]?)", "$1$2<password>$3"),
    ("(?i)(bearer|authorization)(\\s*[:=]\\s*['\"]?)[A-Za-z0-9_\\-\\.]{20,}(['\"]?)", "$1$2<token>$3"),
)

# Names and patterns of prompt injection.
HIGH_RISK = (
    ("chat_delimiter_escape", "(?i)<\\|im_(?:start|end)\\|>|<\\|(?:system|user|assistant)\\|>"),
    ("delimiter_escape", "(?i)\\]\\]>|</prompt>|</system>|###\\s*(?:system|instruction)"),
    ("role_hijack", "(?i)ignore (?:all |any )?(?:previous|prior|above|earlier) (?:instructions?|prompts?|rules?)"),
    ("role_hijack_zh", "忽略(?:之前|以上|先前|所有)的?(?:指令|提示|规则|要求)"),
    ("identity_override", "(?i)you are now\\b|act as (?:a |an )?(?:shell|admin|root)\\b|你现在是|扮演(?:管理员|root)"),
    ("prompt_disclosure", "(?i)(?:reveal|show|print|output).{0,40}(?:system|internal) prompt|泄露|输出.{0,12}(?:系统|内部)(?:提示|指令)"),
    ("tool_call_manipulation", "(?i)(?:call|invoke|run) the (?:tool|function) [a-z_]+|调用工具\\s*[a-z_]+"),
    ("user_concealment", "(?i)do not (?:tell|inform|show) the user|不要告诉用户|瞒着用户"),
)
LOW_RISK = (
    ("suspicious_base64", "(?i)\\bbase64[:\\s]"),
    ("jailbreak_marker", "(?i)\\bDAN mode\\b|\\bdeveloper mode\\b|越狱模式"),
)
# Fixed value: phrases that claim authority.
AUTHORITY = (
    "(?i)\\b(?:switch|change)\\s+(?:the\\s+)?scope\\s+to\\b|\\bgrant\\s+(?:writer|admin|hard)\\s+(?:permission|authority)\\b"
    "|\\b(?:write|create)\\s+hard\\s+memor|\\benable\\s+(?:consolidation\\s+)?policy\\b|\\bpromote\\s+memor\\w*\\s+automatically\\b"
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of [a-z0-9_] that aren't stop words, in order; then, where there is any, the
    character pairs of each run of ideographs (a single one by itself). Null has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), 1), lambda w: ~w.isin(*STOP_WORDS))
    runs = F.regexp_extract_all(low, F.lit(f"({CJK}+)"), 1)

    def pairs(run: Column) -> Column:
        last = F.greatest(F.length(run) - 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(run, i, F.lit(2)))

    return F.when(low.rlike(CJK), F.concat(words, F.flatten(F.transform(runs, pairs)))).otherwise(words)


def term_id(term: Column) -> Column:
    """First four bytes of the SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long")


def words_estimate(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")).cast("long")


def quarter_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("long")


def redacted(text: Column) -> Column:
    for pattern, into in CREDENTIALS:
        text = F.regexp_replace(text, pattern, into)
    return text


#: What a text that matches a pattern has in it for certain, in small letters: looked for first, as it costs little.
SIGNS = {
    "chat_delimiter_escape": ("<|",), "delimiter_escape": ("]]>", "</prompt>", "</system>", "###"), "role_hijack": ("ignore ",), "role_hijack_zh": ("忽略",),
    "identity_override": ("you are now", "act as ", "你现在是", "扮演"), "prompt_disclosure": ("system prompt", "internal prompt", "泄露", "输出"), "tool_call_manipulation": (" the tool ", " the function ", "调用工具"),
    "user_concealment": (" the user", "不要告诉用户", "瞒着用户"), "suspicious_base64": ("base64",), "jailbreak_marker": (" mode", "越狱模式"),
}


def matched(text: Column, low: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Names of the patterns that are found, in their order; low is the text in small letters."""
    found = [(n, reduce(lambda a, b: a | b, [low.contains(s) for s in SIGNS[n]]) & text.rlike(p)) for n, p in patterns]
    return F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, hit in found]))


def injection(text: Column) -> Column:
    """struct(risk, names): high patterns first; the low ones count only without a high one. A list of one binds what is used
    more than once, so each pattern is tried once."""

    def judged(x: Column) -> Column:
        risk = F.when(F.size(x["high"]) > 0, "high").when(F.size(x["low"]) > 0, "low").otherwise("none")
        return F.struct(risk.alias("risk"), F.when(F.size(x["high"]) > 0, x["high"]).otherwise(x["low"]).alias("names"))

    def tried(x: Column) -> Column:
        return F.struct(*[matched(x["text"], x["low"], p).alias(n) for n, p in (("high", HIGH_RISK), ("low", LOW_RISK))])

    said = F.coalesce(text, F.lit(""))
    once = F.transform(F.array(F.struct(said.alias("text"), F.lower(said).alias("low"))), tried)
    return F.transform(once, judged)[0]


def quarantined(text: Column, ref: Column) -> Column:
    # Fixed value: the stub's wording.
    stub = F.concat(F.lit("[quarantined untrusted content withheld from analysis; source: "), F.coalesce(F.when(ref != "", ref), F.lit("unknown")), F.lit("]"))
    return F.when(injection(text)["risk"] == "high", stub).otherwise(text)


def heading_form(text: Column) -> Column:
    """Lower-cased heading without markers, white space as '-', for comparison; ideographs stay."""
    t = F.trim(F.regexp_replace(F.trim(text), "^#+", ""))
    t = F.lower(F.regexp_replace(t, "[`*_]", ""))
    t = F.regexp_replace(F.regexp_replace(t, "\\s+", "-"), "[^\\p{L}\\p{N}_-]", "")
    return F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^-|-$", "")


def percent_form(text: Column) -> Column:
    for raw, code in (("%", "%25"), (":", "%3A"), ("=", "%3D")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(s, 1, 255), "-+$", "")


def remote_form(url: Column) -> Column:
    """host/path of a repository address: no scheme, user, default port, '.git' or outer slashes; null if
    the address has a query, a fragment, another scheme or no path."""
    full = "^(https?|ssh|git)://(?:[^/@]*@)?([^/:?#]+)(?::([0-9]+))?/([^?#]*)$"
    short = "^(?:[^/@:]+@)?([^/:@]+):([^?#]+)$"
    bare = "^([^/@:]+(?::[0-9]+)?)/(.+)$"
    port = F.regexp_extract(url, full, 3)
    host = F.concat(F.regexp_extract(url, full, 2), F.when((port != "") & ~port.isin("22", "80", "443"), F.concat(F.lit(":"), port)).otherwise(""))
    kind = F.when(url.contains("://"), F.when(url.rlike(full), "full")).when(url.rlike(bare), "bare").when(url.rlike(short), "short")
    host = F.when(kind == "full", host).when(kind == "bare", F.regexp_extract(url, bare, 1)).when(kind == "short", F.regexp_extract(url, short, 1))
    path = F.when(kind == "full", F.regexp_extract(url, full, 4)).when(kind == "bare", F.regexp_extract(url, bare, 2)).when(kind == "short", F.regexp_extract(url, short, 2))
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "\\.git$", "")
    bad = (path == "") | path.rlike("(^|/)\\.\\.?(/|$)")
    return F.when(~bad, F.concat(F.lower(host), F.lit("/"), path))
