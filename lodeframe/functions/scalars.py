"""Scalar rules for findings, as column expressions: severity, confidence, taxonomies, paths, URLs, hashes, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Native severities and confidences by tool.
SEMGREP_SEVERITY = {"informational": "info", "info": "info", "low": "low", "warning": "medium", "medium": "medium", "error": "high", "high": "high", "critical": "critical"}
ZAP_SEVERITY = {"0": "info", "1": "low", "2": "medium", "3": "high", "4": "critical"}
SEVERITIES = ("info", "low", "medium", "high", "critical")
ZAP_CONFIDENCE = {"0": "false_positive", "1": "low", "2": "medium", "3": "high", "4": "confirmed"}
CODEQL_CONFIDENCE = {"very_low": "low", "low": "low", "medium": "medium", "high": "high", "very_high": "high"}
CONFIDENCES = ("false_positive", "low", "medium", "high", "confirmed")

#: White space, Unicode's included.
_SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def text_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def lookup(c: Column, values: dict[str, str], default: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def severity(tool: Column, native: Column) -> Column:
    """One of SEVERITIES or unknown. Scores of the third tool: 9 and more critical, 7 high, 4 medium, above 0 low, 0 info."""
    kind = F.lower(strip(tool))
    value = F.replace(F.lower(strip(native)), F.lit("-"), F.lit("_"))
    # numbers as Python reads them: digits may be parted by underscores, signs of exponents can only be plus by now
    number = value.rlike(r"^\+?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e\+?\d+(?:_\d+)*)?$")
    score = F.when(number, F.replace(value, F.lit("_"), F.lit("")).try_cast("double"))
    bands = F.when(value.isin("nan", "+nan"), "info").when(score.isNull() | (score > 10), "unknown").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("info")
    return (
        F.when(native.isNull() | tool.isNull(), "unknown")
        .when(kind == "semgrep", lookup(value, SEMGREP_SEVERITY))
        .when(kind == "zap", lookup(value, ZAP_SEVERITY))
        .when(kind == "codeql", bands)
        .otherwise(F.when(value.isin(*SEVERITIES), value).otherwise("unknown"))
    )


def confidence(tool: Column, native: Column) -> Column:
    """One of CONFIDENCES or unknown."""
    kind = F.lower(strip(tool))
    value = F.translate(F.lower(strip(native)), "- ", "__")
    return (
        F.when(native.isNull() | tool.isNull(), "unknown")
        .when(kind == "zap", lookup(value, ZAP_CONFIDENCE))
        .when(kind == "codeql", lookup(value, CODEQL_CONFIDENCE))
        .otherwise(F.when(value.isin(*CONFIDENCES), value).otherwise("unknown"))
    )


def _numbered(values: Column, pattern: str, prefix: str) -> Column:
    texts = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda t: t.isNotNull() & (t != "") & ~t.startswith("-"))
    found = F.filter(F.transform(texts, lambda t: F.regexp_extract(t, pattern, 1)), lambda n: (n != "") & (n != "0"))
    # leading zeros are gone, so length and text order numbers of any size
    ranked = F.array_sort(F.array_distinct(F.transform(found, lambda n: F.struct(F.length(n).alias("size"), n.alias("n")))))
    return F.transform(ranked, lambda x: F.concat(F.lit(f"{prefix}-"), x["n"]))


#: How numbers of the three taxonomies stand in texts, which part of a path is a checkout's, what is a URL.
CWE_NUMBER = r"(?i)(?:cwe(?:[-_/]cwe)?[-_/]?)?0*([0-9]+)"
WASC_NUMBER = r"(?i)(?:wasc[-_/]?)?0*([0-9]+)"
OWASP_CATEGORY = r"(?i)(?:owasp[-_/]?)?a(0?[1-9]|10)\s*[:_-]\s*([0-9]{4})"
CHECKOUT = r"(?s)^(?:.*?/)?target-app/[^/]+/"
URL = r"(?i)https?://[^\s<>'\"\)]+"


def cwe_ids(values: Column) -> Column:
    """The first number of each text, distinct, in order of the numbers. Texts that start with a minus have none."""
    return _numbered(values, CWE_NUMBER, "CWE")


def wasc_ids(values: Column) -> Column:
    return _numbered(values, WASC_NUMBER, "WASC")


def owasp_categories(values: Column) -> Column:
    """OWASP-Ann:yyyy, distinct, by year and number."""
    texts = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda t: t.rlike(OWASP_CATEGORY))
    pairs = F.transform(texts, lambda t: F.struct(F.regexp_extract(t, OWASP_CATEGORY, 2).alias("year"), F.lpad(F.regexp_extract(t, OWASP_CATEGORY, 1), 2, "0").alias("n")))
    return F.transform(F.array_sort(F.array_distinct(pairs)), lambda p: F.concat(F.lit("OWASP-A"), p["n"], F.lit(":"), p["year"]))


def unquote(c: Column) -> Column:
    """Percent escapes decoded; a plus stays; texts with broken escapes stay as they are."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def code_path(c: Column) -> Column:
    """A relative path with forward slashes; null if nothing is left or it climbs up.

    Each step takes the one before it as seldom as it can, since expressions that repeat others grow fast.
    """
    value = F.replace(strip(c), F.lit("\\"), F.lit("/"))
    value = F.when(value.startswith("file:"), unquote(F.regexp_extract(value, r"^file:(?://[^/?#]*)?([^?#]*)", 1))).otherwise(value)
    value = F.regexp_replace(F.regexp_replace(value, "/+", "/"), CHECKOUT, "")
    path = F.array_join(F.filter(F.split(value, "/"), lambda p: (p != "") & (p != ".")), "/")
    return F.nullif(F.regexp_replace(path, r"(?s)^(?:.*/)?\.\.(?:/.*)?$", ""), F.lit(""))


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _authority(c: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Scheme, user part, host, port, whether all are fit for http."""
    value = strip(c)
    scheme = F.lower(F.regexp_extract(value, _URL, 1))
    authority = F.regexp_extract(value, _URL, 2)
    user = F.regexp_extract(authority, "^(.*)@", 1)
    server = F.regexp_replace(authority, "^.*@", "")
    shape = r"^(\[[^\[\]]+\]|[^:\[\]]+)(?::([0-9]*))?$"
    host = F.lower(F.translate(F.regexp_extract(server, shape, 1), "[]", ""))
    port = F.regexp_extract(server, shape, 2)
    fit = scheme.isin("http", "https") & (host != "") & (F.length(F.ltrim(F.lit("0"), port)) <= 5) & (F.coalesce(F.nullif(port, F.lit("")).try_cast("int"), F.lit(0)) <= 65535)
    return scheme, F.when(authority.contains("@"), user), host, port, fit


def http_origin(c: Column) -> Column:
    """struct(scheme, host, port) of an absolute http or https URL without a user part, else null; ports are explicit."""
    scheme, user, host, port, fit = _authority(c)
    number = F.coalesce(F.nullif(port, F.lit("")).try_cast("int"), F.when(scheme == "http", 80).otherwise(443))
    return F.when(fit & user.isNull(), F.struct(scheme.alias("scheme"), host.alias("host"), number.alias("port")))


def sanitized_uri(c: Column) -> Column:
    """A URL for reports: no user part, no fragment, of the query the sorted distinct names."""
    scheme, _, host, port, fit = _authority(c)
    value = strip(c)
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    number = F.nullif(port, F.lit("")).try_cast("int")
    names = F.transform(F.split(F.regexp_extract(value, _URL, 4), "&"), lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))
    names = F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))
    quoted = F.transform(names, lambda n: F.replace(F.url_encode(n), F.lit("+"), F.lit("%20")))
    path = F.coalesce(F.nullif(F.regexp_extract(value, _URL, 3), F.lit("")), F.lit("/"))
    query = F.array_join(quoted, "&")
    out = F.concat(scheme, F.lit("://"), shown, F.when(number.isNull(), "").otherwise(F.concat(F.lit(":"), number.cast("string"))), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.coalesce(F.when(fit, out), F.lit("<invalid-uri>"))


def endpoint(c: Column) -> Column:
    """A URL's path, or /; null for blank texts."""
    value = strip(c)
    path = F.regexp_replace(F.regexp_extract(value, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")
    return F.when(value != "", F.coalesce(F.nullif(path, F.lit("")), F.lit("/")))


def urls(c: Column) -> Column:
    """http and https URLs in an unescaped text, without trailing points and commas, distinct, sorted."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda u: u.rlike(r"(?i)^https?://[^/?#]"))))


def json_text(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and explicit nulls, as Spark writes it."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical(text: Column) -> Column:
    """JSON text whose control characters are escaped in lower-case digits."""
    upper = [f"{x:04X}" for x in range(32) if f"{x:x}" != f"{x:X}"]
    return reduce(lambda t, x: F.replace(t, F.lit(f"\\u{x}"), F.lit(f"\\u{x.lower()}")), upper, text)


def canonical_json(fields: dict[str, Column]) -> Column:
    return canonical(json_text(fields))


def sha256_of(prefix: str, version: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_sha256:{version}:"), F.sha2(canonical(text), 256))


def canonical_sha256(prefix: str, version: str, fields: dict[str, Column]) -> Column:
    return sha256_of(prefix, version, json_text(fields))


def unique_casefold(values: Column) -> Column:
    """Distinct without regard to case; the first spelling stays, blanks go."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda v: v.isNotNull() & (v != ""))
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sorted_unique(values: Column) -> Column:
    """Trimmed texts, without nulls and blanks, distinct, sorted."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda v: v.isNotNull() & (v != ""))
    return F.array_sort(F.array_distinct(clean))
