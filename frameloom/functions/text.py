"""Redaction of credentials in URLs and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names whose values are secrets, in the order of replacement; the limit in bytes; what ends a value.
SECRET_NAMES = ("password=", "passwd=", "token=", "secret=", "key=", "auth=", "authorization:", "bearer ")
LINE_LIMIT = 512
VALUE_ENDS = " &;,'\""


def redact_url(url: Column) -> Column:
    """User info before the last @ of the authority becomes ***; also without a scheme."""
    with_scheme = F.regexp_replace(url, r"^(.*?://)[^/]*@", "$1***@")
    return F.when(F.instr(url, "://") > 0, with_scheme).otherwise(F.regexp_replace(url, r"^[^/]*@", "***@"))


def redact_urls(line: Column) -> Column:
    """User info in each URL inside a line; a URL ends at white space, a quote, > or )."""
    return F.regexp_replace(line, r"((?:rtsps?|https?)://)[^/\s'\">)]*@", "$1***@")


def sanitize(line: Column) -> Column:
    """Control characters become spaces, a long line is cut after LINE_LIMIT bytes, secrets become ***."""
    clean = F.regexp_replace(line, r"\p{Cc}", " ")
    out = F.when(F.octet_length(clean) > LINE_LIMIT, F.concat(_whole_characters(clean, LINE_LIMIT), F.lit("...[truncated]"))).otherwise(clean)
    for name in SECRET_NAMES:
        out = F.regexp_replace(out, f"(?iu)({name})[^{VALUE_ENDS}]+", "$1***")
    return out


def _whole_characters(text: Column, size: int) -> Column:
    """The shortest prefix of whole characters with at least ``size`` bytes."""
    steps = F.sequence(F.lit(size // 4), F.lit(size))
    enough = F.filter(steps, lambda n: F.octet_length(F.substring(text, F.lit(1), n)) >= size)
    return F.substring(text, F.lit(1), F.array_min(enough))


def is_insecure(url: Column) -> Column:
    return F.startswith(url, F.lit("rtsp://"))


def promote_tls(url: Column) -> Column:
    return (
        F.when(F.startswith(url, F.lit("rtsp://")), F.concat(F.lit("rtsps://"), F.substring(url, F.lit(8), F.length(url))))
        .when(F.instr(url, "://") > 0, url)
        .otherwise(F.concat(F.lit("rtsps://"), url))
    )
