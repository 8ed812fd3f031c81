"""URL splitting and the 18 lexical features as native column expressions.

Everything here is map-only: one stage, no shuffle, no Python worker. The split follows the
generic ``scheme://authority/path;params?query#fragment`` grammar as the Python standard
library reads it, which differs from Spark's ``parse_url`` on scheme-less, bracketed and
otherwise odd input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linksift.functions.vocabulary import (
    FEATURES,
    RISK_WORDS,
    SPECIAL_CHARACTERS,
    SUSPICIOUS_TLDS,
)

# Characters dropped in front of a URL (controls and blank) and anywhere in it.
LEADING_JUNK = "".join(map(chr, range(0x21)))
LINE_JUNK = "\t\r\n"

# Schemes whose last path segment may carry ";params".
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
]

# Characters whose compatibility form holds one of / ? # @ :
HOST_TRAPS = (
    r"[\x{2047}-\x{2049}\x{2100}\x{2101}\x{2105}\x{2106}\x{2A74}\x{FE13}\x{FE16}\x{FE55}"
    r"\x{FE56}\x{FE5F}\x{FE6B}\x{FF03}\x{FF0F}\x{FF1A}\x{FF1F}\x{FF20}]"
)

# Digit characters outside the decimal digit class (superscripts, circled, ...).
OTHER_DIGITS = (
    r"\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}"
    r"\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
# The decimal digit class, with three scripts younger than some JVMs' tables.
DECIMALS = r"\p{Nd}\x{11F50}-\x{11F59}\x{16AC0}-\x{16AC9}\x{1E4F0}-\x{1E4F9}"
NO_DIGIT = f"[^{DECIMALS}{OTHER_DIGITS}]"
DOTTED_QUAD = rf"[{DECIMALS}]{{1,3}}(?:\.[{DECIMALS}]{{1,3}}){{3}}"

# White space trimmed from typed input.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The address allowed in brackets: IPv6 with an optional zone, or the "future" form. A "::"
# stands for at least one group, so at most seven groups may be written beside it.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_GROUPS = rf"{_GROUP}(?::{_GROUP})*"
_IPV6 = (
    rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{6}}{_IPV4}"
    rf"|(?!(?::*+[^:%\]]++){{8}})(?:{_GROUPS})?::(?:{_GROUPS})?"
    rf"|(?!(?::*+[^:%\]]++){{7}})(?:{_GROUPS})?::(?:{_GROUPS}:)?{_IPV4})(?:%[^%\]]+)?"
)
GOOD_BRACKETS = rf"^[^\[]*\[(?:v[0-9A-Fa-f]+\.[^\]]+|{_IPV6})(?:\]|\z)"

# What is left after dropping runs of other characters is counted; runs make this the fast way.
_NOT_SPECIAL = "[^" + "".join("\\" + c for c in SPECIAL_CHARACTERS) + "]+"

PARTS = ["scheme", "netloc", "path", "query", "invalid"]


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, netloc, path, query and the ``invalid`` flag.

    A URL that cannot be split gets the parts of ``http://error.com``; a null URL gets nulls.
    Each step is its own projection, so an intermediate text is computed once per row.
    """
    trimmed = F.ltrim(F.col(url), F.lit(LEADING_JUNK))
    has_line_junk = reduce(Column.__or__, [F.contains(F.col(url), F.lit(c)) for c in LINE_JUNK])
    clean = F.when(has_line_junk, F.translate(trimmed, LINE_JUNK, "")).otherwise(trimmed)
    scheme = F.lower(F.regexp_extract("_clean", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.when(F.col("_scheme") == "", F.col("_clean")).otherwise(
        F.expr("substring(_clean, length(_scheme) + 2)")
    )
    tail = F.when(
        F.startswith("_rest", F.lit("//")), F.expr("substring(_rest, length(_netloc) + 3)")
    ).otherwise(F.col("_rest"))
    opened = F.contains("_netloc", F.lit("["))
    invalid = (
        (opened != F.contains("_netloc", F.lit("]")))
        | (opened & ~F.col("_netloc").rlike(GOOD_BRACKETS))
        | ((F.octet_length("_netloc") != F.length("_netloc")) & F.col("_netloc").rlike(HOST_TRAPS))
    )
    has_params = F.contains("_path", F.lit(";")) & F.col("_scheme").isin(PARAM_SCHEMES)
    # Cut by lengths: a pattern would look ahead again from every ";" of a long segment.
    last = F.substring_index("_path", "/", -1)
    cut = F.length("_path") - F.length(last) + F.length(F.substring_index(last, ";", 1))
    bare_path = F.when(has_params, F.left("_path", cut)).otherwise(F.col("_path"))
    broken = F.col("invalid")
    return (
        df.withColumn("_clean", clean)
        .withColumn("_scheme", scheme)
        .withColumn("_rest", rest)
        .withColumn("_netloc", F.regexp_extract("_rest", r"^//([^/?#]*)", 1))
        .withColumn("_body", F.substring_index(tail, "#", 1))
        .withColumn("_path", F.substring_index("_body", "?", 1))
        .withColumn("invalid", invalid)
        .withColumns(
            {
                "scheme": F.when(broken, "http").otherwise(F.col("_scheme")),
                "netloc": F.when(broken, "error.com").otherwise(F.col("_netloc")),
                "path": F.when(broken, "").otherwise(bare_path),
                "query": F.when(broken, "").otherwise(
                    F.expr("substring(_body, length(_path) + 2)")
                ),
            }
        )
        .select(*df.columns, *PARTS)
    )


def _occurrences(column: str, char: str) -> Column:
    return F.array_size(F.split(F.col(column), "\\" + char, -1)) - 1


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def with_url_features(df: DataFrame, url: str = "url", keep_parts: bool = False) -> DataFrame:
    """Add the 18 features (U1, F1-F18), all ``int``; a null URL gives null features."""
    lowered = F.lower(F.col(url))
    dots, netloc = F.col("num_subdomains"), F.col("netloc")
    features = {
        "url_length": F.length(url),
        "domain_length": F.length("netloc"),
        "path_length": F.length("path"),
        "num_dots": _occurrences(url, "."),
        "num_hyphens": _occurrences("netloc", "-"),
        "has_https": _flag(F.col("scheme") == "https"),
        # Four groups of digits need three dots, so most hosts never reach the pattern.
        "has_ip": F.when(dots < 3, 0).otherwise(
            _flag(netloc.rlike(DOTTED_QUAD))
        ),
        "has_at_symbol": _flag(F.contains(F.col(url), F.lit("@"))),
        "num_special_chars": F.length(F.regexp_replace(url, _NOT_SPECIAL, "")),
        "digits_in_domain": F.when(
            F.octet_length(netloc) == F.length(netloc),
            F.length(F.regexp_replace(netloc, "[^0-9]+", "")),
        ).otherwise(F.length(F.regexp_replace(netloc, NO_DIGIT + "+", ""))),
        "suspicious_tld": _flag(
            F.concat(F.lit("."), F.substring_index("netloc", ".", -1)).isin(SUSPICIOUS_TLDS)
            & F.contains(netloc, F.lit("."))
        ),
        **{
            f"has_{word}": _flag(F.contains(F.col("_lower"), F.lit(word)))
            for word in RISK_WORDS
        },
        "has_query": _flag(F.col("query") != ""),
    }
    parted = with_url_parts(df, url)
    others = df.columns + (PARTS if keep_parts else [])
    return (
        parted.withColumns({"_lower": lowered, "num_subdomains": _occurrences("netloc", ".")})
        .withColumns(features)
        .select(*others, *FEATURES)
    )


def normalise_url(url: Column, prefix: str = "https://", strip: bool = True) -> Column:
    """P5: trim white space if asked and put a scheme in front unless it starts with "http"."""
    text = F.trim(url, F.lit(BLANKS)) if strip else url
    return F.when(F.startswith(text, F.lit("http")), text).otherwise(
        F.concat(F.lit(prefix), text)
    )


def typed_urls(
    df: DataFrame, url: str = "url", prefix: str = "https://", strip: bool = True
) -> DataFrame:
    """P5 + P6: blank input is dropped, the rest is normalised in place."""
    text = F.trim(F.col(url), F.lit(BLANKS)) if strip else F.col(url)
    return (
        df.withColumn(url, text)
        .filter(F.length(url) > 0)
        .withColumn(url, normalise_url(F.col(url), prefix, strip=False))
    )


def split_rejects(df: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and rows with a null URL."""
    return df.filter(F.col(url).isNotNull()), df.filter(F.col(url).isNull())
