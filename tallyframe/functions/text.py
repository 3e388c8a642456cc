"""Text functions: normalization in a fixed order, clipping, scrubbing, selectors."""

from __future__ import annotations

import fnmatch
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = ("nfkc", "casefold", "collapse_whitespace", "strip")
_SPACE = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.casefold())


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalize(c: Column, steps: list[str]) -> Column:
    """The steps in their fixed order, whatever order they are named in. Plain ASCII stays in the JVM."""
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown normalization: {sorted(unknown)}")
    if "nfkc" in steps:
        c = F.when(_is_ascii(c), c).otherwise(_nfkc(c))
    if "casefold" in steps:
        c = F.when(_is_ascii(c), F.lower(c)).otherwise(_casefold(c))
    if "collapse_whitespace" in steps:
        c = F.regexp_replace(strip(c), _SPACE, " ")
    if "strip" in steps:
        c = strip(c)
    return c


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first differing character, the shorter length if one begins the other, null if equal.

    Halves the common prefix: 31 comparisons do for texts of any length that a column can hold."""
    lo, hi = F.lit(0), F.least(F.length(a), F.length(b))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(31)),
        F.struct(lo.alias("lo"), hi.alias("hi")),
        lambda s, _: F.struct(
            F.when(a.substr(F.lit(1), F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")) == b.substr(F.lit(1), F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")), F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")).otherwise(s["lo"]).alias("lo"),
            F.when(a.substr(F.lit(1), F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")) == b.substr(F.lit(1), F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")), s["hi"]).otherwise(F.greatest(s["lo"], F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int") - 1)).alias("hi"),
        ),
    )
    return F.when(a != b, step["lo"])


def clip(c: Column, n: int) -> Column:
    """At most n characters, an ellipsis in place of the last one where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def truncate_utf8(c: Column, limit: int) -> Column:
    """At most `limit` bytes of UTF-8, never half a character."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode()[:limit].decode(errors="ignore"))

    return F.when(F.octet_length(c) <= limit, c).otherwise(cut(c))


#: What is taken out of error texts, in this order: pattern and replacement (fixed values of this package).
SECRETS = [
    (r"(?i)(authorization\s*[:=]\s*)(?:bearer\s+)?\S+", "$1[secret]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}", "bearer [secret]"),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[secret]"),
    (r"\bsk-[A-Za-z0-9_-]{12,}", "[secret]"),
    (r"(?i)((?:api[_-]?key|secret|token|password)\s*[:=]\s*)[\"']?[^\s\"',;]+", "$1[secret]"),
    (r"([a-z][a-z0-9+.-]*://)[^\s/@]+@", "$1[secret]@"),
    (r"(?i)([?&](?:x-amz-(?:signature|credential|security-token)|x-goog-(?:signature|credential)|signature|sig|sv|se)=)[^&\s\"']+", "$1[secret]"),
    (r"\barn:[a-z0-9-]*:[a-z0-9-]+:[^\s\"',;)]*", "[resource]"),
    (r"/subscriptions/[0-9a-fA-F-]{8,}(?:/[^\s\"',;)]*)?|\bprojects/[a-z0-9-]+/(?:locations|secrets|serviceAccounts)/[^\s\"',;)]*", "[resource]"),
    (r"(?i)(\baccount(?:[ _-]?id)?\s*[:=#]?\s*)\d{12}\b", "$1[account]"),
]


def scrub(c: Column) -> Column:
    for pattern, replacement in SECRETS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def model_family(c: Column) -> Column:
    """The first two parts of a model's name."""
    return F.array_join(F.slice(F.split(F.lower(c), r"[.:/\-]"), 1, 2), ".")


def selects(key: Column, selector: str) -> Column:
    """Whether a selector picks an evaluator key: a glob of the whole key, or of its kind and name."""
    to_java = lambda glob: fnmatch.translate(glob).replace(r"\Z", r"\z").replace("(?s:", "(?s:")
    return key.rlike("^" + to_java(selector)) | key.rlike("^" + to_java(selector + ":*"))


#: How providers say that an input is too long (fixed values of this package).
OVERSIZE = r"(?i)(?:too (?:long|large|many (?:input )?tokens)|exceeds? (?:the )?(?:maximum|max|context|limit)|context (?:length|window)|maximum context|input is too)"


def is_oversize(message: Column, code: Column, codes: tuple[str, ...] = ("413", "context_length_exceeded", "request_too_large")) -> Column:
    return F.coalesce(code.isin(*codes), F.lit(False)) | F.coalesce(message.rlike(OVERSIZE), F.lit(False))
