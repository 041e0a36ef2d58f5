"""Scalar functions on names, answers and signatures."""

from __future__ import annotations

import hashlib
import hmac
from urllib.parse import parse_qsl

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: keyword and target, in order; the first keyword that a name contains decides
DAMAGE_RULES = [("glass", "glass_shatter"), ("light", "lamp_broken"), ("lamp", "lamp_broken"), ("crack", "crack"), ("scratch", "scratch")]
PART_RULES = [
    ("mirror", "mirror"), ("wheel", "wheel"), ("windshield", "windshield"), ("window", "window"), ("door", "door"), ("light", "light"),
    ("quarter", "fender"), ("rocker", "other"), ("front panel", "bumper"), ("rear panel", "bumper"), ("hood", "hood"), ("bumper", "bumper"),
]
SEVERITY_RANK = {"minor": 0, "moderate": 1, "severe": 2}


def normalize_name(name: Column) -> Column:
    """Trimmed, lower case, runs of ``_`` and ``-`` as one blank."""
    return F.regexp_replace(F.lower(F.trim(name)), "[_\\-]+", " ")


def map_name(name: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Target of the first rule whose keyword the normalized name contains; without a default a name that fits no rule fails."""
    n = normalize_name(name)
    out = F
    for keyword, target in rules:
        out = out.when(n.contains(keyword), target)
    if default is not None:
        return F.when(name.isNotNull(), out.otherwise(default))
    return F.when(name.isNotNull(), out.otherwise(F.raise_error(F.concat(F.lit("no rule for "), name))))


def session_day(file_name: Column, group_by: str = "date") -> Column:
    """``date:yyyymmdd`` of names ID<n>_<date>_<time> or ID<n>_<Unix milliseconds>, else ``file:<stem>``; group_by 'none' keeps files apart."""
    stem = F.regexp_replace(file_name, "(?<=[^/\\\\.])\\.[^./\\\\]*$", "")
    if group_by == "none":
        return F.concat(F.lit("file:"), stem)
    day = F.regexp_extract(stem, "^ID\\d+_(\\d{8})_\\d{6}$", 1)
    ms = F.regexp_extract(stem, "^ID\\d+_(\\d{13})$", 1)
    utc = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms.try_cast("bigint") / 86400000).cast("int")), "yyyyMMdd")
    return F.when(day != "", F.concat(F.lit("date:"), day)).when(ms != "", F.concat(F.lit("date:"), utc)).otherwise(F.concat(F.lit("file:"), stem))


def strip_fence(text: Column) -> Column:
    """The text within a markdown fence (first line to last fence), trimmed; other text as it is."""
    inside = F.regexp_extract(text, "(?s)^```[^\\n]*\\n(.*)```", 1)
    return F.when(text.startswith("```") & text.rlike("(?s)^```[^\\n]*\\n.*```"), F.trim(inside)).otherwise(text)


def shorten(text: Column, limit: int = 300) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def clean_title(text: Column, limit: int = 80) -> Column:
    return F.nullif(F.substring(F.trim(text), 1, limit), F.lit(""))


def command(text: Column) -> Column:
    """First word of a message up to a blank or @, in lower case."""
    return F.lower(F.split(F.trim(text), "[ @]")[0])


def is_image(data: Column) -> Column:
    """``png`` or ``jpeg`` by the first bytes, else null."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(F.hex(F.substring(data, 1, 2)) == "FFD8", "jpeg")


def lookup(key: Column, names: dict[str, str]) -> Column:
    """Name of a key, the key itself where there is none."""
    literal = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(literal, key), key)


@F.pandas_udf(T.BooleanType())
def signature_valid(init_data: pd.Series, token: pd.Series) -> pd.Series:
    """Whether the ``hash`` field signs the other fields with a key derived from the token (HMAC-SHA256 twice); nulls are invalid."""

    def one(data: str | None, secret: str | None) -> bool:
        if not data or not secret:
            return False
        fields = dict(parse_qsl(data, keep_blank_values=True))
        given = fields.pop("hash", "")
        text = "\n".join(f"{k}={v}" for k, v in sorted(fields.items()))
        key = hmac.new(b"WebAppData", secret.encode(), hashlib.sha256).digest()
        return hmac.compare_digest(hmac.new(key, text.encode(), hashlib.sha256).hexdigest(), given)

    return pd.Series([one(a, b) for a, b in zip(init_data, token)], dtype="bool")


def still_valid(auth_seconds: Column, now: Column, max_age: int) -> Column:
    """Whether a time of signing, as text or number, is at most ``max_age`` seconds old; null where it is no number."""
    return now - auth_seconds.try_cast("long") <= max_age


def local_time(at: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A UTC time without zone as text in the clock of ``zone``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")), pattern)


def data_url(data: Column, media: Column) -> Column:
    """Bytes as base64 in a data URL; null for nulls."""
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(data), "\\s", ""))


def with_corrections(prompt: Column, attempt: Column, violations: Column, intro: str) -> Column:
    """The prompt of a repeated attempt: the first one as it is, later ones with ``intro`` and a line for each violation of the last answer."""
    lines = F.array_join(F.transform(violations, lambda v: F.concat(F.lit("- "), v)), "\n")
    return F.when((attempt <= 1) | (F.size(violations) <= 0) | violations.isNull(), prompt).otherwise(F.concat(prompt, F.lit(f"\n\n{intro}\n"), lines))
