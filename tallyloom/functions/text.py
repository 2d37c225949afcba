"""Text expressions: cleaning, tokens, similarity, slugs, fingerprints, JSON in free text."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[a-z0-9_]+"


def clean_text(c: Column, max_chars: int) -> Column:
    """Squeeze white space; cut longer texts to ``max_chars`` with an ellipsis at the end."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(s) <= max_chars, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(max_chars - 1))), F.lit("…")))


def token_set(*parts: Column) -> Column:
    """Distinct lower-case ASCII tokens of the parts; null parts count as empty."""
    text = F.concat_ws(" ", *parts)
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty sets have 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def model_key(c: Column) -> Column:
    """A model name without case, separators and vendor prefix."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "^.*/", "")), "[^a-z0-9]+", "")


def fingerprint(config: Mapping) -> str:
    """SHA-256 of key-sorted JSON, shortened to 16 characters."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint_column(*cols: Column) -> Column:
    return F.left(F.sha2(F.to_json(F.struct(*cols)), 256), F.lit(16))


def split_list(value: str, allowed: Sequence[str] | None = None) -> list[str]:
    """Comma-separated names; ``all`` stands for all allowed ones, others raise."""
    names = [x.strip() for x in value.split(",") if x.strip()]
    if allowed is None:
        return names
    if names == ["all"]:
        return list(allowed)
    if unknown := [n for n in names if n not in allowed]:
        raise ValueError(f"unknown names: {unknown}")
    return names


def objects_in(text: str | None) -> list[dict]:
    """All JSON objects that begin at some brace of a text, code fences or not, in order."""
    out, decoder, at = [], json.JSONDecoder(), 0
    text = text or ""
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        out.append(value)
        at = end
    return out


def last_object_with(key: str):
    """Pandas function: the last JSON object of a text that holds the key, as JSON text."""

    @F.pandas_udf(T.StringType())
    def pick(texts: pd.Series) -> pd.Series:
        def one(t):
            found = [o for o in objects_in(t) if key in o]
            return json.dumps(found[-1]) if found else None

        return texts.map(one)

    return pick


@F.pandas_udf(T.StringType())
def largest_object(texts: pd.Series) -> pd.Series:
    """The JSON object of a text with the most characters."""
    return texts.map(lambda t: max((json.dumps(o) for o in objects_in(t)), key=len, default=None))


def field_of(c: Column, name: str) -> Column:
    """A number or word given as ``"name": value`` somewhere in a text that is no valid JSON."""
    got = F.regexp_extract(c, rf'["\']?{name}["\']?\s*[:=]\s*["\']?(-?[0-9]+(?:\.[0-9]+)?|[A-Za-z_]+)', 1)
    return F.when(got != "", got)


#: Spellings of directions, strengths, yes and confidences in words.
DIRECTIONS = {
    "increase": ("increase", "up", "upward", "higher", "positive", "raise", "upwards"),
    "decrease": ("decrease", "down", "downward", "lower", "negative", "reduce", "downwards"),
    "none": ("none", "no", "neutral", "no_change", "unchanged"),
}
STRENGTHS = {"weak": ("low", "small", "mild"), "moderate": ("medium", "mid"), "strong": ("high", "large"), "none": ("none", "no")}
YES = ("1", "true", "yes", "y", "apply", "applied")
NO = ("false", "no", "n", "0")
CONFIDENCES = {"very low": 0.20, "low": 0.35, "medium": 0.60, "moderate": 0.60, "high": 0.80, "very high": 0.90}


def alias(c: Column, names: Mapping[str, Sequence[str]], default: str | None = None, keep: bool = False) -> Column:
    """The canonical name of a value in a table of spellings; ``keep``: other values stay, lower-cased
    and with underscores, and null becomes empty."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")) if keep else c)), "[ -]", "_")
    out = s if keep else F.lit(default).cast("string")
    for name, spellings in names.items():
        out = F.when(s.isin(*spellings), name).otherwise(out)
    return out


def confidence(c: Column, default: float = 0.5) -> Column:
    """A confidence as a fraction: words have fixed values, a percent sign is dropped, numbers over 1
    and up to 100 are percentages, the result lies in 0 to 1. Anything else gives the default."""
    s = F.lower(F.trim(c))
    raw = F.nanvl(F.replace(s, F.lit("%")).try_cast("double"), F.lit(None))
    x = F.when((raw > 1) & (raw <= 100), raw / 100).otherwise(raw)
    out = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(float(default)))
    for word, value in CONFIDENCES.items():
        out = F.when(s == word, F.lit(value)).otherwise(out)
    return out


def boolean(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin(*YES), True).when(s.isin(*NO), False)


def limited(c: Column, limit: int) -> Column:
    """Squeezed text of at most ``limit`` characters; blank becomes null."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(s != "", F.left(s, F.lit(limit)))


def limited_list(c: Column, max_items: int, item_limit: int) -> Column:
    return F.slice(F.filter(F.transform(c, lambda x: limited(x, item_limit)), lambda x: x.isNotNull()), 1, max_items)
