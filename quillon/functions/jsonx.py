"""JSON as answers carry it: tolerant parsing, validation, canonical keys."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

FENCE = re.compile(r"^```[a-zA-Z]*\s*(.*?)\s*```$", re.S)
LANGUAGES = ("en", "bn", "banglish", "mixed", "other")
CURRENCY_NAMES = ("BDT", "USD", "other", "unstated")


def first_object(text: str | None) -> str | None:
    """The JSON of a text: the whole of it, or of its one fence, else its first balanced braces.

    Braces are counted wherever they stand. If the first balanced part is no JSON there is none: later
    parts are not tried.
    """
    body = (text or "").strip()
    fenced = FENCE.match(body)
    body = fenced.group(1).strip() if fenced else body
    start, depth, parts = body.find("{"), 0, [body]
    for m in re.finditer(r"[{}]", body[start:]) if start >= 0 else ():
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            parts.append(body[start:start + m.end()])
            break
    for part in parts:
        try:
            return json.dumps(json.loads(part), ensure_ascii=False)
        except ValueError:
            continue
    return None


@pandas_udf(StringType())
def tolerant_json(s: pd.Series) -> pd.Series:
    return s.map(first_object)


def extraction_errors(raw: str | None) -> list[str]:
    """What is wrong with an extraction: types, enumerations, and recommended names outside brands."""
    try:
        x = json.loads(raw or "")
    except ValueError:
        return ["not json"]
    if not isinstance(x, dict):
        return ["not an object"]
    errors = []
    for field in ("brands", "recommended", "retailers"):
        if not isinstance(x.get(field), list) or not all(isinstance(v, str) for v in x[field]):
            errors.append(f"{field}: not a list of strings")
    prices = x.get("prices")
    if not isinstance(prices, list):
        errors.append("prices: not a list")
    else:
        for i, p in enumerate(prices):
            if not isinstance(p, dict) or isinstance(p.get("amount"), bool) or not isinstance(p.get("amount"), (int, float)):
                errors.append(f"prices[{i}]: amount is no number")
            elif p.get("currency") not in CURRENCY_NAMES:
                errors.append(f"prices[{i}]: unknown currency")
    if not isinstance(x.get("refused"), bool):
        errors.append("refused: not true or false")
    if x.get("answer_language") not in LANGUAGES:
        errors.append("answer_language: unknown")
    if not errors:
        known = {b.casefold() for b in x["brands"]}
        errors += [f"recommended: {r} is not in brands" for r in x["recommended"] if r.casefold() not in known]
    return errors


@pandas_udf(ArrayType(StringType()))
def validate(s: pd.Series) -> pd.Series:
    return s.map(extraction_errors)


def canonical_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of a record as JSON with sorted names: its first 32 hex digits."""
    return F.substring(F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256), 1, 32)


def request_errors(body: Column, roles: tuple[str, ...] = ("user",), allowed: tuple[str, ...] = ("model", "messages", "temperature", "max_tokens")) -> Column:
    """Faults of a request body (JSON text): other roles than asked for, fields that are not allowed."""
    said = F.from_json(F.get_json_object(body, "$.messages"), "array<struct<role:string,content:string>>")
    extra = F.array_except(F.json_object_keys(body), F.array(*map(F.lit, allowed)))
    return F.array_compact(F.array(
        F.when(F.coalesce(F.exists(said, lambda m: ~m["role"].isin(*roles)), F.lit(True)), F.lit("roles")),
        F.when(F.size(extra) > 0, F.concat(F.lit("fields: "), F.array_join(F.array_sort(extra), ",")))))
