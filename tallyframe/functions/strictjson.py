"""Strict JSON, and a documented subset of JSON Schema."""

from __future__ import annotations

import json
import math
import re

MAX_ERRORS, MAX_DEPTH = 10, 64
KEYWORDS = (
    "type enum const properties required additionalProperties minProperties maxProperties items prefixItems minItems maxItems uniqueItems "
    "minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf anyOf allOf oneOf not $ref $defs definitions title description default $schema $id examples"
).split()


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _number(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(f"{text} is not finite")
    return x


def _refuse(text: str) -> float:
    raise ValueError(f"{text} is no JSON")


def loads(text: str | bytes) -> object:
    """A JSON value; duplicate keys, NaN, infinities, numbers beyond a double and trailing text are errors."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    try:
        return json.loads(text, object_pairs_hook=_pairs, parse_float=_number, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("nested too deeply") from None


_FENCE = re.compile(r"\A\s*```[A-Za-z0-9_-]*[ \t]*\r?\n(.*?)\r?\n?```\s*\Z", re.DOTALL)


def strip_fence(text: str) -> str:
    """The inside of a text that is one code fence; any other text as it is."""
    m = _FENCE.match(text)
    return m.group(1) if m and "```" not in m.group(1) else text


def check_schema(schema: object, path: str = "") -> None:
    """Refuses a schema with a remote reference or a keyword outside KEYWORDS."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path or '/'}: a schema is an object or a boolean")
    for k, v in schema.items():
        if k not in KEYWORDS:
            raise ValueError(f"{path}/{k}: keyword not supported")
        if k == "$ref" and not str(v).startswith("#"):
            raise ValueError(f"{path}/$ref: only references within the schema")
        if k in ("properties", "$defs", "definitions"):
            for name, sub in v.items():
                check_schema(sub, f"{path}/{k}/{name}")
        elif k in ("anyOf", "allOf", "oneOf", "prefixItems"):
            for i, sub in enumerate(v):
                check_schema(sub, f"{path}/{k}/{i}")
        elif k in ("items", "additionalProperties", "not"):
            check_schema(v, f"{path}/{k}")
        elif k == "pattern":
            re.compile(v)


def _is(value: object, name: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "null": value is None,
        "boolean": isinstance(value, bool),
        "string": isinstance(value, str),
        "number": number,
        "integer": number and float(value).is_integer(),
        "array": isinstance(value, list),
        "object": isinstance(value, dict),
    }.get(name, False)


def _same(a: object, b: object) -> bool:
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def _resolve(root: object, ref: str) -> object:
    node = root
    for part in ref[1:].strip("/").split("/") if ref != "#" else []:
        part = part.replace("~1", "/").replace("~0", "~")
        node = node[int(part)] if isinstance(node, list) else node[part]
    return node


def errors(value: object, schema: object, root: object | None = None, path: str = "", depth: int = 0) -> list[tuple[str, str]]:
    """(JSON pointer, keyword) of every violation, MAX_ERRORS of them at most."""
    root = schema if root is None else root
    if schema is True:
        return []
    if schema is False:
        return [(path, "false")]
    if depth > MAX_DEPTH:
        return [(path, "depth")]
    out: list[tuple[str, str]] = []
    deeper = lambda v, s, p: errors(v, s, root, p, depth + 1)
    number = _is(value, "number")
    for k, want in schema.items():
        bad = False
        if k == "$ref":
            out += deeper(value, _resolve(root, want), path)
        elif k == "type":
            bad = not any(_is(value, t) for t in ([want] if isinstance(want, str) else want))
        elif k == "enum":
            bad = not any(_same(value, w) for w in want)
        elif k == "const":
            bad = not _same(value, want)
        elif k in ("allOf", "anyOf", "oneOf"):
            hits = [not deeper(value, s, path) for s in want]
            bad = {"allOf": not all(hits), "anyOf": not any(hits), "oneOf": sum(hits) != 1}[k]
        elif k == "not":
            bad = not deeper(value, want, path)
        elif isinstance(value, dict):
            if k == "required":
                out += [(f"{path}/{r}", k) for r in want if r not in value]
            elif k == "properties":
                for name, sub in want.items():
                    if name in value:
                        out += deeper(value[name], sub, f"{path}/{name}")
            elif k == "additionalProperties":
                for name in value.keys() - schema.get("properties", {}).keys():
                    out += [(f"{path}/{name}", k)] if want is False else deeper(value[name], want, f"{path}/{name}")
            elif k in ("minProperties", "maxProperties"):
                bad = len(value) < want if k[1] == "i" else len(value) > want
        elif isinstance(value, list):
            if k == "prefixItems":
                for i, (v, s) in enumerate(zip(value, want)):
                    out += deeper(v, s, f"{path}/{i}")
            elif k == "items":
                for i, v in enumerate(value):
                    if i >= len(schema.get("prefixItems", [])):
                        out += deeper(v, want, f"{path}/{i}")
            elif k in ("minItems", "maxItems"):
                bad = len(value) < want if k[1] == "i" else len(value) > want
            elif k == "uniqueItems":
                bad = want and any(_same(a, b) for i, a in enumerate(value) for b in value[:i])
        elif isinstance(value, str):
            if k in ("minLength", "maxLength"):
                bad = len(value) < want if k[1] == "i" else len(value) > want
            elif k == "pattern":
                bad = not re.search(want, value)
        elif number:
            if k == "minimum":
                bad = value < want
            elif k == "maximum":
                bad = value > want
            elif k == "exclusiveMinimum":
                bad = value <= want
            elif k == "exclusiveMaximum":
                bad = value >= want
            elif k == "multipleOf":
                bad = abs(value / want - round(value / want)) > 1e-9
        if bad:
            out.append((path, k))
        if len(out) >= MAX_ERRORS:
            break
    return out[:MAX_ERRORS]
