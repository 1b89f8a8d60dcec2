"""Configuration: YAML files merged, checked and turned into small tables."""

from __future__ import annotations

import hashlib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The settings of a channel that names none.
WEIGHTS = {
    "threshold_score": 0.0, "keyword_weight": 10.0, "mention_weight": 8.0, "reply_weight": 5.0, "reaction_weight": 3.0,
    "anchor_weight": 4.0, "link_weight": 2.0, "file_weight": 3.0, "bot_penalty": -15.0,
}


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``base`` with ``over`` laid over it; dicts merge, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(folder: str | Path, main: str = "main.yaml") -> dict[str, Any]:
    """All YAML files of a folder: the main one first, the others by name, later ones win."""
    import yaml  # optional: only configurations in files need it

    paths = sorted(Path(folder).glob("*.yaml"), key=lambda p: (p.name != main, p.name))
    out: dict[str, Any] = {}
    for p in paths:
        out = deep_merge(out, yaml.safe_load(p.read_text(encoding="utf-8")) or {})
    return out


def check(value: Any, schema: dict[str, Any] | None, at: str = "") -> list[str]:
    """Where ``value`` breaks a JSON schema (type, required, properties, items, enum, minimum, maximum); no schema, no complaint."""
    if not schema:
        return []
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    wanted = schema.get("type")
    names = [wanted] if isinstance(wanted, str) else wanted or []
    if names and not any(isinstance(value, kinds[n]) and not (isinstance(value, bool) and n in ("number", "integer")) for n in names):
        return [f"{at or '/'}: not of type {'/'.join(names)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at or '/'}: not one of {schema['enum']}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at or '/'}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{at or '/'}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, dict):
        out += [f"{at}/{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            out += check(v, schema.get("properties", {}).get(k), f"{at}/{k}")
    if isinstance(value, list):
        for i, v in enumerate(value):
            out += check(v, schema.get("items"), f"{at}/{i}")
    return out


def channel_rows(channels: list[Any], source: str) -> list[dict[str, Any]]:
    """Channel settings of any allowed shape (an id, a mapping, an object) as rows; other shapes are left out."""
    out = []
    for c in channels:
        if isinstance(c, str):
            c = {"channel_id": c}
        elif not isinstance(c, dict):
            c = getattr(c, "__dict__", None)
        if not c or not c.get("channel_id", c.get("username")):
            continue
        key = str(c.get("channel_id", c.get("username")))
        row = {"source_id": source, "channel": key, "channel_name": str(c.get("channel_name", key)), "enabled": bool(c.get("enabled", True))}
        row |= {k: float(c.get(k, v)) for k, v in WEIGHTS.items()}
        out.append(row | {k: [str(x) for x in c.get(k) or []] for k in ("whitelist_keywords", "trusted_bots")})
    return out


def channel_table(spark: SparkSession, by_source: dict[str, list[Any]]) -> DataFrame:
    """Enabled channels of all sources, in order."""
    rows = [r for source, channels in by_source.items() for r in channel_rows(channels, source)]
    fields = ", ".join(f"{k} double" for k in WEIGHTS)
    schema = f"ord int, source_id string, channel string, channel_name string, enabled boolean, {fields}, whitelist_keywords array<string>, trusted_bots array<string>"
    return spark.createDataFrame([{"ord": i} | r for i, r in enumerate(rows)], schema).where(F.col("enabled")).drop("enabled")


def load_prompt(path: str | Path) -> tuple[str, str]:
    """(text, SHA-256) of a prompt file; an empty one is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if not text.strip():
        raise ValueError(f"{path} is empty")
    return text, hashlib.sha256(text.encode()).hexdigest()
