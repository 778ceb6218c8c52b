"""Predicates and extractions on JSON records kept as text or VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import safe_model

# Record keys that may carry message content.
CONTENT_KEYS = ("content", "prompt", "response", "input", "output", "api_key")


def json_type(line: Column, path: str) -> Column:
    """The JSON type of a value: STRING, BIGINT, OBJECT<...>, ...; null if it is not there."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), path, "variant"))


def json_text(line: Column, path: str) -> Column:
    """A string value, null for values of other types (which a plain cast would turn into text)."""
    return F.when(json_type(line, path) == "STRING", F.get_json_object(line, path))


def holds_content(line: Column) -> Column:
    """Whether a record has a key that may carry content, be it null."""
    keys = F.array(*map(F.lit, CONTENT_KEYS))
    return F.coalesce(F.arrays_overlap(F.json_object_keys(line), keys), F.lit(False))


def is_object(line: Column, path: str) -> Column:
    return F.coalesce(json_type(line, path).startswith("OBJECT"), F.lit(False))


def human_content(line: Column, path: str) -> Column:
    """Whether content is text, or an array with a text or image item; the text itself is not kept."""
    parts = F.from_json(F.get_json_object(line, path), "array<string>")
    kind = json_type(line, path)
    items = F.exists(parts, lambda p: F.get_json_object(p, "$.type").isin("text", "image"))
    return F.coalesce((kind == "STRING") | (kind.startswith("ARRAY") & F.coalesce(items, F.lit(False))), F.lit(False))


def json_model(model: Column) -> Column:
    """``provider/model`` of a model record with either naming; the bare model if no provider is named.

    Text that is no JSON is a model name itself.
    """
    at = lambda key: F.get_json_object(model, f"$.{key}")
    provider = F.coalesce(at("providerID"), at("provider_id"))
    name = F.coalesce(at("modelID"), at("model_id"), at("model"), at("id"))
    named = F.when(provider.isNotNull() & name.isNotNull(), F.concat(provider, F.lit("/"), name)).otherwise(name)
    return safe_model(F.when(F.try_parse_json(model).isNull(), model).otherwise(named))
