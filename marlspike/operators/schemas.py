"""JSON schemas as Columns: what is wrong with a document, as a list that says where and why.

A schema is compiled once, at the driver, into one expression over a variant, so that validation is part of the scan
that reads the documents. Known are type, required, properties, items, $ref within the schema, enum, minLength,
maxLength, minimum, maximum, pattern, and the formats uuid and date-time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = {"uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"}
#: Types of a schema as what schema_of_variant begins with.
KINDS = {"string": ("STRING",), "integer": ("BIGINT", "DECIMAL("), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL("), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def violations(document: Column, schema: dict) -> Column:
    """An array of texts ``path: what is wrong`` for a JSON text; empty if it is valid. Null and texts that are no JSON have ``$: no JSON``."""
    parsed = F.try_parse_json(document)
    found = F.array_compact(F.concat(*_checks(parsed, schema, "$", schema)))
    return F.when(parsed.isNull(), F.array(F.lit("$: no JSON"))).otherwise(found)


def _checks(value: Column, rule: dict, path: str, root: dict) -> list[Column]:
    """Arrays of complaints, null elements among them, about a variant that is there."""
    if "$ref" in rule:
        target = root
        for step in rule["$ref"].removeprefix("#/").split("/"):
            target = target[step]
        return _checks(value, target, path, root)
    out = []
    say = lambda wrong, what: F.array(F.when(F.coalesce(wrong, F.lit(False)), F.lit(f"{path}: {what}")))
    kind = F.schema_of_variant(value)
    if "type" in rule:
        names = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        fits = F.lit(False)
        for begin in (k for n in names for k in KINDS[n]):
            fits = fits | kind.startswith(begin)
        if "integer" in names and "number" not in names:  # 1.0 is an integer, 1.5 isn't
            number = F.try_variant_get(value, "$", "double")
            fits = (fits & (~kind.startswith("DECIMAL(") | (number == F.floor(number)))) | (kind.startswith("DOUBLE") & (number == F.floor(number)))
        out.append(say(~fits, f"not {' or '.join(names)}"))
    text, number = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")), F.when(~kind.startswith("STRING"), F.try_variant_get(value, "$", "double"))
    if "enum" in rule:
        plain = F.try_variant_get(value, "$", "string")
        out.append(say(~F.coalesce(plain.isin([str(x) for x in rule["enum"]]), F.lit(False)), f"not one of {', '.join(map(str, rule['enum']))}"))
    if "minLength" in rule:
        out.append(say(F.char_length(text) < rule["minLength"], f"shorter than {rule['minLength']}"))
    if "maxLength" in rule:
        out.append(say(F.char_length(text) > rule["maxLength"], f"longer than {rule['maxLength']}"))
    if "pattern" in rule:
        out.append(say(~text.rlike(rule["pattern"]), f"doesn't match {rule['pattern']}"))
    if rule.get("format") in FORMATS:
        out.append(say(~text.rlike(FORMATS[rule["format"]]), f"no {rule['format']}"))
    if "minimum" in rule:
        out.append(say(number < rule["minimum"], f"less than {rule['minimum']}"))
    if "maximum" in rule:
        out.append(say(number > rule["maximum"], f"more than {rule['maximum']}"))
    member = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
    for name in rule.get("required", ()):
        out.append(F.array(F.when(kind.startswith("OBJECT") & member(name).isNull(), F.lit(f"{path}.{name}: missing"))))
    none = F.array().cast("array<string>")
    for name, inner in rule.get("properties", {}).items():
        inside = _checks(member(name), inner, f"{path}.{name}", root)
        if inside:
            out.append(F.when(member(name).isNotNull(), F.concat(*inside)).otherwise(none))
    if "items" in rule:
        parts = F.try_variant_get(value, "$", "array<variant>")
        each = lambda x: F.concat(none, *_checks(x, rule["items"], f"{path}[]", root))
        out.append(F.coalesce(F.flatten(F.transform(parts, each)), none))
    return out
