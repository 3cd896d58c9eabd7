"""JSON schemas: checks compiled to Columns over variants, the strict form, and sample values."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the type of a variant looks like for each JSON type. Whole numbers beyond 64 bits are decimals without a scale.
VARIANT_TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
}


def child(value: Column, key: str) -> Column:
    """Member of an object variant, null if there is none (a JSON null is a value)."""
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(value, f"$[{quote}{key}{quote}]", "variant")


def problems(value: Column, schema: dict, at: Column) -> Column:
    """Array of what is wrong with a variant: the schema is walked once, on the driver, and leaves one expression.

    A wrong type ends the descent; unknown keys are fine."""
    none = F.array().cast("array<string>")
    say = lambda text: F.array(F.concat(at, F.lit(text)))
    found = []
    if "enum" in schema:
        options = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]
        found.append(F.when(F.to_json(value).isin(options), none).otherwise(say(": not in enum")))
    kind = schema.get("type")
    if kind == "object":
        found += [F.when(child(value, k).isNull(), say(f": {k} missing")).otherwise(none) for k in schema.get("required", [])]
        for key, below in schema.get("properties", {}).items():
            member = child(value, key)
            found.append(F.when(member.isNull(), none).otherwise(problems(member, below, F.concat(at, F.lit(f".{key}")))))
    if kind == "array" and schema.get("items"):
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: problems(v, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), none))
    inner = F.concat(*found) if found else none
    if kind not in VARIANT_TYPES:
        return inner
    return F.when(F.schema_of_variant(value).rlike(VARIANT_TYPES[kind]), inner).otherwise(say(f": type {kind} expected"))


def json_problems(text: Column, schema: dict) -> Column:
    """Problems of JSON text, joined by '; ' (null text, bad JSON and repeated keys: 'invalid JSON')."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNull(), "invalid JSON").otherwise(F.array_join(problems(parsed, schema, F.lit("$")), "; "))


def strict(schema: dict, named: dict | None = None) -> dict:
    """A copy in which references are resolved, objects need all their keys and no others, and defaults are gone."""
    named = named if named is not None else schema.get("$defs", schema.get("definitions", {}))
    if "$ref" in schema:
        return strict(named[schema["$ref"].split("/")[-1]], named)
    made = {}
    for key, part in schema.items():
        if key in ("$defs", "definitions", "default"):
            continue
        if key == "properties":
            made[key] = {name: strict(below, named) for name, below in part.items()}
        elif key in ("anyOf", "oneOf", "allOf"):
            made[key] = [strict(below, named) for below in part]
        elif key == "items" and isinstance(part, dict):
            made[key] = strict(part, named)
        else:
            made[key] = part
    if made.get("type") == "object" or "properties" in made:
        keys = made.setdefault("properties", {})
        made |= {"required": [*keys], "additionalProperties": False}
    return made


def response_format(name: str, schema: dict) -> dict:
    return {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": strict(schema)}}


def sample_value(schema: dict, hint: str = "text") -> object:
    """A value that fits: the first option, the first alternative that isn't null, fixed scalars, ``minItems`` (else two) members."""
    if schema.get("enum"):
        return schema["enum"][0]
    options = [s for s in schema.get("anyOf", []) if s.get("type") != "null"]
    if options:
        return sample_value(options[0], hint)
    kinds = schema.get("type")
    kind = next((k for k in kinds if k != "null"), "string") if isinstance(kinds, list) else kinds
    if kind == "object":
        return {k: sample_value(s, k) for k, s in schema.get("properties", {}).items()}
    if kind == "array":
        return [sample_value(schema.get("items", {"type": "string"}), hint)] * schema.get("minItems", 2)
    return {"string": f"mock {hint} sample", "integer": 3, "number": 3.5, "boolean": False}.get(kind)


# ---- dimensions -----------------------------------------------------------------------------------

# Tools and their parameters; a tuple lists the options of a string.
TOOLS: dict[str, dict[str, object]] = {
    "search_document": {"query": "string"},
    "calculate": {"expression": "string"},
    "set_alarm": {"time": "string", "label": "string"},
    "set_timer": {"duration_seconds": "integer", "label": "string"},
    "set_reminder": {"datetime": "string", "message": "string"},
    "send_sms": {"contact": "string", "message": "string"},
    "make_call": {"contact": "string"},
    "toggle_setting": {"setting_name": ("wifi", "bluetooth", "airplane_mode", "flashlight", "silent_mode", "data_saver", "location"), "state": "boolean"},
    "set_volume": {"level": "integer", "stream": ("media", "ringtone", "alarm", "call")},
    "set_brightness": {"level": "integer"},
    "open_app": {"app_name": "string"},
    "get_battery_status": {},
    "get_device_time": {},
    "take_note": {"text": "string"},
    "lock_device": {},
    "capture_photo": {"camera": ("front", "back")},
}
# Forms to extract; a list holds what each of its members has.
FORMS: dict[str, dict[str, object]] = {
    "contact_card": {"full_name": "string", "phone_number": "string", "email": "string", "occupation": "string", "location": "string"},
    "event_invite": {"event_name": "string", "date": "string", "time": "string", "venue": "string", "organizer": "string"},
    "product_listing": {"product_name": "string", "price": "string", "currency": "string", "seller": "string", "quantity_available": "integer"},
    "job_posting": {"job_title": "string", "company": "string", "location": "string", "salary_range": "string", "application_deadline": "string"},
    "trip_itinerary": {"origin": "string", "destination": "string", "departure_date": "string", "transport_mode": "string", "fare": "string"},
    "invoice_line_items": {"vendor": "string", "items": [{"description": "string", "quantity": "integer", "unit_price": "number"}], "total": "number"},
    "school_result_slip": {"student_name": "string", "class_level": "string", "term": "string", "subjects": [{"subject": "string", "score": "integer"}], "overall_average": "number"},
    "farm_market_report": {"market_name": "string", "date": "string", "commodities": [{"commodity": "string", "price_per_unit": "string", "trend": ("up", "down", "stable")}]},
    "clinic_appointment": {"patient_name": "string", "clinic_name": "string", "appointment_date": "string", "appointment_time": "string", "reason": "string"},
    "utility_bill": {"account_name": "string", "provider": "string", "billing_period": "string", "amount_due": "number", "due_date": "string"},
}


def schema_of(short: object) -> dict:
    """The JSON schema of an entry of TOOLS or FORMS."""
    if isinstance(short, dict):
        return {"type": "object", "properties": {k: schema_of(v) for k, v in short.items()}, "required": [*short]}
    if isinstance(short, list):
        return {"type": "array", "items": schema_of(short[0])}
    return {"type": "string", "enum": [*short]} if isinstance(short, tuple) else {"type": short}


def argument_problems(tool: Column, arguments: Column, own: Column | None = None) -> Column:
    """Null if a call is fine, 'unknown tool', or the problems of its JSON arguments (empty arguments count as {}).

    ``own``: names of the tools that the row offers; beyond them the tools of TOOLS are known."""
    said = F.when(F.coalesce(F.trim(arguments), F.lit("")) == "", "{}").otherwise(arguments)
    found = F.lit("unknown tool")
    for name, short in TOOLS.items():
        found = F.when(tool == name, json_problems(said, schema_of(short))).otherwise(found)
    if own is not None:
        found = F.when((found == "unknown tool") & F.coalesce(F.array_contains(own, tool), F.lit(False)), json_problems(said, {"type": "object"})).otherwise(found)
    return F.nullif(found, F.lit(""))
