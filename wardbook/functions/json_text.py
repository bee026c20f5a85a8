"""Reading and writing JSON text inside columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardbook import fixed_values as fv


def json_object_in(text: Column) -> Column:
    """from the first ``{`` to the last ``}``, null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def parsed_object(json_text: Column) -> Column:
    """The text as a one-element VARIANT array, null unless it is one JSON value.

    The JSON reader stops after the first value; inside brackets, text that
    follows that value either fails to parse or shows up as a second element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), json_text, F.lit("]")))
    second = F.variant_get(wrapped, "$[1]", "variant")
    return F.when(second.isNull(), wrapped)


def _field(parsed: Column, key: str) -> Column:
    return F.variant_get(parsed, f"$[0].{key}", "variant")


def _text_field(parsed: Column, key: str) -> Column:
    return F.try_variant_get(parsed, f"$[0].{key}", "string")


def _list_field(parsed: Column, key: str) -> Column:
    listed = F.try_variant_get(parsed, f"$[0].{key}", "array<string>")
    single = F.array(_text_field(parsed, key))
    return F.when(
        ~F.is_variant_null(_field(parsed, key)), F.coalesce(listed, single)
    )


def default_draft() -> dict[str, Column]:
    """F8: the draft without any answer."""
    no_items = F.array().cast("array<string>")
    texts = {key: F.lit(text) for key, text in fv.DRAFT_TEXT_DEFAULTS.items()}
    draft = {key: texts.get(key, no_items) for key in fv.DRAFT_KEYS}
    return {**draft, "extra": F.lit(None).cast("map<string,string>")}


def overlay_draft(parsed: Column, found: Column) -> dict[str, Column]:
    """F8: draft columns from a model's answer laid over the default draft.

    ``found`` is the answer's object as text and ``parsed`` its ``parsed_object``.
    A key the answer holds replaces the default, a JSON null included; a key it
    lacks keeps the default; an answer without one JSON object keeps them all.
    ``extra`` holds every other key of the answer as a map of JSON texts.
    """
    defaults = default_draft()
    draft = {}
    for key in fv.DRAFT_KEYS:
        read = _text_field if key in fv.DRAFT_TEXT_DEFAULTS else _list_field
        absent = _field(parsed, key).isNull()
        draft[key] = F.when(absent, defaults[key]).otherwise(read(parsed, key))
    every_key = F.from_json(F.when(parsed.isNotNull(), found), "map<string,string>")
    draft["extra"] = F.map_filter(every_key, lambda k, _: ~k.isin(*fv.DRAFT_KEYS))
    return draft


def default_analysis() -> dict[str, Column]:
    """the analysis without a readable answer."""
    notes = zip(fv.ANALYSIS_KEYS, fv.ANALYSIS_UNAVAILABLE, strict=True)
    return {key: F.lit(text) for key, text in notes}


def analysis_fields(parsed: Column) -> dict[str, Column]:
    """the analysis a model answered, or the fixed fallback.

    An answer that is one JSON object is taken as it is, so a key it lacks is null.
    """
    return {
        key: F.when(parsed.isNull(), fallback).otherwise(_text_field(parsed, key))
        for key, fallback in default_analysis().items()
    }


def json_row(*columns: Column | str, keep_nulls: bool = True, pretty: bool = False) -> Column:
    """The columns as one JSON object."""
    options = {"ignoreNullFields": str(not keep_nulls).lower(), "pretty": str(pretty).lower()}
    return F.to_json(F.struct(*columns), options)


def json_string(text: Column) -> Column:
    """One JSON string literal, ``null`` for null."""
    listed = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return F.regexp_extract(listed, r"(?s)^\[(.*)\]$", 1)


def indented_list(items: Column, indent: int) -> Column:
    """JSON array of already rendered items, one per line, two spaces per level."""
    pad = "\n" + " " * indent
    lines = F.array_join(items, "," + pad)
    closing = "\n" + " " * (indent - 2)
    full = F.concat(F.lit("[" + pad), lines, F.lit(closing + "]"))
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(full)


def indented_visits(visits: Column) -> Column:
    """visits (date, diagnosis, medication, symptoms) as indented JSON."""

    def visit(v: Column) -> Column:
        symptoms = indented_list(F.transform(v["symptoms"], json_string), 6)
        members = [
            F.concat(F.lit(f'    "{name}": '), value)
            for name, value in (
                ("date", json_string(v["date"])),
                ("diagnosis", json_string(v["diagnosis"])),
                ("medication", json_string(v["medication"])),
                ("symptoms", symptoms),
            )
        ]
        return F.concat(F.lit("{\n"), F.concat_ws(",\n", *members), F.lit("\n  }"))

    return indented_list(F.transform(visits, visit), 2)
