"""Readers' JSON replies as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import strip, strip_echo

_REGION = "array<struct<type:string,bbox_norm:array<double>,caption:string>>"


def json_body(raw: Column) -> Column:
    """The outermost braces of a reply, fenced or not; null if there are none."""
    return F.nullif(F.regexp_extract(strip(raw), r"(?s)(\{.*\})", 1), F.lit(""))


def parse_reply(raw: Column) -> Column:
    """struct(markdown, number, confidence, regions, flags, error) of a page reply.

    Unknown confidences are low; numbers that are strings are null, fractions are cut; boxes
    need four numbers, are clamped to 0..1 and ordered; flags that aren't strings go; recited
    instructions are cut off and flagged.  What can't be parsed has error and nothing else.
    """
    # Transforming one-element arrays binds the parsed reply and its text, so that each is made once.
    whole = F.array(F.struct(F.try_parse_json(json_body(raw)).alias("v"), json_body(raw).isNull().alias("bare")))
    return F.get(F.transform(whole, lambda x: _parsed(x["v"], x["bare"])), 0)


def _parsed(v: Column, bare: Column) -> Column:
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    is_text = F.schema_of_variant(F.variant_get(v, "$.markdown", "variant")) == "STRING"
    markdown = F.when(F.coalesce(is_text, F.lit(False)), get("$.markdown", "string"))
    return F.get(F.transform(F.array(F.struct(markdown.alias("raw"), strip_echo(markdown).alias("clean"))), lambda m: _checked(v, bare, m["raw"], m["clean"])), 0)


def _checked(v: Column, bare: Column, markdown: Column, clean: Column) -> Column:
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    echoed = clean != markdown
    said = get("$.confidence", "string")
    confidence = F.when(echoed, "low").when(said.isin("high", "medium", "low"), said).otherwise("low")
    numeric = F.schema_of_variant(F.variant_get(v, "$.page_number_printed", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    number = F.when(numeric, get("$.page_number_printed", "double")).cast("int")
    number = F.when(numeric, F.coalesce(number, get("$.page_number_printed", "boolean").cast("int")))
    items = F.coalesce(get("$.regions", "array<variant>"), F.array().cast("array<variant>"))
    box = lambda r: F.transform(F.try_variant_get(r, "$.bbox_norm", "array<double>"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))

    def region(r: Column) -> Column:
        b = box(r)
        x, y = (F.sort_array(F.array(F.get(b, i), F.get(b, i + 2))) for i in (0, 1))
        ordered = F.array(F.get(x, 0), F.get(y, 0), F.get(x, 1), F.get(y, 1))
        kind = F.coalesce(F.try_variant_get(r, "$.type", "string"), F.lit("figure"))
        return F.struct(kind.alias("type"), ordered.alias("bbox_norm"), F.coalesce(F.try_variant_get(r, "$.caption", "string"), F.lit("")).alias("caption"))

    whole = F.filter(items, lambda r: F.coalesce((F.size(box(r)) == 4) & ~F.exists(box(r), lambda x: x.isNull()), F.lit(False)))
    raw_flags = F.coalesce(get("$.flags", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(raw_flags, lambda f: F.schema_of_variant(f) == "STRING")
    flags = F.transform(texts, lambda f: F.try_variant_get(f, "$", "string"))
    flags = F.when(echoed, F.concat(flags, F.array(F.lit("prompt_echo")))).otherwise(flags)
    error = F.when(bare, "no_json").when(v.isNull(), "bad_json").when(markdown.isNull(), "no_markdown")
    ok = error.isNull()
    return F.struct(
        clean.alias("markdown"),
        F.when(ok, number).alias("number"),
        F.when(ok, confidence).alias("confidence"),
        F.when(ok, F.transform(whole, region)).alias("regions"),
        F.when(ok, flags).alias("flags"),
        error.alias("error"),
    )


def salvage(raw: Column) -> Column:
    """The text of a reply that was cut off inside its markdown string; null if under three characters."""
    inner = F.regexp_extract(raw, r'(?s)"markdown"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    plain = F.regexp_replace(inner, r"\\n", "\n")
    for mark, char in (("t", "\t"), ("r", "\r")):
        plain = F.regexp_replace(plain, rf"\\{mark}", char)
    plain = strip_echo(strip(F.regexp_replace(plain, r"\\(.)", "$1")))
    return F.when(F.length(plain) >= 3, plain)


def salvage_objects(raw: Column) -> Column:
    """Flat JSON objects found anywhere in a reply, as strings that parse."""
    return F.filter(F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull())


def _findings(items: Column) -> Column:
    """Findings with a quote among the JSON objects: unknown types are other, severities low; quotes and notes are cut."""
    get = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    quoted = F.filter(items, lambda v: F.coalesce(get(v, "quote"), F.lit("")) != "")
    either = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return F.transform(
        quoted,
        lambda v: F.struct(
            either(get(v, "type"), "other").alias("type"),
            either(get(v, "severity"), "low").alias("severity"),
            F.substring(get(v, "quote"), 1, 200).alias("quote"),
            get(v, "replacement").alias("replacement"),
            F.substring(F.coalesce(get(v, "note"), F.lit("")), 1, 300).alias("note"),
        ),
    )


def model_findings(raw: Column) -> Column:
    """A review's findings, array of struct(type, severity, quote, replacement, note); of a broken reply what is whole in it."""
    none = F.array().cast("array<variant>")
    whole = F.try_parse_json(json_body(raw))
    listed = F.coalesce(F.try_variant_get(whole, "$.findings", "array<variant>"), none)
    parts = F.transform(salvage_objects(F.coalesce(raw, F.lit(""))), lambda x: F.try_parse_json(x))
    return _findings(F.when(whole.isNotNull(), listed).otherwise(parts))


def _text(v: Column, name: str) -> Column:
    return strip(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def _said(items: Column) -> Column:
    """Quotes of eight characters or more with their speaker, the narrator where none is named."""
    quotes = F.transform(items, lambda v: F.struct(_text(v, "quote").alias("q"), F.coalesce(F.nullif(_text(v, "speaker"), F.lit("")), F.lit("NARRATOR")).alias("speaker")))
    return F.filter(quotes, lambda q: F.length(q["q"]) >= 8)


def _people(items: Column) -> Column:
    people = F.transform(items, lambda v: F.struct(*(_text(v, n).alias(n) for n in ("name", "description", "sounds_like"))))
    return F.filter(people, lambda p: p["name"] != "")


def cast_reply(raw: Column, most: int = 400) -> Column:
    """struct(characters, quotes, error) of a cast analysis, at most so many quotes.

    Of a reply that can't be parsed, the whole objects in it: those with a quote are quotes,
    others with a name characters.  error is no_json or bad_json where that leaves nothing.
    """
    none = F.array().cast("array<variant>")
    whole, bare = F.try_parse_json(json_body(raw)), json_body(raw).isNull()
    listed = lambda name: F.coalesce(F.try_variant_get(whole, f"$.{name}", "array<variant>"), none)
    parts = F.transform(salvage_objects(F.coalesce(raw, F.lit(""))), lambda x: F.try_parse_json(x))
    quoted = F.filter(parts, lambda v: _text(v, "quote") != "")
    named = F.filter(parts, lambda v: _text(v, "quote") == "")
    ok = whole.isNotNull()
    people = _people(F.when(ok, listed("characters")).otherwise(named))
    said = F.slice(_said(F.when(ok, listed("quotes")).otherwise(quoted)), 1, most)
    empty = (F.size(people) == 0) & (F.size(said) == 0)
    error = F.when(~ok & empty, F.when(bare, "no_json").otherwise("bad_json"))
    return F.struct(people.alias("characters"), said.alias("quotes"), error.alias("error"))


def figure_boxes(raw: Column) -> Column:
    """array<struct(bbox, caption)> of a reply's figures: four numbers within the page, over 0.03 a side, captions cut to 200."""
    whole = F.try_parse_json(json_body(raw))
    items = F.coalesce(F.try_variant_get(whole, "$.figures", "array<variant>"), F.array().cast("array<variant>"))

    def numbers(v: Column) -> Column:
        values = F.coalesce(F.try_variant_get(v, "$.bbox", "array<variant>"), F.array().cast("array<variant>"))
        plain = F.filter(values, lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"))
        inside = F.transform(plain, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "boolean").cast("double")))))
        return F.when((F.size(values) == 4) & (F.size(plain) == 4), inside)

    boxes = F.transform(items, lambda v: F.struct(numbers(v).alias("bbox"), F.substring(F.coalesce(F.try_variant_get(v, "$.caption", "string"), F.lit("")), 1, 200).alias("caption")))
    return F.filter(boxes, lambda b: F.coalesce((b["bbox"][2] - b["bbox"][0] > 0.03) & (b["bbox"][3] - b["bbox"][1] > 0.03), F.lit(False)))
