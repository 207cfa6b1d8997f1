"""Text functions. White space is Unicode's: `(?U)` in patterns, since Java's \\s is ASCII alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"(?U)\s+"
# Punctuation that names are compared without.
NAME_PUNCTUATION = r"(?U)[\s　·•,，、;；:：（）()【】\[\]{}\-_/]+"

# Fields of a structured description, their labels, and the keys each is known by.
DESCRIPTION_SECTION = "【识别特征】"
DESCRIPTION_FIELDS = [
    ("mainIngredients", "主食材", ["mainIngredients", "main_ingredients", "ingredients", "mainIngredient"]),
    ("colors", "颜色", ["colors", "color", "colour"]),
    ("cuts", "切法/形态", ["cuts", "shapes", "shape", "forms"]),
    ("texture", "质地", ["texture"]),
    ("sauce", "汁感", ["sauce", "sauciness", "gravy"]),
    ("garnishes", "常见配菜", ["garnishes", "sideIngredients", "side_ingredients", "side_dishes"]),
    ("confusableWith", "易混淆菜", ["confusableWith", "confusable_with", "similarDishes", "similar_dishes"]),
]


def squeezed(text: Column) -> Column:
    """Trimmed, with each run of white space as one space; null is empty (F1)."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " "))


def stripped(text: Column) -> Column:
    """Without white space at either end, tabs and ideographic spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def name_key(name: Column) -> Column:
    """Lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), NAME_PUNCTUATION, "")


def allow_list(value: Column) -> Column:
    """Distinct squeezed entries, in order, of a JSON list or a list by commas and lines (F2)."""
    text = F.trim(F.coalesce(value, F.lit("")))
    listed = F.split(F.regexp_replace(text, "[\\r\\n，]", ","), ",", -1)
    items = F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), listed)).otherwise(listed)
    return F.array_distinct(F.filter(F.transform(items, squeezed), lambda x: x != ""))


def merged_notes(*notes: Column) -> Column:
    """Distinct non-empty notes, in order, joined by a semicolon."""
    trimmed = F.transform(F.array(*notes), lambda x: stripped(F.coalesce(x, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda x: x != "")), "；")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with `value` computed once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def description(raw: Column) -> Column:
    """A JSON object as the seven fields, each from its first non-blank alias; else empty."""

    def fields(found: Column) -> Column:
        first = lambda aliases: F.coalesce(*(F.nullif(stripped(F.try_element_at(found, F.lit(a))), F.lit("")) for a in aliases), F.lit(""))
        return F.struct(*(first(aliases).alias(key) for key, _, aliases in DESCRIPTION_FIELDS))

    return bound(F.from_json(raw, "map<string,string>"), fields)


def composed_description(summary: Column, fields: Column) -> Column:
    """Summary, then the section mark and a labelled line for each field that isn't blank."""

    def whole(fields: Column) -> Column:
        pairs = F.array(*(F.struct(F.lit(f"{label}：").alias("label"), stripped(fields[key]).alias("text")) for key, label, _ in DESCRIPTION_FIELDS))
        lines = F.transform(F.filter(pairs, lambda p: p["text"] != ""), lambda p: F.concat(p["label"], p["text"]))
        head = F.nullif(stripped(F.replace(F.coalesce(summary, F.lit("")), F.lit("\r\n"), F.lit("\n"))), F.lit(""))
        return bound(lines, lambda x: F.concat_ws("\n\n", head, F.when(F.size(x) > 0, F.concat(F.lit(DESCRIPTION_SECTION + "\n"), F.array_join(x, "\n")))))

    return bound(fields, whole)


def parsed_description(text: Column) -> Column:
    """The struct (summary, fields) of a composed text; lines of the section without a known label go to
    the summary. Either colon ends a label; of two lines with one label the later counts (F18)."""
    names = F.array(*(F.lit(label) for _, label, _ in DESCRIPTION_FIELDS))
    cut = lambda x: F.regexp_extract(x, "^([^：:]*)[：:]", 1)
    known = lambda x: x.rlike("[：:]") & F.array_contains(names, cut(x))

    def parts(at: Column, lines: Column) -> Column:
        head = F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)
        tail = F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
        kept = bound(head, lambda h: F.filter(h, lambda x, i: (x != "") | ((i > 0) & (F.get(h, i - 1) != ""))))
        return bound(tail, lambda t: F.struct(summary(kept, t).alias("summary"), fields(t).alias("fields")))

    def summary(kept: Column, tail: Column) -> Column:
        rest = F.filter(tail, lambda x: (x != "") & (x != DESCRIPTION_SECTION) & ~known(x))
        return stripped(F.array_join(F.concat(kept, rest), "\n"))

    def fields(tail: Column) -> Column:
        named = F.filter(tail, known)
        last = lambda m, label: F.coalesce(F.try_element_at(m, F.lit(label)), F.lit(""))
        entries = F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != cut(x)), F.create_map(cut(x), stripped(F.regexp_replace(x, "^[^：:]*[：:]", "")))))
        return bound(entries, lambda m: F.struct(*(last(m, label).alias(key) for key, label, _ in DESCRIPTION_FIELDS)))

    lines = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1), stripped)
    return bound(lines, lambda x: bound(F.array_position(x, DESCRIPTION_SECTION).cast("int"), lambda at: parts(at, x)))


def json_block(text: Column) -> Column:
    """The JSON object in a model's answer: of a fenced block, else from the first to the last brace; null
    if there is none that parses (F20)."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    found = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def filled(template: str, values: dict[str, Column]) -> Column:
    """`template` with {name} replaced for each of `values`; all other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def masked(name: Column) -> Column:
    """First character and a star; two stars for no name."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("**")).otherwise(F.concat(F.substring(name, 1, 1), F.lit("*")))


def byte_size(n: Column) -> Column:
    """1536 -> 1.5 KB, a tie to the even digit."""
    units = ["B", "KB", "MB", "GB", "TB"]
    size = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("double")
    out = F.format_string("%.1f TB", F.bround(size / 1024.0**4, 1))
    for i in range(3, 0, -1):
        out = F.when(size < 1024.0 ** (i + 1), F.format_string(f"%.1f {units[i]}", F.bround(size / 1024.0**i, 1))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).otherwise(out)


def role(title: Column, job_number: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The role of the first rule whose pattern the title or job number matches."""
    text = F.concat_ws(" ", title, job_number)
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def id_list(text: Column) -> Column:
    """Distinct integers, in order, of a JSON list or a comma list; what is no integer is left out."""
    items = F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.split(text, ",", -1))
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull()))


def image_url(path: Column, root: str, base: str = "/images/") -> Column:
    """Web address of a stored path: addresses stay; others lose `root` and are percent-encoded part by
    part (P2). url_encode writes a space as +, so that is put right."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), f"^{root.rstrip('/')}/?", "")
    parts = F.transform(F.split(F.ltrim(clean), "/", -1), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    kept = path.rlike("^https?://") | path.startswith(base)
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit(None)).when(kept, path).otherwise(
        F.concat(F.lit(base), F.array_join(F.filter(parts, lambda p: p != ""), "/"))
    )


def bytes_of_data_url(value: Column) -> Column:
    """The bytes of base64 text, with or without a data-URL prefix."""
    return F.unbase64(F.when(value.startswith("data:"), F.substring_index(value, ",", -1)).otherwise(value))


def option_lines(names: list[tuple[str, Column]]) -> Column:
    """label: value lines of the values that aren't blank."""
    return F.concat_ws("\n", *(F.when(stripped(v.cast("string")) != "", F.concat(F.lit(f"{k}: "), stripped(v.cast("string")))) for k, v in names))


def truncated_tokens(tokens: Column, special: list, most: int) -> Column:
    """At most `most` of the tokens, in order: every special one, and as many of the others from the front
    as there is room for; more only if there are more special ones (F41). One pass finds the last that
    stays."""
    is_special = lambda x: F.array_contains(F.array(*map(F.lit, special)), x)
    plain = F.filter(F.transform(tokens, lambda x, i: F.when(~is_special(x), i)), lambda i: i.isNotNull())
    room = most - (F.size(tokens) - F.size(plain))

    def cut(last: Column) -> Column:
        return F.filter(tokens, lambda x, i: is_special(x) | (i <= last))

    last = F.when(room > 0, F.coalesce(F.get(plain, room - 1), F.size(tokens))).otherwise(-1)
    return F.when(F.size(tokens) <= most, tokens).otherwise(bound(last, cut))
