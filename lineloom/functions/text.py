"""Text columns: white space, words, tags, JSON salvage, prompt pieces, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character in the sense of Unicode-aware splitting; the same class works in Java and RE2.
WS = r"[\s\x0B\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def squash(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def words(text: Column) -> Column:
    """Words between white space; none for empty text."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines between newlines; the empty text has one empty line."""
    return F.split(text, "\n", -1)


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else null: an empty value counts as missing."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def tag(text: Column, name: str) -> Column:
    """Content of the first <name>...</name>, without white space next to the tags; '' if there is none."""
    return F.regexp_extract(text, rf"(?s)<{name}>\s*\n?(.*?)\n?\s*</{name}>", 1)


def unfence(text: Column) -> Column:
    """Without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```\s*$", "")


def salvage_json(text: Column, schema: str) -> Column:
    """The JSON in a reply: the reply without fences, else from the first brace to the last; null if neither parses."""
    plain = unfence(text)
    braces = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    parse = lambda c: F.when(c.startswith("{"), F.from_json(c, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return F.coalesce(parse(plain), parse(braces))


def string_list(text: Column) -> Column:
    """A JSON list of strings, or a comma-separated one; [] for null and empty text."""
    by_comma = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), by_comma, F.array().cast("array<string>"))


def repo_of(instance_id: Column) -> Column:
    """All before the last hyphen; the whole id without one."""
    return F.when(instance_id.contains("-"), F.regexp_extract(instance_id, r"(?s)^(.*)-[^-]*$", 1)).otherwise(instance_id)


def issue_url(instance_id: Column, repo: Column) -> Column:
    """Address of the issue that an id ends in; the open list of issues if it doesn't end in a number."""
    n = F.regexp_extract(instance_id, r"-(\d+)$", 1)
    base = F.concat(F.lit("https://api.github.com/repos/"), repo, F.lit("/issues"))
    return F.when(n != "", F.concat(base, F.lit("/"), n)).otherwise(F.concat(base, F.lit("?per_page=5&state=all")))


def urls(text: Column) -> Column:
    """Links in a text, without the punctuation after them; quotes, backticks and angle brackets end a link."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"`'<>]+"), 0), lambda u: F.regexp_replace(u, r"[.,;)]+$", ""))


#: Repositories whose package has another name.
IMPORT_NAMES = {"scikit-learn": "sklearn", "scikit-image": "skimage", "pillow": "PIL", "pyyaml": "yaml", "python-dateutil": "dateutil", "beautifulsoup4": "bs4"}


def import_name(repo: Column) -> Column:
    """The package a repository is imported as."""
    name = F.when(repo.contains("/"), F.get(F.split(repo, "/"), F.lit(1))).otherwise(repo)
    known = F.create_map(*(F.lit(x) for pair in IMPORT_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(name)), F.replace(name, F.lit("-"), F.lit("_")))


def line_numbers(reply: Column) -> Column:
    """Line numbers in a reply: a list under one of three keys of a JSON object, a bare JSON list, else the first
    bracketed list of digits; null if there is none. Fractions are cut off, items that are no numbers left out."""
    s = strip(reply)
    parsed = F.try_parse_json(s)
    kind = F.schema_of_variant(parsed)
    number = lambda v: F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(~F.schema_of_variant(v).isin("STRING", "VOID"), F.try_variant_get(v, "$", "double"))
    whole = lambda xs: F.filter(F.transform(xs, number), lambda x: x.isNotNull())
    listed = [F.try_variant_get(parsed, f"$.{k}", "array<variant>") for k in ("lines", "line_numbers", "relevant_lines")]
    bare = F.try_variant_get(parsed, "$", "array<variant>")
    found = F.when(kind.startswith("OBJECT"), F.coalesce(*listed)).when(kind.startswith("ARRAY"), bare)
    digits = F.from_json(F.nullif(F.regexp_extract(reply, r"(\[[\d,\s]+\])", 1), F.lit("")), "array<int>")
    return F.coalesce(F.transform(whole(found), lambda x: x.cast("int")), F.when(F.size(digits) > 0, digits))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def module_of(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")
