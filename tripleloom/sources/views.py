"""SQL views: a query over files named in it, run as Spark SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from . import Context, SourceError
from .files import csv_file

FILE = r"'([^']+\.(?:csv|tsv|parquet|json|jsonl|ndjson|orc))'"
READ = re.compile(rf"\bread_(csv|csv_auto|parquet|json|json_auto)\s*\(\s*{FILE}\s*((?:,\s*\w+\s*=\s*(?:'[^']*'|\w+)\s*)*)\)", re.I)
TABLE = re.compile(rf"((?:\bFROM|\bJOIN|,)\s+){FILE}", re.I)
UNNEST = re.compile(r"\bUNNEST\s*\(\s*((?:\"[^\"]+\"|[\w.])+)\s*::\s*(?:VARCHAR|TEXT|STRING)\s*\[\s*\]\s*\)", re.I)


def _view(ctx: Context, path: str, options: str = "") -> str:
    given = {k.lower(): v.strip("'") for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|\w+)", options)}
    name, path = f"v_{uuid.uuid4().hex}", ctx.path(path)
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("csv", "tsv"):
        df = csv_file(ctx, path, [], given.get("delim") or given.get("sep") or ("\t" if ext == "tsv" else None), infer=given.get("all_varchar", "false").lower() != "true")
    elif ext in ("json", "jsonl", "ndjson"):
        df = ctx.spark.read.option("multiLine", str(ext == "json").lower()).json(path)
    else:
        df = ctx.spark.read.format(ext).load(path)
    df.createOrReplaceTempView(name)
    return name


#: Functions that Spark names otherwise, with the same arguments.
NAMES = {
    "json_extract_string": "get_json_object", "list_contains": "array_contains", "list_has": "array_contains", "array_to_string": "array_join", "list_transform": "transform", "list_apply": "transform", "array_transform": "transform",
    "list_filter": "filter", "array_filter": "filter", "list_distinct": "array_distinct", "list_sort": "sort_array", "list_reverse": "reverse", "list_concat": "concat", "list_cat": "concat", "list_extract": "try_element_at",
    "list_element": "try_element_at", "list_value": "array", "list_min": "array_min", "list_max": "array_max", "flatten_list": "flatten", "starts_with": "startswith", "prefix": "startswith", "ends_with": "endswith", "suffix": "endswith", "regexp_matches": "regexp_like",
    "strlen": "octet_length", "epoch_ms": "unix_millis", "epoch_us": "unix_micros", "epoch": "unix_seconds", "dayname": "loom_dayname", "monthname": "loom_monthname", "str_split": "string_split", "string_to_array": "string_split", "str_split_regex": "string_split_regex",
    "regexp_split_to_array": "string_split_regex", "list": "collect_list", "array_agg": "collect_list", "arg_max": "max_by", "arg_min": "min_by", "quantile_cont": "percentile", "gen_random_uuid": "uuid", "isodow": "loom_isodow",
}
#: Functions that Spark writes with others; {0}, {1} are the arguments.
MADE = {
    "string_split": "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)", "string_split_regex": "split({0}, {1}, -1)",
    "loom_dayname": "date_format({0}, 'EEEE')", "loom_monthname": "date_format({0}, 'MMMM')", "loom_isodow": "(weekday({0}) + 1)",
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose opening parenthesis stands before ``at``, and the place after its closing one."""
    out, depth, last, k = [], 0, at, at
    while k < len(text):
        c = text[k]
        if c in "'\"":
            k = text.index(c, k + 1)
        elif c in "([":
            depth += 1
        elif c in ")]" and depth:
            depth -= 1
        elif c in "),":
            if depth == 0:
                out.append(text[last:k].strip())
                last = k + 1
                if c == ")":
                    return out, k + 1
        k += 1
    raise SourceError(f"unbalanced parentheses in {text!r}")


def expand(text: str) -> str:
    """Calls of MADE functions written out, inner ones too."""
    for name, body in MADE.items():
        while found := re.search(rf"\b{name}\s*\(", text):
            own, end = _arguments(text, found.end())
            text = text[: found.start()] + body.format(*own) + text[end:]
    return text


CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "-d": "d", "-m": "M", "-H": "H", "-M": "m", "-S": "s", "-I": "h", "%": "'%'", "g": "SSS"}
STRF = re.compile(r"\bstr([fp])time\s*\(((?:[^()']|\([^()]*\))*?),\s*'((?:[^']|'')*)'\s*\)", re.I)


def time_pattern(codes: str) -> str:
    """A pattern of % codes in the letters that Spark's date functions take; other letters are quoted."""
    out = []
    for code, other in re.findall(r"%(-?.)|([^%]+)", codes):
        if code and code not in CODES:
            raise SourceError(f"no %{code} in a time pattern")
        out.append(CODES[code] if code else re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", other))
    return "".join(out).replace("'", "\\'")


def translate(text: str) -> str:
    """The few words that the dialects write differently, outside of quoted text."""
    text = UNNEST.sub(r"explode(from_json(concat('[\"', regexp_replace(regexp_replace(trim(\1), '^\\\\[|\\\\]$', ''), '\\\\s*,\\\\s*', '\",\"'), '\"]'), 'array<string>'))", text)
    text = STRF.sub(lambda m: f"{'date_format' if m[1] in 'fF' else 'to_timestamp'}({m[2]}, '{time_pattern(m[3])}')", text)
    parts = re.split(r"('(?:[^'\\\\]|''|\\\\.)*'|\"[^\"]*\")", text)
    for k in range(0, len(parts), 2):
        p = re.sub(r"\blambda\s+(\w+)\s*:", r"\1 ->", parts[k], flags=re.I)
        p = re.sub(r"\b(\w+)(?=\s*\()", lambda m: NAMES.get(m[1].lower(), m[1]), p)
        p = re.sub(r"\b(VARCHAR|TEXT)\b(?!\s*\()", "STRING", p, flags=re.I)
        p = re.sub(r"\b(u?bigint|hugeint)\b", "BIGINT", p, flags=re.I)
        parts[k] = re.sub(r"\bUNNEST\s*\(", "explode(", p, flags=re.I)
    return "".join(parts)


def sql_view(ctx: Context, query: str) -> DataFrame:
    text = READ.sub(lambda m: _view(ctx, m[2], m[3]), query.strip().rstrip(";"))
    text = TABLE.sub(lambda m: m[1] + _view(ctx, m[2]), text)
    name = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = ctx.spark.conf.get(name)
    try:
        ctx.spark.conf.set(name, "true")
        return ctx.spark.sql(expand(translate(text)))
    finally:
        ctx.spark.conf.set(name, before)
