"""JSON and XML over HTTP: fetched by the driver, with the parameters and headers that the mapping gives."""

from __future__ import annotations

import json
import os
import re
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame

from ..mapping.rules import LogicalSource
from . import Context
from .nested import json_rows, json_text


def fetch(url: str, headers: dict | None = None, params: dict | None = None) -> str:
    if params:
        url += ("&" if "?" in url else "?") + urlencode(params)
    with urlopen(Request(url, headers=headers or {}), timeout=60) as r:  # noqa: S310
        return r.read().decode(r.headers.get_content_charset() or "utf-8")


def token(ctx: Context, text: str) -> str:
    """A header's value: environment variables for {NAME}, and for get_api_token(...) the function of the token module."""
    if m := re.fullmatch(r"\{?get_api_token\((.*)\)\}?", text.strip()):
        space: dict = {}
        with open(ctx.config.api_token, encoding="utf-8") as f:
            exec(compile(f.read(), ctx.config.api_token, "exec"), space)
        args = dict(re.findall(r"(\w+)\s*=\s*['\"]?([^,'\"]*)['\"]?", m[1]))
        return str(space["get_api_token"](**args))
    return re.sub(r"\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), text)


FILTERED = re.compile(r"^(?P<array>[\w.]+)\[\?\(\s*@\.(?P<key>[\w.]+)\s*==\s*['\"](?P<value>[^'\"]*)['\"]\s*\)\]\.(?P<field>[\w.]+)$")


def read(ctx: Context, source: LogicalSource, references: list[str]) -> DataFrame:
    """References of the form ``list[?(@.key=='value')].field`` pick the first element of the list whose key has the value."""
    api = ctx.http[source.value]
    text = fetch(api["url"], {k: token(ctx, v) for k, v in api.get("headers", {}).items()}, {k: token(ctx, v) for k, v in api.get("params", {}).items()})
    plain = [r for r in references if not FILTERED.match(r)]
    if len(plain) == len(references):
        return json_rows(json_text(ctx, text), source.iterator, references)
    picked = {r: FILTERED.match(r) for r in references if r not in plain}
    doc = json.loads(text)
    items = doc if isinstance(doc, list) else [doc]
    for step in re.findall(r"\.([\w-]+)", source.iterator or ""):
        items = [v for i in items for v in (i.get(step, []) if isinstance(i.get(step), list) else [i.get(step)]) if v is not None]
    lines = []
    for i in items:
        own = dict(i)
        for n, m in enumerate(picked.values()):
            hit = next((e for e in i.get(m["array"], []) if str(e.get(m["key"])) == m["value"]), {})
            own[f"__f{n}"] = hit.get(m["field"])
        lines.append(own)
    names = {r: f"__f{n}" for n, r in enumerate(picked)}
    df = json_rows(json_text(ctx, json.dumps(lines)), "$[*]", [names.get(r, r) for r in references])
    return df.toDF(*references)


