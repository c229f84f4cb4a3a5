"""JSON and XML. Arrays below a reference are exploded, independent ones give their product; a missing or null value drops the row later."""

from __future__ import annotations

import re
import tempfile
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lexical import lexical
from . import Context, SourceError, col

STEP = re.compile(r"\.\.|\.?\*|\.([^.\[\]*]+)|\[\s*(?:'([^']*)'|\"([^\"]*)\"|(\*|\d+))\s*\]")


def json_path(path: str | None) -> list:
    """Steps of a JSONPath: names, numbers, or '*'."""
    path = (path or "$").strip()
    if not path.startswith("$"):
        path = "$." + path
    steps, k = [], 1
    while k < len(path):
        m = STEP.match(path, k)
        if not m or m[0] == "..":
            raise SourceError(f"unsupported JSONPath {path!r}")
        name = m[1] or m[2] or m[3]
        steps.append(name if name is not None else "*" if m[4] in (None, "*") else int(m[4]))
        k = m.end()
    return steps


def iterate(df: DataFrame, steps: list) -> DataFrame:
    """Rows of column ``item`` after the steps."""
    for n, s in enumerate(steps):
        kind = df.schema["item"].dataType
        if isinstance(s, int):
            if not isinstance(kind, T.ArrayType):
                return df.limit(0)
            df = df.select(F.get("item", s).alias("item"))
        elif s == "*":
            if isinstance(kind, T.ArrayType):
                df = df.select(F.explode("item").alias("item"))
            elif isinstance(kind, T.StructType):
                parts = [iterate(df.select(F.col("item")[f.name].alias("item")).where("item is not null"), steps[n + 1 :]) for f in kind.fields]
                parts = [p for p in parts if not isinstance(p.schema["item"].dataType, T.NullType)]
                if not parts:
                    return df.limit(0)
                if len({p.schema["item"].dataType.simpleString() for p in parts}) > 1:
                    raise SourceError("the values that * stands for have different shapes")
                out = parts[0]
                for p in parts[1:]:
                    out = out.unionAll(p)
                return out
            # a root array's elements are rows already
        elif isinstance(kind, T.StructType) and s in kind.names:
            df = df.select(F.col("item")[s].alias("item"))
        else:
            return df.limit(0)
    return df.where("item is not null")


def _flatten(df: DataFrame, references: list[str]) -> DataFrame:
    """References as columns, from column ``item``; dots go down, arrays on the way are exploded once for all references below them."""
    found: dict[str, str] = {}
    temp = iter(range(10**6))

    def down(df: DataFrame, at: str, wanted: dict[str, str]) -> DataFrame:
        """at: the column; wanted: rest of path by reference."""
        kind = df.schema[at].dataType
        if isinstance(kind, T.ArrayType):
            name = f"__x{next(temp)}"
            return down(df.withColumn(name, F.explode(at)), name, wanted)
        heads: dict[str, dict[str, str]] = {}
        for ref, rest in wanted.items():
            if rest == "":
                found[ref] = at
                continue
            if not isinstance(kind, T.StructType):
                continue
            names = sorted((n for n in kind.names if rest == n or rest.startswith(n + ".")), key=len)
            if names:
                heads.setdefault(names[-1], {})[ref] = rest[len(names[-1]) + 1 :]
        for n, own in heads.items():
            name = f"__x{next(temp)}"
            df = down(df.withColumn(name, F.col(at)[n]), name, own)
        return df

    def rest_of(r: str) -> str:
        r = re.sub(r"^\$\.?|^\.", "", r)
        return re.sub(r"\[(?:\*|'([^']*)')\]", lambda m: "." + m[1] if m[1] else "", r).lstrip(".")

    df = down(df, "item", {r: rest_of(r) for r in references})
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*(lexical(F.col(found[r]), kinds[found[r]]).alias(r) if r in found else F.lit(None).cast("string").alias(r) for r in references))


def json_rows(df: DataFrame, iterator: str | None, references: list[str], array_root: bool = False) -> DataFrame:
    """df: one column ``item``, a row per document or, for a root that is an array, per element."""
    steps = json_path(iterator)
    if array_root and steps[:1] == ["*"] and not isinstance(df.schema["item"].dataType, T.ArrayType):
        steps = steps[1:]
    return _flatten(iterate(df, steps), references)


def json_file(ctx: Context, path: str, iterator: str | None, references: list[str]) -> DataFrame:
    """Numbers keep their text. Lines of their own documents (.jsonl, .ndjson) are split among tasks; other files are documents."""
    key = f"json|{path}"
    if key not in ctx.tables:
        lines = path.lower().endswith((".jsonl", ".ndjson"))
        reader = ctx.spark.read.option("primitivesAsString", "true").option("multiLine", str(not lines).lower())
        if path.startswith(("http://", "https://")):
            from .http import fetch

            ctx.tables[key] = json_text(ctx, fetch(path))
        else:
            df = reader.json(path)
            ctx.tables[key] = df.select(F.struct(*(col(n) for n in df.columns)).alias("item")) if df.columns else ctx.spark.createDataFrame([], "item struct<_none: string>")
    # Of a file with several rows, or with a path that begins with [*], the root is an array whose elements are the rows.
    return json_rows(ctx.tables[key], iterator, references, array_root=True)


def json_text(ctx: Context, text: str) -> DataFrame:
    ddl = ctx.spark.range(1).select(F.schema_of_json(F.lit(text), {"primitivesAsString": "true"})).first()[0]
    return ctx.spark.createDataFrame([(text,)], "t string").select(F.from_json("t", ddl).alias("item"))


def xml_items(root: ET.Element, iterator: str, spaces: dict[str, str]) -> list[ET.Element]:
    path = re.sub(r"/+$", "", (iterator or "/*").strip())
    if path in ("", "/", "/*", "."):
        return [root]
    absolute = path.startswith("/") and not path.startswith("//")
    if path.startswith("//"):
        return [e for e in [root, *root.findall("." + path, spaces)] if e is not root or _matches(root, path[2:], spaces)]
    steps = path.strip("/")
    if absolute:
        first, _, rest = steps.partition("/")
        if first != "*" and not _matches(root, first, spaces):
            return []
        return root.findall(rest, spaces) if rest else [root]
    return root.findall(steps, spaces) or root.findall(".//" + steps, spaces)


def _matches(e: ET.Element, name: str, spaces: dict[str, str]) -> bool:
    prefix, colon, local = name.partition(":")
    return e.tag == (f"{{{spaces.get(prefix, '')}}}{local}" if colon else name) or not colon and e.tag.rpartition("}")[2] == name


def xml_values(e: ET.Element, ref: str, spaces: dict[str, str]) -> list[str | None]:
    """Values of a reference: a path, ``.``, or an attribute (``@a``, ``path@a``, ``path/@a``)."""
    path, at, attribute = ref.partition("@")
    path = path.rstrip("/")
    if path.startswith("./"):
        path = path[2:]
    nodes = [e] if path in ("", ".") else e.findall(path, spaces)
    return [n.get(attribute) if at else n.text for n in nodes]


NAME = r"(?:[\w.-]+:)?[\w.-]+"
PIECES = "file long, first int, part long, n long, text binary"
SPACES = re.compile(r"xmlns(?::([\w.-]+))?\s*=\s*[\"']([^\"']*)[\"']")


def xml_steps(iterator: str | None) -> tuple[str, list[str]] | None:
    """How an iterator can be followed while a document is read: from its root (/), anywhere (//), or from the root's children and else anywhere (""); and its steps. None where it takes the whole document."""
    path = re.sub(r"/+$", "", (iterator or "/*").strip())
    found = re.fullmatch(rf"(//|/|)((?:\*|{NAME})(?:/(?:\*|{NAME}))*)", path)
    if not found or path == "/*" or path == ".":
        return None
    return found[1], found[2].split("/")


def _tag(step: str, spaces: dict[str, str]) -> str | None:
    """The tag that a step of find() stands for; None for any."""
    prefix, colon, local = step.rpartition(":")
    if step == "*":
        return None
    if colon:
        if prefix not in spaces:
            raise SyntaxError(f"prefix {prefix!r} not found in prefix map")
        return f"{{{spaces[prefix]}}}{local}"
    return f"{{{spaces['']}}}{step}" if spaces.get("") else step


def xml_stream(pieces: Iterable[str | bytes], how: str, steps: list[str], spaces: dict[str, str]) -> Iterator[ET.Element]:
    """Elements of a document that steps lead to, each as soon as it ends; what no such element holds is let go."""
    parser = ET.XMLPullParser(("start", "end"))
    above: list[ET.Element] = []
    inside = 0
    n = len(steps)
    tags = None if how == "/" and n == 1 else [_tag(x, spaces) for x in (steps[1:] if how == "/" else steps)]

    def chosen(e: ET.Element) -> bool:
        depth = len(above) + 1
        if how == "/":
            if depth != n or n > 1 and tags[-1] not in (None, e.tag):
                return False
            first = above[0] if above else e
            return (steps[0] == "*" or _matches(first, steps[0], spaces)) and all(t in (None, x.tag) for t, x in zip(tags or (), above[1:]))
        if how == "//" and n == 1 and depth == 1:
            return _matches(e, steps[0], spaces)
        if depth != n + 1 if how == "" else depth < n + 1:
            return False
        return tags[-1] in (None, e.tag) and all(t in (None, x.tag) for t, x in zip(tags[:-1], above[depth - n :]))

    def events():
        for p in pieces:
            parser.feed(p)
            yield from parser.read_events()
        parser.close()
        yield from parser.read_events()

    for kind, e in events():
        if kind == "start":
            inside += chosen(e)
            above.append(e)
            continue
        above.pop()
        if own := chosen(e) if inside else False:
            yield e
            inside -= own
        if above and not inside:
            above[-1].remove(e)


def xml_document(pieces: Iterable[str | bytes], iterator: str | None, spaces: dict[str, str]) -> Iterator[ET.Element]:
    found = xml_steps(iterator)
    if found is None:
        parser = ET.XMLParser()
        for p in pieces:
            parser.feed(p)
        yield from xml_items(parser.close(), iterator, spaces)
    elif found[0]:
        yield from xml_stream(pieces, *found, spaces)
    else:  # from the root's children; where nothing is there, from anywhere, on a second reading
        with tempfile.TemporaryFile() as kept:

            def keep():
                for p in pieces:
                    kept.write(p if isinstance(p, bytes) else p.encode())
                    yield p

            some = False
            for e in xml_stream(keep(), "", found[1], spaces):
                some = True
                yield e
            if not some:
                kept.seek(0)
                yield from xml_stream(iter(lambda: kept.read(1 << 20), b""), "//", found[1], spaces)


def xml_pieces(ctx: Context, path: str) -> DataFrame:
    """Pieces of documents (file, first, part, n, compressed text), in order by these: what the name spaces are (first), then the text. Files are split among tasks after any >."""
    own = ctx.spark.read.option("lineSep", ">").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value")

    def run(batches):
        n = 0
        for b in batches:
            files, parts, values = (b.column(k).to_pylist() for k in range(3))
            out, at = [], 0
            for k in range(1, len(values) + 1):
                if k == len(values) or files[k] != files[at] or parts[k] != parts[at]:
                    text = ">".join(values[at:k]) + ">"
                    if "xmlns" in text:
                        first: dict[str | None, str] = {}
                        for m in SPACES.finditer(text):  # of a prefix the last, of none the first
                            first = first | {m[1]: m[0]} if m[1] else {None: m[0]} | first
                        out.append((files[at], 0, parts[at], n, zlib.compress(" ".join(first.values()).encode(), 1)))
                    out.append((files[at], 1, parts[at], n, zlib.compress(text.encode(), 1)))
                    n, at = n + 1, k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["file", "first", "part", "n", "text"])

    return own.mapInArrow(run, PIECES)


def xml_file(ctx: Context, path: str, iterator: str | None, references: list[str]) -> DataFrame:
    """A document is cut by many tasks and parsed by one, which holds one element of the iterator at a time (the whole document for /, /* and paths with predicates or dots); documents are spread over tasks."""
    if path.startswith(("http://", "https://")):
        from .http import fetch

        text = fetch(path)
        docs = ctx.spark.createDataFrame([(0, k, 0, 0, zlib.compress(t.encode())) for k, t in enumerate((" ".join(m[0] for m in SPACES.finditer(text)), text + ">"))], PIECES)
    else:
        docs = xml_pieces(ctx, path).repartition("file").sortWithinPartitions("file", "first", "part", "n")

    def records(batches):
        for b in batches:
            yield from ((f, k, zlib.decompress(t.as_py()).decode()) for f, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4)))

    def pieces(texts):
        """The text without the > that follows its last character."""
        last, declared = None, False
        for k, text in enumerate(texts):
            if k == 0:
                declared = text.lstrip().startswith("<?xml")
            if last is not None:
                yield last.encode() if declared else last
            last = text
        end = last[:-1]
        end = end if not end.strip() or end.rstrip().endswith(">") else last
        yield end.encode() if declared else end

    def rows(batches):
        for _, own in groupby(records(batches), key=lambda r: r[0]):
            spaces: dict[str, str] = {}
            default = None
            for _, first, text in own:
                if first:
                    break
                for prefix, uri in SPACES.findall(text):
                    if prefix:
                        spaces[prefix] = uri
                    elif default is None:
                        default = uri
            if default is not None:
                spaces[""] = default
            for e in xml_document(pieces(chain([text], (r[2] for r in own))), iterator, spaces):
                yield from product(*(xml_values(e, r, spaces) for r in references))

    def run(batches):
        made = rows(batches)
        while some := list(islice(made, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], [f"c{k}" for k in range(len(references))])

    out = docs.mapInArrow(run, ", ".join(f"c{k} string" for k in range(len(references))))
    if references:  # what follows shall not be one task's work
        out = out.repartition(*out.columns)
    return out.toDF(*references)
