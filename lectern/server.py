"""Requests line by line: one JSON-RPC object in, one out.  Blank lines, lines that aren't JSON and requests without an id get no answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import IO, Any

#: The protocol's version, its error codes, characters per slice.
PROTOCOL, NO_METHOD, BAD_ARGUMENTS, SLICE = "2024-11-05", -32601, -32602, 40_000
#: Rows of a list in one answer, unless the request says how many.
SHOWN = 1000

Tool = Callable[[dict[str, Any]], str]


def strings(arguments: dict[str, Any], name: str) -> list[str]:
    """A list argument; entries of another type are dropped."""
    value = arguments.get(name)
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def number(arguments: dict[str, Any], name: str, default: int) -> int:
    value = arguments.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default


def read_text(text: str, arguments: dict[str, Any]) -> str:
    """A slice of a text, and where the next begins."""
    return _slice(len(text), lambda a, b: text[a:b], arguments)


def _slice(size: int, part: Callable[[int, int], str], arguments: dict[str, Any]) -> str:
    offset, limit = number(arguments, "offset", 0), number(arguments, "limit", SLICE)
    end = min(size, offset + limit)
    more = f", continue at {end}" if end < size else ""
    return f"{part(offset, end)}\n\n[{end}/{size}{more}]"


def answer(request: Any, tools: dict[str, tuple[str, Tool]]) -> dict | None:
    if not isinstance(request, dict) or "id" not in request:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params")
    params = params if isinstance(params, dict) else {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lectern", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object"}} for n, (d, _) in tools.items()]}}
    if method != "tools/call":
        return reply | {"error": {"code": NO_METHOD, "message": f"no method {method}"}}
    if params.get("name") not in tools:
        return reply | {"error": {"code": BAD_ARGUMENTS, "message": f"no tool {params.get('name')}"}}
    arguments = params.get("arguments")
    try:
        text, failed = tools[params["name"]][1](arguments if isinstance(arguments, dict) else {}), False
    except Exception as e:  # noqa: BLE001 - a tool that fails is an answer, not the end of the server
        text, failed = str(e), True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(lines: Iterable[str], out: IO[str], tools: dict[str, tuple[str, Tool]]) -> None:
    for line in lines:
        try:
            reply = answer(json.loads(line), tools)
        except ValueError:
            continue
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()


def tools_of(spark) -> dict[str, tuple[str, Tool]]:
    """The engine's own tools over a session."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from lectern import api
    from lectern.sources.locks import Options
    from lectern.sources.tables import stored

    # the texts read last, as rows (start, text) in the order of the paths, and the characters of all with a blank line between
    last: dict[str, Any] = {"size": 0}

    def part(a: int, b: int) -> str:
        if a >= b:
            return ""
        rows = last["texts"].where((F.col("start") < b) & (F.col("start") + F.length("text") > a))
        cut = F.col("text").substr(F.greatest(F.lit(0), F.lit(a) - F.col("start")).cast("int") + 1, (F.lit(b) - F.greatest(F.lit(a), F.col("start"))).cast("int"))
        return "".join(r[0] for r in rows.orderBy("start").select(cut).collect())

    def shown(name: str, rows, arguments: dict[str, Any]) -> dict[str, Any]:
        """A page of the rows, how many there are of them all, and where the next page begins."""
        offset, limit = number(arguments, "offset", 0), number(arguments, "limit", SHOWN)
        total = rows.count()
        page = [r.asDict(True) for r in rows.orderBy(F.to_json(F.struct(*rows.columns))).offset(offset).limit(limit).collect()]
        return {name: page, f"{name}_total": total} | ({f"{name}_continue_at": offset + len(page)} if offset + len(page) < total else {})

    def extract(arguments: dict[str, Any]) -> str:
        options = Options(
            arguments.get("crawl") is True, number(arguments, "max_pages", 50), number(arguments, "depth", 3), number(arguments, "delay_ms", 250), arguments.get("no_llms_txt") is True,
            arguments["branch"] if isinstance(arguments.get("branch"), str) else None, number(arguments, "max_files", 200), strings(arguments, "include"), strings(arguments, "exclude"),
        )
        read, notes = api.resolve(spark, strings(arguments, "sources"), options)
        rows = stored(read.select("path", "text", "estimated_tokens", "error").withColumn("id", F.monotonically_increasing_id()))
        there = F.length("text") > 0
        documents, characters, tokens = rows.agg(F.count_if(there), F.sum(F.when(there, F.length("text").cast("bigint"))), F.sum("estimated_tokens")).first()
        # only lengths go in the window over all; every text but the first has a blank line before it
        sizes = rows.where(there).select("id", "path", (F.length("text") + 2).cast("bigint").alias("n"))
        starts = sizes.select("id", (F.sum("n").over(W.orderBy("path", "id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
        texts = rows.join(starts, "id").select((F.col("start") - 2).alias("start"), F.concat(F.lit("\n\n"), "text").alias("text"))
        texts = texts.select(F.greatest(F.lit(0), F.col("start")).alias("start"), F.when(F.col("start") < 0, F.expr("substr(text, 3)")).otherwise(F.col("text")).alias("text"))
        last.update(texts=stored(texts), size=(characters or 0) + 2 * max(0, documents - 1))
        failed = shown("failures", rows.where("error <> ''").select("path", "error"), arguments)
        failed["failures"] = [f"{r['path']}: {r['error']}" for r in failed["failures"]]
        said = [f"{r['source']}: {r['note']}" for r in notes.collect()]
        return json.dumps({"documents": documents, "characters": characters or 0, "estimated_tokens": tokens or 0, "notes": said} | failed)

    def audit(arguments: dict[str, Any]) -> str:
        findings, tree, _ = api.audit(spark, str(arguments.get("path", ".")), number(arguments, "budget", 2000))
        return json.dumps(shown("findings", findings, arguments) | shown("tree", tree, arguments))

    return {
        "extract": ("read files and report on them", extract),
        "read_text": ("a slice of the text read last", lambda a: _slice(last["size"], part, a)),
        "audit": ("findings on the skills of a folder", audit),
        "sources": ("what source strings name", lambda a: json.dumps([r.asDict() for r in api.classify(spark, strings(a, "sources")).collect()])),
    }
