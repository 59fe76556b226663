"""The tools as a client calls them: declarations with argument schemas, and calls by name that answer in JSON."""

from __future__ import annotations

import inspect
import json

from docsect.plans.api import Tools

#: What a client is told of each tool.
ABOUT = {
    "index_repo": "Index the documentation of a GitHub repository.",
    "index_local": "Index the documentation files of a folder.",
    "list_repos": "List all indexed repositories.",
    "get_toc": "The sections of a repository in order, filtered by path prefix, depth or file pattern.",
    "get_toc_tree": "The sections of a repository as a tree.",
    "get_document_outline": "The sections of one file as a tree.",
    "get_section": "The text of one section.",
    "get_sections": "The texts of several sections.",
    "search_sections": "The best sections for a query over titles, summaries and keywords.",
    "delete_index": "Delete the index of a repository.",
}
#: Arguments that a client may not set: they come from the surroundings.
INNER = {"github_token", "incremental", "extra_ignore_patterns"}
KINDS = {"str": "string", "int": "integer", "bool": "boolean", "list[str]": "array"}


def declared() -> list[dict]:
    """Name, description and argument schema of each tool."""
    out = []
    for name, about in ABOUT.items():
        given = {k: p for k, p in inspect.signature(getattr(Tools, name)).parameters.items() if k != "self" and k not in INNER}
        properties = {}
        for k, p in given.items():
            kind = KINDS[str(p.annotation).removesuffix(" | None")]
            properties[k] = {"type": kind} | ({"items": {"type": "string"}} if kind == "array" else {}) | ({"default": p.default} if p.default not in (inspect.Parameter.empty, None) else {})
        schema = {"type": "object", "properties": properties}
        if required := [k for k, p in given.items() if p.default is inspect.Parameter.empty]:
            schema["required"] = required
        out.append({"name": name, "description": about, "inputSchema": schema})
    return out


def fits(value, schema: dict) -> bool:
    kind = schema["type"]
    if kind == "array":
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    return isinstance(value, {"string": str, "integer": int, "boolean": bool}[kind]) and not (kind == "integer" and isinstance(value, bool))


def call(tools: Tools, name: str, arguments: dict | None = None) -> str:
    """The answer of a tool as JSON; errors are answers too.  Arguments that are null or unknown are left out."""
    schema = next((x["inputSchema"] for x in declared() if x["name"] == name), None)
    if schema is None:
        return json.dumps({"error": f"Unknown tool: {name}"}, indent=2)
    given = {k: v for k, v in (arguments or {}).items() if k in schema["properties"] and v is not None}
    wrong = [f"{k} is missing" for k in schema.get("required", []) if k not in given] + [f"{k} is no {schema['properties'][k]['type']}" for k, v in given.items() if not fits(v, schema["properties"][k])]
    if wrong:
        return json.dumps({"error": "; ".join(wrong)}, indent=2)
    return json.dumps(getattr(tools, name)(**given), indent=2)
