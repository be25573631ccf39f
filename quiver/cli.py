"""A prompt: ``python -m quiver.cli [--root FOLDER] [--graph NAME] [--format table|json|csv] [QUERY]``."""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from quiver.errors import QueryError
from quiver.session import Session
from quiver.sources.text import export_graph, import_graph

#: Rows that are shown of a result.
SHOWN = 1000


def render(rows: DataFrame, form: str) -> str:
    found = rows.limit(SHOWN).collect()
    values = [[v for v in r] for r in found]
    if form == "json":
        return json.dumps([dict(zip(rows.columns, r, strict=True)) for r in values], default=str, ensure_ascii=False)
    if form == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([rows.columns, *values])
        return out.getvalue().rstrip("\r\n")
    cells = [rows.columns, *[["NULL" if v is None else str(v) for v in r] for r in values]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    body = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "|" for r in cells]
    return "\n".join([line, body[0], line, *body[1:], line, f"{len(values)} row(s)"])


def command(session: Session, text: str, graph: str, form: str) -> str:
    """One line: a query, or a command with a colon."""
    name, _, rest = text.partition(" ")
    if not name.startswith(":"):
        return render(session.query(text, graph), form)
    if name == ":graphs":
        return render(session.query("LIST GRAPHS"), form)
    if name == ":status":
        return f"{len(session.entries)} graph(s), Spark {session.spark.version}"
    if name == ":export":
        return f"{export_graph(session.graph(graph), rest)} statement(s)"
    if name == ":import":
        return f"{import_graph(session, rest, graph)} statement(s)"
    if session.store is None:
        return "no store: start with --root"
    if name == ":backup":
        return session.store.backup(graph, rest or "backup")
    if name == ":backups":
        return "\n".join(session.store.backups())
    if name == ":delete-backup":
        return str(session.store.delete_backup(rest))
    return f"no command {name}"


def main(args: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(prog="quiver")
    options.add_argument("--root")
    options.add_argument("--graph", default="default")
    options.add_argument("--format", default="table", choices=["table", "json", "csv"])
    options.add_argument("query", nargs="?")
    given = options.parse_args(args)
    session = Session(SparkSession.builder.getOrCreate(), given.root)
    for text in [given.query] if given.query else sys.stdin:
        if text.strip():
            try:
                print(command(session, text.strip(), given.graph, given.format))
            except QueryError as problem:
                print(f"error: {problem}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
