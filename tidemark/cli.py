"""A command line on a store: ``python -m tidemark.cli PATH``; put, get, del, status, help, exit."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

HELP = "put KEY VALUE | get KEY | del KEY | status | help | exit"


def run_line(store, line: str) -> str | None:
    """The answer to one line; None ends the session."""
    parts = line.strip().split(" ", 2)
    command = {"delete": "del", "quit": "exit"}.get(parts[0].lower(), parts[0].lower())
    if command == "exit":
        return None
    if command == "put" and len(parts) == 3:
        return f"ok {store.put(parts[1], parts[2])}"
    if command == "get" and len(parts) > 1:
        value, _ = store.get(parts[1])
        return "(nil)" if value is None else value.decode("utf-8", "replace")
    if command == "del" and len(parts) > 1:
        return f"deleted {store.delete(parts[1])}"
    if command == "status":
        return json.dumps(store.status())
    if command == "help" or not command:
        return HELP
    return f"usage: {HELP}"


def main(read: Callable[[], str] = lambda: input("kv> "), argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from tidemark.operators.store import Store

    store = Store(SparkSession.builder.getOrCreate(), (argv or sys.argv[1:])[0])
    while True:
        try:
            out = run_line(store, read())
        except EOFError:
            break
        except ValueError as e:
            out = str(e)
        if out is None:
            break
        print(out)
    store.close()


if __name__ == "__main__":
    main()
