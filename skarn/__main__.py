"""An interactive session: ``python -m skarn [folder]``. Statements end with a semicolon; commands begin with /."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from skarn.session import Engine

HELP = "/dt  tables\n/d table  columns of a table\n/clear  clears the screen\n/help  this text\n/quit  leaves"


def command(db: Engine, line: str) -> str | None:
    """Answers a command; None leaves."""
    name, _, rest = line.strip().partition(" ")
    if name == "/quit":
        return None
    if name == "/dt":
        return "\n".join(db.tables())
    if name == "/d":
        return "\n".join(f"{r.column_name} {r.type}" for r in db.describe(rest.strip()).collect())
    if name == "/clear":
        return "\033[2J\033[H"
    return HELP if name == "/help" else f"no command {name}; /help lists them"


def main() -> None:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    with Engine(spark, sys.argv[1] if len(sys.argv) > 1 else None) as db:
        held = ""
        while True:
            try:
                line = input("...> " if held else "skarn> ")
            except EOFError:
                return
            try:
                if not held and line.startswith("/"):
                    if (answer := command(db, line)) is None:
                        return
                    print(answer)
                    continue
                held += line + "\n"
                if held.rstrip().endswith(";"):
                    text, held = held, ""
                    db.sql(text).show(truncate=False)
            except Exception as e:  # noqa: BLE001  a failed statement does not end the session
                held = ""
                print(f"{type(e).__name__}: {e}")


if __name__ == "__main__":
    main()
