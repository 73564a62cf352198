"""Command line: statistics of a chat export, its messages as a table, those of some years, and a crawl's counts."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from opinara.operators import metrics as M
from opinara.plans import ingest
from opinara.sources import readers, sinks


def main(given: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="opinara", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("scan", ()), ("parse", ("out",)), ("years", ("out", "years")), ("crawl", ())):
        command = commands.add_parser(name)
        command.add_argument("path")
        command.add_argument("--lines", action="store_true", help="a document in each line")
        for argument in more:
            command.add_argument(argument, **({"nargs": "+", "type": int} if argument == "years" else {}))
    asked = parser.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "crawl":
        ingest.ingest_crawl(readers.crawl(spark, asked.path, asked.lines))[1].orderBy("entity", "reason").show(100, False)
        return 0
    messages = readers.chat_messages(spark, asked.path, lines=asked.lines)
    if asked.command == "scan":
        said = F.length("text") > 0
        M.export_statistics(messages, {"with_text": said, "with_media": F.col("media").isNotNull(), "replies": F.col("reply_to").isNotNull()}).show(truncate=False)
    elif asked.command == "parse":
        messages.write.mode("overwrite").json(asked.out)
    else:
        sinks.by_year(messages, asked.out, asked.years)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
