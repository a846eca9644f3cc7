"""python -m positdb [config.json]: restores the store, runs the startup script and serves queries.

Settings: ``database`` (a folder; in memory without it), ``startup`` (a script file), ``host``, ``port``.
"""

import json
import sys

from pyspark.sql import SparkSession

from positdb.engine import Engine
from positdb.errors import ConfigError
from positdb.server import serve
from positdb.sources.store import PositStore


def main(args: list[str]) -> None:
    settings = {}
    if args:
        try:
            with open(args[0]) as f:
                settings = json.load(f)
        except (OSError, ValueError) as e:
            raise ConfigError(f"{args[0]} can't be read: {e}") from e
    spark = SparkSession.builder.appName("positdb").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = PositStore.open(spark, settings["database"]) if settings.get("database") else PositStore.in_memory(spark)
    engine = Engine(store)
    if settings.get("startup"):
        with open(settings["startup"]) as f:
            engine.execute(f.read())
    serve(engine, settings.get("host", "127.0.0.1"), int(settings.get("port", 8080))).serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
