"""Command line.

    python -m tripleloom CONFIG.ini               write the statements of a configuration where it says
    python -m tripleloom --translate MAPPING      print a mapping in the current vocabulary
    python -m tripleloom --direct FILE.db BASE    print the direct mapping of a SQLite file
"""

from __future__ import annotations

import logging
import sys
import time

from pyspark.sql import SparkSession

from .config import load_config
from .engine import Engine, translate_to_rml
from .mapping.direct import direct_mapping, sqlite_schema
from .sinks import write


def main(args: list[str]) -> int:
    if args[:1] == ["--translate"] and len(args) == 2:
        print(translate_to_rml(args[1]), end="")
        return 0
    if args[:1] == ["--direct"] and len(args) == 3:
        print(direct_mapping(sqlite_schema(args[1]), args[2]), end="")
        return 0
    if len(args) != 1 or args[0].startswith("-"):
        print(__doc__, file=sys.stderr)
        return 2
    config = load_config(args[0])
    logging.basicConfig(level=config.logging_level.upper(), filename=config.logging_file or None, format="%(asctime)s %(levelname)s %(message)s", force=True)
    log = logging.getLogger("tripleloom")
    began = time.time()
    engine = Engine(SparkSession.builder.getOrCreate(), config)
    log.info("%d rules in %d mapping groups, %.1f s", len(engine.rules), len(engine.groups), time.time() - began)
    write(engine)
    log.info("written, %.1f s", time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
