"""A whole run by options: load the shards, partition, log, write the parts.

``python -m pinweave.plans.run --config run.ini --hypergraph /data/g`` reads ``/data/g-0``, ``/data/g-1``, ...
and, if asked to, writes the vector of parts to ``/data/g.part.K``.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from pinweave.operators.metrics import balance_warning, graph_totals
from pinweave.plans.control import Result, partition
from pinweave.plans.options import Options, from_command_line
from pinweave.sources.binary import read_shards, write_vector
from pinweave.storage import sweep

log = logging.getLogger("pinweave.plans.run")  # the same name when this module is the program


@contextmanager
def log_sinks(options: Options) -> Iterator[None]:
    """Info and progress to the terminal or to the file that the options name; warnings always."""
    root = logging.getLogger("pinweave")
    sink = logging.FileHandler(options["output-file"]) if options["output-to-file"] else logging.StreamHandler(sys.stdout)
    sink.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    progress, info = options["display-progress"], options["display-info"]
    # progress is what the controllers report level by level, info what a run says of its graph and its result
    sink.addFilter(lambda r: r.levelno >= logging.WARNING or (info if r.name == log.name else progress))
    before = root.level
    root.setLevel(logging.INFO)
    root.addHandler(sink)
    try:
        yield
    finally:
        root.removeHandler(sink)
        root.setLevel(before)
        sink.close()


def part_file(options: Options) -> str:
    return f"{options['hypergraph']}.part.{options['number-of-parts']}"


def run(spark: SparkSession, options: Options, **parts_of_it) -> Result:
    """Partition the shards that ``hypergraph`` names. ``parts_of_it`` goes to ``partition``."""
    if not options["hypergraph"]:
        raise ValueError("the option hypergraph must name the shards")
    with log_sinks(options):
        g = read_shards(spark, options["hypergraph"])
        log.info("graph: %s", graph_totals(g).first().asDict())
        heaviest = balance_warning(g, options["number-of-parts"], options["balance-constraint"]).first()
        if heaviest.warning:
            log.warning("a vertex of weight %s is above the slack of %s: balance may be out of reach", heaviest.max_vertex, heaviest.slack)
        found = partition(g, options, **parts_of_it)
        log.info("cuts: %s, seconds: %s", found.summary, {k: round(x, 3) for k, x in found.seconds.items()})
        if options["write-partitions-to-file"]:
            written = write_vector(found.parts, part_file(options)).first()
            log.info("%s: %d bytes", written.file, written.bytes)
        return found


def main(arguments: list[str]) -> None:
    spark = SparkSession.builder.appName("pinweave").getOrCreate()
    run(spark, from_command_line(arguments))
    sweep(spark)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
