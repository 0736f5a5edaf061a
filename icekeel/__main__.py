"""python -m icekeel CONFIG ROOT: maintains the tables of a catalog until it is told to end."""

from __future__ import annotations

import signal
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from icekeel.functions.paths import memory_bytes
from icekeel.plans.config import parse
from icekeel.plans.maintenance import Maintainer
from icekeel.plans.scheduler import Scheduler
from icekeel.sources.catalog import opened
from icekeel.sources.store import Store, configure


def main(path: str, root: str = "") -> None:
    config = parse(Path(path).read_text())
    spark = SparkSession.builder.appName("icekeel").config("spark.scheduler.mode", "FAIR").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    configure(spark, config.storage)
    store = Store(spark)
    maintainer = Maintainer(spark, opened(config.catalog, store, root), store, config.scheduler.retry, memory_limit=memory_bytes(config.scheduler.memory_limit))
    scheduler = Scheduler(config, maintainer)
    for s in (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, scheduler.stop)
    if config.scheduler.metrics_addr:
        scheduler.serve(config.scheduler.metrics_addr)
    scheduler.run()


if __name__ == "__main__":
    main(*sys.argv[1:])
