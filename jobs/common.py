"""What the jobs share: their log and their command line."""

from __future__ import annotations

import argparse
import json
import logging
import pathlib

LOG = logging.getLogger("jobs")


def main(run, config_file: str, paths: tuple[str, ...]) -> None:
    """Read the config, let options replace its paths, and call ``run`` with a session of its own."""
    from cohortloom.session import session

    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("--config", default=str(pathlib.Path(__file__).with_name(config_file)))
    for name in paths:
        parser.add_argument(f"--{name}", default=None, help="a path, in place of the config's")
    given = vars(parser.parse_args())
    with open(given.pop("config")) as f:
        config = json.load(f)
    config |= {k: v for k, v in given.items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(run.__module__.rsplit(".", 1)[-1])
    try:
        run(spark, **config)
    finally:
        spark.stop()
