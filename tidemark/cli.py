"""``python -m tidemark.cli``: one indexing run with settings from flags and the environment."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from .config import Config, load
from .embedders import HashEmbedder
from .plans.pipeline import run
from .session import session, sweep


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    for f in fields(Config):
        kind = type(f.default)
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=(lambda s: s.lower() == "true") if kind is bool else kind, default=None)
    parser.add_argument("--offline", action="store_true", help="use the deterministic embedder")
    given = vars(parser.parse_args(argv))
    offline = given.pop("offline")
    config = load(**{k: v for k, v in given.items() if v is not None})
    spark = session(config.app_name, config.master)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", config.checkpoint_dir)
    try:
        print(run(spark, config, HashEmbedder() if offline else None))
    finally:
        sweep(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
