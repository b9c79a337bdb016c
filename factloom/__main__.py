"""``python -m factloom serve|stdio [data folder] [host:port]``: the HTTP server, or JSON-RPC on standard streams."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from factloom.config import EngineConfig
from factloom.engine import Engine
from factloom.http import make_server
from factloom.service import Service


def main(args: list[str]) -> None:
    mode, folder, at = [*args, "", "", ""][:3]
    if mode not in ("serve", "stdio"):
        sys.exit(__doc__)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    service = Service(Engine.open(spark, EngineConfig(data_dir=folder or EngineConfig().data_dir)))
    if mode == "stdio":
        service.serve(sys.stdin, sys.stdout)
    else:
        host, _, port = (at or "127.0.0.1:8080").rpartition(":")
        make_server(service, host, int(port)).serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
