"""Command line: inspect, quantize and validate."""

from __future__ import annotations

import argparse
import sys

from .plans import model
from .schema import TensorError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tensorloom")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("inspect", help="list the tensors of a SafeTensors file").add_argument("path")
    q = sub.add_parser("quantize", help="write a quantized SafeTensors file")
    q.add_argument("input")
    q.add_argument("output")
    q.add_argument("--format", default="int8")
    q.add_argument("--device", default="cpu")
    q.add_argument("--namespace", default="tensorloom", help="prefix of the metadata keys")
    v = sub.add_parser("validate", help="check a quantized SafeTensors file against its source")
    v.add_argument("input")
    v.add_argument("output")
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        if a.command == "inspect":
            print(model.inspect(a.path))
            return 0
        if a.command == "quantize":
            model.policy.check_options(a.format, a.device)
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tensorloom").getOrCreate()
        if a.command == "validate":
            print("\n".join(model.validated(spark, a.input, a.output)))
            return 0
        print("\n".join(model.quantize(spark, a.input, a.output, a.format, a.device, namespace=a.namespace)))
        return 0
    except TensorError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
