"""Command line: check, explain and run a flow, or compile a program of steps or source."""

from __future__ import annotations

import argparse
import json

from sparkloom.errors import FlowError


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("command", choices=["validate", "summary", "mermaid", "explain", "run"])
    p.add_argument("file", help="a flow (.json, .yaml), steps (.steps.json) or source (.py)")
    p.add_argument("--input", action="append", default=[], metavar="NAME=PATH", help="a Parquet or CSV table")
    p.add_argument("--output", action="append", default=[], metavar="NAME=PATH", help="a dataset to write as Parquet")
    p.add_argument("--config", help="a JSON file of Spark settings")
    return p.parse_args(argv)


def load(path: str):
    """The flow of a file; None for source, which is compiled with its inputs."""
    from sparkloom.plans.flow import Flow
    from sparkloom.plans.steps import compile_steps

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".py"):
        return None, text
    if path.endswith((".yaml", ".yml")):
        return Flow.from_yaml(text), text
    doc = json.loads(text)
    return (compile_steps(doc) if "steps" in doc else Flow(doc)), text


def session(config: str | None):
    from pyspark.sql import SparkSession

    from sparkloom.session import tune

    builder = SparkSession.builder.appName("sparkloom")
    if config:
        with open(config, encoding="utf-8") as f:
            for k, v in json.load(f).items():
                builder = builder.config(k, v)
    return tune(builder.getOrCreate())


def main(argv: list[str] | None = None) -> int:
    args = parse(argv)
    flow, text = load(args.file)
    if args.command in ("validate", "summary", "mermaid"):
        if flow is None:
            raise FlowError(f"{args.command} takes a flow or steps")
        findings = flow.validate()
        print({"validate": lambda: json.dumps(findings, indent=2), "summary": flow.summary, "mermaid": flow.mermaid}[args.command]())
        return int(args.command == "validate" and any(f["level"] == "error" for f in findings))
    spark = session(args.config)
    inputs = {}
    for pair in args.input:
        name, _, path = pair.partition("=")
        inputs[name] = spark.read.parquet(path) if not path.endswith(".csv") else spark.read.csv(path, header=True, inferSchema=True)
    if flow is None:
        from sparkloom.plans.pandas_source import compile_source

        made = compile_source(text, inputs)
    else:
        made = flow.run(spark, inputs)
    wanted = dict(p.split("=", 1) for p in args.output)
    if args.command == "explain":
        for name in wanted or ([n for n in made if n not in inputs]):
            print(f"== {name}")
            made[name].explain("formatted")
        return 0
    for name, path in wanted.items():
        made[name].write.mode("overwrite").parquet(path)
    if flow is not None:
        flow.store(made)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
