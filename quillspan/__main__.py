"""``python -m quillspan STAGE --option value ...``: run an entry point of ``quillspan.api``; dashes stand for underscores."""

from __future__ import annotations

import argparse
import inspect
import json

from pyspark.sql import DataFrame, SparkSession

from . import api

STAGES = {n: f for n, f in vars(api).items() if inspect.isfunction(f) and f.__module__ == api.__name__ and not n.startswith("_")}


def parser() -> argparse.ArgumentParser:
    """A sub-command a stage, an option a parameter; a flag for a yes-or-no parameter, JSON for a mapping or a list."""
    top = argparse.ArgumentParser(prog="quillspan")
    sub = top.add_subparsers(dest="stage", required=True)
    for name, f in STAGES.items():
        p = sub.add_parser(name.replace("_", "-"), help=(f.__doc__ or "").split("\n")[0])
        for k, v in list(inspect.signature(f).parameters.items())[1:]:
            kind, required = str(v.annotation), v.default is inspect.Parameter.empty
            option = {"dest": k, "required": required, "default": None if required else v.default}
            if kind == "bool":
                p.add_argument(f"--{k.replace('_', '-')}", dest=k, action=argparse.BooleanOptionalAction, default=v.default)
            else:
                p.add_argument(f"--{k.replace('_', '-')}", type=json.loads if kind.startswith(("dict", "list")) else int if kind.startswith("int") else float if kind.startswith("float") else str, **option)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = vars(parser().parse_args(argv))
    stage = STAGES[args.pop("stage").replace("-", "_")]
    out = stage(spark or SparkSession.builder.getOrCreate(), **args)
    if isinstance(out, DataFrame):
        out.show(truncate=False)
    else:
        print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
