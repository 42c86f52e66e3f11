"""Command line: version, environment, inspect, status, verify, plan, reproduce."""

from __future__ import annotations

import argparse
import json
import sys

from gridloom import __version__


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("environment")
    c = commands.add_parser("inspect")
    c.add_argument("source")
    c.add_argument("--version", dest="source_version")
    for name in ("status", "verify"):
        commands.add_parser(name).add_argument("result")
    commands.add_parser("plan").add_argument("workflow")
    c = commands.add_parser("reproduce")
    c.add_argument("workflow")
    c.add_argument("--output")
    a = parser.parse_args(argv)
    say = lambda x: print(json.dumps(x, indent=2, default=str))
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "environment":
        from gridloom.run import environment

        say(environment(_spark()))
        return 0
    if a.command == "inspect":
        from gridloom.sources import open_source

        with open_source(a.source, version=a.source_version) as s:
            r = s.inspect()
            say({
                "identity": {"uri": r.identity.uri, "version": r.identity.version}, "capabilities": list(r.capabilities),
                "assets": [{"asset_id": x.asset_id, "path": x.path, "size": x.size} for x in r.assets],
                "objects": [{"path": m.path, "name": m.name, "neurodata_type": m.neurodata_type, "shape": m.shape, "dtype": m.dtype.str, "native_chunks": m.chunks, "axes": m.axes} for m in r.objects],
            })
        return 0
    from gridloom.run import open_result
    from gridloom.spec import WorkflowSpec

    try:
        if a.command == "status":
            r = open_result(a.result)
            say({"workflow_id": r.workflow_id, "status": r.status, "partitions": len(r.keys()), "complete": len(r.manifests())})
        elif a.command == "verify":
            report = open_result(a.result, _spark()).verify()
            say(report)
            return 0 if report["valid"] else 1
        elif a.command == "plan":
            say(WorkflowSpec.from_json(a.workflow).plan(_spark()).to_dict())
        else:
            say({"status": WorkflowSpec.from_json(a.workflow).reproduce(a.output, _spark()).status})
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
