"""Command line: ``python -m tidelog validate|run|state``."""

from __future__ import annotations

import argparse
import contextlib
import sys

from . import config as cf


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("validate", "check a configuration"), ("run", "deliver a landed source until stopped")):
        c = commands.add_parser(name, help=what)
        c.add_argument("--config", required=True)
        if name == "run":
            c.add_argument("--available-now", action="store_true", help="deliver what is there, then end")
            c.add_argument("--ignore-unused", action="store_true", help="go on although some configured options do nothing here")
    state = commands.add_parser("state", help="stored state")
    state.add_argument("action", choices=["show", "reset"])
    state.add_argument("--config", required=True)
    state.add_argument("--confirm", action="store_true")
    args = parser.parse_args(argv)
    try:
        config = cf.load_file(args.config)
    except (cf.ConfigError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if args.command == "validate":
        for name in config.unhonoured():
            print(f"warning: a run does nothing with {name}", file=sys.stderr)
        print(f"{config.name}: valid")
        return 0

    from .streaming.runtime import CheckpointStore

    store = CheckpointStore(config.runtime.state_dir)
    if args.command == "state":
        if args.action == "show":
            print(store.load(config.name))
            return 0
        if not args.confirm:
            print("error: a reset needs --confirm", file=sys.stderr)
            return 2
        store.delete(config.name)
        return 0
    if (unused := config.unhonoured()) and not args.ignore_unused:
        print(f"error: a run does nothing with {', '.join(unused)}; remove them or give --ignore-unused", file=sys.stderr)
        return 2
    return run(config, store, args.available_now)


def run(config: cf.Config, store, available_now: bool) -> int:
    from .encode.json import heartbeat_route
    from pyspark.sql import SparkSession

    from pyspark.errors import StreamingQueryException

    from .plans.delivery import source_records
    from .streaming import runtime, server
    from .streaming.signal_queue import SignalQueue

    sink = {"stdout": lambda: runtime.StdoutSink(), "files": lambda: runtime.FileSink(config.sink.path), "kafka": lambda: runtime.KafkaSink(config.sink.servers, **config.sink.options)}[config.sink.kind]()
    spark = SparkSession.builder.appName(config.name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    r = config.runtime
    connector = runtime.Connector(config.name, sink, store, config.identity(), retries=r.max_retries, retry_initial_ms=r.retry_initial_ms, retry_max_ms=r.retry_max_ms, heartbeat_ms=r.heartbeat_interval_ms)
    if r.heartbeat_interval_ms:
        connector.heartbeat_topic = heartbeat_route(config.sink.prefix or config.name, config.sink.heartbeat_prefix, config.sink.heartbeat_topic)
    signals = SignalQueue()
    if config.snapshot.path and config.source.family == "postgresql":
        from .streaming.incremental import IncrementalSnapshots

        connector.incremental = IncrementalSnapshots(spark, config, signals)
    beside = []
    if r.management_port:
        beside.append(server.management(connector, lambda: connector.query and connector.stop(connector.query), signals if connector.incremental else None, r.management_changes, port=r.management_port))
    if r.listen_port:
        beside.append(server.listener(config.source.path, r.listen_token, port=r.listen_port))
    # a landing folder that cannot be reached for a while is no reason to end
    transient = lambda e: any(word in str(e) for word in ("Connection refused", "timed out", "java.net.", "java.io.IOException"))
    with contextlib.ExitStack() as stack:
        for s in beside:
            stack.enter_context(s)
        try:
            connector.run(lambda: source_records(spark, config), r.checkpoint_dir or f"{r.state_dir}/stream", available_now, transient)
            while available_now and connector.step():
                pass
        except KeyboardInterrupt:
            connector.stop(connector.query)
        except ValueError as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
        except StreamingQueryException as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    return 0
