"""Configuration: YAML with environment interpolation, or a ``.properties`` file of the usual connector keys.

Unknown fields are errors in YAML and warnings in properties files.
"""

from __future__ import annotations

import os
import re
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path

from .functions.masking import Rule
from .functions.positions import FAMILIES
from .model import DEFAULTS, UNAVAILABLE
from .operators.schema_history import Field, Table
from .operators.snapshot import MODES


class ConfigError(ValueError):
    pass


@dataclass
class Source:
    family: str
    database: str = ""
    path: str = ""  # landing directory or table folder
    host: str = ""
    port: int | None = None
    user: str = ""
    password: str = ""
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    message_include: list[str] = field(default_factory=list)
    message_exclude: list[str] = field(default_factory=list)
    messages: bool = False
    origin_include: list[str] = field(default_factory=list)
    origin_exclude: list[str] = field(default_factory=list)
    interval_mode: str = "postgres"
    hstore_mode: str = "json"
    money_digits: int = 2
    offset_strategy: str = "no_validation"
    unknown_types: bool = False
    poll_interval_ms: int = DEFAULTS["poll_interval_ms"]
    fetch_size: int = DEFAULTS["stream_fetch_size"]


@dataclass
class Snapshot:
    mode: str = "initial"
    collections: list[str] = field(default_factory=list)
    fetch_size: int = DEFAULTS["snapshot_fetch_size"]
    chunk_size: int = DEFAULTS["chunk_size"]
    isolation: str = "repeatable_read"
    signal_collection: str = ""
    signal_path: str = ""
    path: str = ""  # where the tables of incremental snapshots lie, by name
    read_only: bool = False


@dataclass
class Column:
    selector: str
    kind: str
    length: int | None = None
    algorithm: str | None = None
    salt: str = ""

    def rule(self) -> Rule:
        return Rule(self.selector, self.kind, self.length, self.algorithm, self.salt)


@dataclass
class TableColumn:
    name: str
    type: str
    optional: bool = True
    key: bool = False


@dataclass
class TableSchema:
    """A declared table, by the name that selects it (``schema.table``, or ``database.table``)."""

    name: str
    columns: list[TableColumn] = field(default_factory=list)
    version: int = 1

    def table(self) -> Table:
        return Table(self.name, self.version, [Field(c.name, c.type, c.optional, c.key) for c in self.columns])


@dataclass
class Format:
    kind: str = "envelope"  # envelope, native, json_schema, avro, protobuf
    tombstones: bool = True
    placeholder: str = UNAVAILABLE


@dataclass
class Sink:
    kind: str = "stdout"  # stdout, files, kafka
    prefix: str = ""
    path: str = ""
    servers: str = ""
    registry: str = ""
    heartbeat_prefix: str = "heartbeat"
    heartbeat_topic: str = ""
    delivery_timeout_ms: int = DEFAULTS["delivery_timeout_ms"]
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class Runtime:
    state_dir: str = "state"
    checkpoint_dir: str = ""
    channel_capacity: int = DEFAULTS["channel_capacity"]
    max_batch_size: int = DEFAULTS["max_batch_size"]
    flush_interval_ms: int = DEFAULTS["flush_interval_ms"]
    heartbeat_interval_ms: int = 0
    shutdown_timeout_ms: int = DEFAULTS["shutdown_timeout_ms"]
    max_retries: int = DEFAULTS["max_retries"]
    retry_initial_ms: int = DEFAULTS["retry_initial_ms"]
    retry_max_ms: int = DEFAULTS["retry_max_ms"]
    management_port: int = 0  # 0: no management interface
    management_changes: bool = False
    listen_port: int = 0  # bridge: 0: no listener
    listen_token: str = ""


@dataclass
class Config:
    name: str
    source: Source
    snapshot: Snapshot = field(default_factory=Snapshot)
    columns: list[Column] = field(default_factory=list)
    tables: list[TableSchema] = field(default_factory=list)
    format: Format = field(default_factory=Format)
    sink: Sink = field(default_factory=Sink)
    runtime: Runtime = field(default_factory=Runtime)

    def validate(self) -> list[str]:
        """Problems, as texts."""
        out = []

        def check(ok: bool, what: str) -> None:
            if not ok:
                out.append(what)

        check(bool(self.name.strip()), "name: must not be empty")
        check(self.source.family in FAMILIES, f"source.family: one of {', '.join(FAMILIES)}")
        check(self.snapshot.mode in MODES, f"snapshot.mode: one of {', '.join(MODES)}")
        check(self.format.kind in ("envelope", "native", "json_schema", "avro", "protobuf"), "format.kind: unknown")
        check(self.format.kind not in ("json_schema", "avro", "protobuf") or bool(self.tables), f"tables: format {self.format.kind} needs the tables' schemas")
        check(len({t.name for t in self.tables}) == len(self.tables), "tables: a name is given twice")
        check(self.sink.kind in ("stdout", "files", "kafka"), "sink.kind: unknown")
        check(self.sink.kind != "files" or bool(self.sink.path), "sink.path: needed for files")
        check(self.sink.kind != "kafka" or bool(self.sink.servers), "sink.servers: needed for kafka")
        check(self.sink.options.get("acks", "all") in ("all", "-1"), "sink.options.acks: only all or -1")
        check(not (self.source.origin_include and self.source.origin_exclude), "source: origins to include or to exclude, not both")
        check(not (self.source.message_include and self.source.message_exclude), "source: message prefixes to include or to exclude, not both")
        check(self.source.interval_mode in ("postgres", "string", "numeric"), "source.interval_mode: unknown")
        check(self.source.offset_strategy in ("no_validation", "trust_offset", "trust_slot", "trust_greater_lsn"), "source.offset_strategy: unknown")
        r = self.runtime
        for name in ("channel_capacity", "max_batch_size", "flush_interval_ms", "shutdown_timeout_ms", "retry_initial_ms"):
            check(getattr(r, name) > 0, f"runtime.{name}: must be positive")
        check(self.snapshot.chunk_size > 0 and self.snapshot.fetch_size > 0, "snapshot: sizes must be positive")
        check(r.max_retries >= -1, "runtime.max_retries: -1 or more")
        check(r.retry_max_ms >= r.retry_initial_ms, "runtime.retry_max_ms: at least retry_initial_ms")
        for p in [*self.source.include, *self.source.exclude, *self.snapshot.collections]:
            try:
                re.compile(p)
            except re.error as e:
                out.append(f"pattern {p!r}: {e}")
        for c in self.columns:
            try:
                c.rule()
            except (ValueError, re.error) as e:
                out.append(f"columns: {e}")
        return out

    def unhonoured(self) -> list[str]:
        """Options that are set and that a run over a landed source does nothing with: an error there, unless it is told to go on."""
        plain = Config(self.name, Source(self.source.family))
        only_live = {"source": ["host", "port", "user", "password", "interval_mode", "hstore_mode", "money_digits", "unknown_types", "offset_strategy"], "snapshot": ["collections", "isolation", "signal_collection", "signal_path", "read_only"], "sink": ["delivery_timeout_ms"]}
        if self.source.family == "postgresql" and self.snapshot.path:
            only_live["snapshot"].remove("signal_path")
        else:
            only_live["snapshot"].append("path")
        if self.source.family != "mysql":
            only_live["source"] += ["origin_include", "origin_exclude"]
        out = [f"{section}.{name}" for section, names in only_live.items() for name in names if getattr(getattr(self, section), name) != getattr(getattr(plain, section), name)]
        if self.source.family == "bridge" and (self.source.messages or self.source.message_include or self.source.message_exclude):
            out.append("source.messages")
        if self.source.family != "bridge" and self.runtime.listen_port:
            out.append("runtime.listen_port")
        if self.format.kind == "native" and not self.format.tombstones:
            out.append("format.tombstones")  # this format has none
        return out

    def identity(self) -> dict:
        """What the fingerprint is taken of: the data's identity, without secrets and tuning."""
        s = self.source
        return {
            "name": self.name,
            "source": {k: getattr(s, k) for k in ("family", "database", "path", "host", "port", "include", "exclude", "messages", "message_include", "message_exclude", "origin_include", "origin_exclude", "interval_mode", "hstore_mode", "money_digits", "unknown_types")},
            "snapshot": {k: getattr(self.snapshot, k) for k in ("mode", "collections", "signal_collection", "read_only")},
            "columns": [vars(c) | {"salt": bool(c.salt)} for c in self.columns],
            "tables": [t.name for t in self.tables],
            "format": vars(self.format),
            "sink": {"kind": self.sink.kind, "prefix": self.sink.prefix},
        }


def interpolate(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` must be set; ``${NAME:-default}`` need not."""
    env = os.environ if env is None else env

    def value(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise ConfigError(f"environment variable {m[1]} is not set")
        return m[2][2:]

    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(:-[^}]*)?\}", value, text)


def build(kind, data, where: str = ""):
    """A dataclass from plain data; unknown and missing fields are errors."""
    if not isinstance(data, dict):
        raise ConfigError(f"{where or 'configuration'}: a mapping is needed")
    known = {f.name: f for f in fields(kind)}
    if extra := sorted(set(data) - set(known)):
        raise ConfigError(f"unknown field {where}{extra[0]}")
    nested = {"source": Source, "snapshot": Snapshot, "format": Format, "sink": Sink, "runtime": Runtime}
    out = {}
    for name, f in known.items():
        if name not in data:
            if f.default is MISSING and f.default_factory is MISSING:
                raise ConfigError(f"missing field {where}{name}")
            continue
        value = data[name]
        if kind is Config and name in nested:
            value = build(nested[name], value, f"{where}{name}.")
        elif kind is Config and name in ("columns", "tables"):
            value = [build(Column if name == "columns" else TableSchema, c, f"{name}[{i}].") for i, c in enumerate(value)]
        elif kind is TableSchema and name == "columns":
            value = [build(TableColumn, c, f"{where}columns[{i}].") for i, c in enumerate(value)]
        out[name] = value
    return kind(**out)


def load(text: str, env: dict[str, str] | None = None) -> Config:
    import yaml

    config = build(Config, yaml.safe_load(interpolate(text, env)))
    if problems := config.validate():
        raise ConfigError("; ".join(problems))
    return config


def load_file(path: str) -> Config:
    text = Path(path).read_text()
    return from_properties(text)[0] if path.endswith(".properties") else load(text)


def parse_properties(text: str) -> dict[str, str]:
    """Java properties: comments, continuations, escapes, the three separators."""
    lines, held = [], ""
    for raw in text.splitlines():
        line = raw.lstrip()
        if not held and (not line or line[0] in "#!"):
            continue
        line, held = held + line, ""
        if (len(line) - len(line.rstrip("\\"))) % 2:
            held = line[:-1]
            continue
        lines.append(line)
    if held:
        lines.append(held)

    def plain(s: str) -> str:
        named = {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else named.get(m[1], m[1]), s)

    out = {}
    for line in lines:
        m = re.match(r"((?:\\.|[^\\\s=:])*)(?:\s*[=:]\s*|\s+|$)(.*)$", line, re.S)
        out[plain(m[1])] = plain(m[2])
    return out


#: Connector property names and the fields they set.
PROPERTIES = {
    "name": "name", "topic.prefix": "sink.prefix", "database.hostname": "source.host", "database.port": "source.port:int", "database.user": "source.user", "database.password": "source.password", "database.dbname": "source.database",
    "database.names": "source.database", "table.include.list": "source.include:list", "table.exclude.list": "source.exclude:list", "collection.include.list": "source.include:list", "collection.exclude.list": "source.exclude:list",
    "message.prefix.include.list": "source.message_include:list", "message.prefix.exclude.list": "source.message_exclude:list", "gtid.source.includes": "source.origin_include:list", "gtid.source.excludes": "source.origin_exclude:list",
    "interval.handling.mode": "source.interval_mode", "hstore.handling.mode": "source.hstore_mode", "money.fraction.digits": "source.money_digits:int", "include.unknown.datatypes": "source.unknown_types:bool", "poll.interval.ms": "source.poll_interval_ms:int",
    "snapshot.mode": "snapshot.mode", "snapshot.include.collection.list": "snapshot.collections:list", "snapshot.fetch.size": "snapshot.fetch_size:int", "incremental.snapshot.chunk.size": "snapshot.chunk_size:int", "signal.data.collection": "snapshot.signal_collection",
    "signal.file": "snapshot.signal_path", "read.only": "snapshot.read_only:bool", "tombstones.on.delete": "format.tombstones:bool", "unavailable.value.placeholder": "format.placeholder", "max.batch.size": "runtime.max_batch_size:int",
    "max.queue.size": "runtime.channel_capacity:int", "heartbeat.interval.ms": "runtime.heartbeat_interval_ms:int", "topic.heartbeat.prefix": "sink.heartbeat_prefix", "errors.max.retries": "runtime.max_retries:int",
    "errors.retry.delay.initial.ms": "runtime.retry_initial_ms:int", "errors.retry.delay.max.ms": "runtime.retry_max_ms:int", "offset.mismatch.strategy": "source.offset_strategy", "bootstrap.servers": "sink.servers",
}
CLASSES = {"postgres": "postgresql", "mysql": "mysql", "mariadb": "bridge", "sqlserver": "sqlserver", "oracle": "oracle", "mongodb": "mongodb"}


def from_properties(text: str, env: dict[str, str] | None = None) -> tuple[Config, list[str]]:
    """A configuration from connector properties, and warnings about keys that do nothing here."""
    given = {k: interpolate(v, env) for k, v in parse_properties(text).items()}
    data: dict = {"source": {"interval_mode": "numeric", "messages": True}, "snapshot": {}, "format": {}, "sink": {}, "runtime": {}, "columns": []}
    warnings = []
    for key, value in given.items():
        if key == "connector.class":
            data["source"]["family"] = next((f for word, f in CLASSES.items() if word in value.lower()), "bridge")
        elif m := re.fullmatch(r"column\.truncate\.to\.(\d+)\.chars", key):
            data["columns"] += [{"selector": s, "kind": "truncate", "length": int(m[1])} for s in _list(value)]
        elif m := re.fullmatch(r"column\.mask\.with\.(\d+)\.chars", key):
            data["columns"] += [{"selector": s, "kind": "mask", "length": int(m[1])} for s in _list(value)]
        elif m := re.fullmatch(r"column\.mask\.hash(\.v2)?\.(.+)\.with\.salt\.(.+)", key):
            data["columns"] += [{"selector": s, "kind": "hash_v2" if m[1] else "hash_v1", "algorithm": m[2], "salt": m[3]} for s in _list(value)]
        elif key in PROPERTIES:
            path, _, kind = PROPERTIES[key].partition(":")
            typed = {"int": lambda v: int(v), "bool": lambda v: v.strip().lower() == "true", "list": _list}.get(kind, lambda v: v)(value)
            section, _, name = path.partition(".")
            if name:
                data[section][name] = typed
            else:
                data[section] = typed
        else:
            warnings.append(f"{key} is not used")
    if data["snapshot"].get("mode") in ("no_data", "schema_only"):
        data["snapshot"]["mode"] = "never"
    data.setdefault("name", data["sink"].get("prefix", ""))
    config = build(Config, data)
    if problems := config.validate():
        raise ConfigError("; ".join(problems))
    return config, warnings


def _list(value: str) -> list[str]:
    """A comma list whose members may hold commas in brackets."""
    return [p.strip() for p in re.split(r",(?![^\[({]*[\])}])", value) if p.strip()]
