"""Configuration: an INI document with a general section and one section per source."""

from __future__ import annotations

import os
import re
from configparser import ConfigParser, ExtendedInterpolation
from dataclasses import dataclass, field

from .plans.partition import NONE, POLICIES

GENERAL = "CONFIGURATION"
FORMATS = {"N-TRIPLES": ".nt", "N-QUADS": ".nq"}


class ConfigError(ValueError):
    pass


@dataclass
class Source:
    name: str
    mappings: list[str] = field(default_factory=list)
    file_path: str = ""
    db_url: str = ""
    connect_args: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)


@dataclass
class Config:
    sources: dict[str, Source] = field(default_factory=dict)
    na_values: tuple[str, ...] = ("", "nan")
    literal_escaping_chars: tuple[str, ...] = ('"', "\n", "\r")
    output_file: str = "knowledge-graph"
    output_dir: str = ""
    output_format: str = "N-TRIPLES"
    only_printable_chars: bool = False
    safe_percent_encoding: str = ""
    mapping_partitioning: str = "PARTIAL-AGGREGATIONS"
    infer_sql_datatypes: bool = False
    udfs: str = ""
    api_token: str = ""
    logging_level: str = "INFO"
    logging_file: str = ""
    output_kafka_server: str = ""
    output_kafka_topic: str = ""
    self_join_elimination: bool = True
    compat: bool = False

    @property
    def output_path(self) -> str:
        ext = FORMATS[self.output_format]
        return self.output_file if self.output_file.endswith(ext) else self.output_file + ext


def _flag(text: str) -> bool:
    if text.strip().lower() not in ("yes", "no", "true", "false", "on", "off", "1", "0"):
        raise ConfigError(f"{text!r} is neither yes nor no")
    return text.strip().lower() in ("yes", "true", "on", "1")


def _chars(text: str) -> tuple[str, ...]:
    return tuple(x.encode().decode("unicode_escape") if "\\" in x else x for x in text.split(","))


RENAMED = {"only_printable_characters": "only_printable_chars", "logs_file": "logging_file"}


def load_config(text_or_path: str) -> Config:
    """From a file or from INI text. Environment variables stand as ${NAME} or {NAME} in db_url."""
    text = text_or_path
    if "\n" not in text and os.path.exists(text):
        with open(text, encoding="utf-8") as f:
            text = f.read()
    elif "[" not in text:
        raise ConfigError(f"no configuration at {text!r}")
    ini = ConfigParser(interpolation=ExtendedInterpolation(), strict=True, delimiters=("=", ":"))
    ini.optionxform = str.lower
    ini.read_string(re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), text))
    config = Config()
    if ini.has_section(GENERAL):
        for key in ini.options(GENERAL):
            name, value = RENAMED.get(key, key), ini.get(GENERAL, key)
            if name in ("na_values",):
                config.na_values = tuple(value.split(","))
            elif name == "literal_escaping_chars":
                config.literal_escaping_chars = _chars(value)
            elif name in ("only_printable_chars", "infer_sql_datatypes", "self_join_elimination", "compat"):
                setattr(config, name, _flag(value))
            elif name in ("number_of_processes", "read_parsed_mappings_path", "write_parsed_mappings_path"):
                continue  # Spark schedules; parsed mappings aren't kept
            elif hasattr(config, name) and name != "sources":
                setattr(config, name, value.strip())
    config.output_format = config.output_format.upper()
    if config.output_format not in FORMATS:
        raise ConfigError(f"output_format must be one of {sorted(FORMATS)}")
    policy = config.mapping_partitioning.upper()
    config.mapping_partitioning = "NO" if policy in NONE else policy
    if config.mapping_partitioning not in POLICIES:
        raise ConfigError(f"mapping_partitioning must be one of {sorted(POLICIES)}")
    if config.logging_level.upper() not in ("NOTSET", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
        raise ConfigError(f"unknown logging_level {config.logging_level!r}")
    for name in ini.sections():
        if name == GENERAL:
            continue
        s = Source(name)
        for key in ini.options(name):
            value = ini.get(name, key).strip()
            if key == "mappings":
                s.mappings = [x.strip() for x in re.split(r"[,\n]", value) if x.strip()]
            elif key == "connect_args":
                import ast

                s.connect_args = ast.literal_eval(value) if value else {}
            elif key in ("file_path", "db_url"):
                setattr(s, key, value)
            else:
                s.options[key] = value
        if not s.mappings:
            raise ConfigError(f"section {name} names no mappings")
        config.sources[name] = s
    if not config.sources:
        raise ConfigError("no source section")
    return config
