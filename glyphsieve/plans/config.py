"""Configurations: found, read, and checked as a whole before anything runs."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from glyphsieve.functions import globs, patterns
from glyphsieve.plans.rules import SCOPE_EXTENSIONS, SCOPES, SEVERITIES, Rule, file_rules

FILENAMES = ("glyphsieve.config.json",)
PACKAGE_KEY = "glyphsieve"


class ConfigError(ValueError):
    """Everything that is wrong with a configuration."""

    def __init__(self, problems: list[str], source: str | None = None):
        super().__init__(f"the configuration{f' in {source}' if source else ''} can't be used:\n" + "\n".join(f"  - {p}" for p in problems))
        self.problems = problems


class ConfigNotFoundError(FileNotFoundError):
    def __init__(self, start: str):
        example = json.dumps({"rules": [{"id": "no-em-dash", "chars": ["—"], "include": ["**/*.md"]}]})
        super().__init__(f"there is no {FILENAMES[0]} in {start} or above. A first one could be: {example}")


def define(config: dict[str, Any]) -> dict[str, Any]:
    return config


def _strings(value: Any, name: str, problems: list[str]) -> list[str] | None:
    if not isinstance(value, (list, tuple)):
        problems.append(f"{name} isn't a list of strings")
    elif any(not isinstance(x, str) for x in value):
        problems.append(f"{name} holds something other than strings")
    else:
        return list(value)
    return None


def _rule(value: Any, i: int, problems: list[str]) -> None:
    if not isinstance(value, dict):
        problems.append(f"rule {i} isn't an object")
        return
    id_ = value.get("id")
    name = f'rule "{id_}"' if isinstance(id_, str) and id_ else f"rule {i}"
    if not isinstance(id_, str) or not id_:
        problems.append(f"{name} has no id")
    chars, pattern = value.get("chars"), value.get("pattern")
    if (chars is None) == (pattern is None):
        problems.append(f"{name} needs either chars or a pattern" if chars is None else f"{name} has both chars and a pattern")
    if chars is not None and (known := _strings(chars, f"chars of {name}", problems)) is not None:
        if not known:
            problems.append(f"chars of {name} is empty")
        if "" in known:
            problems.append(f"chars of {name} holds an empty string")
    if pattern is not None:
        if not isinstance(pattern, str):
            problems.append(f"the pattern of {name} isn't a string")
        else:
            try:
                patterns.for_python(pattern)
            except patterns.PatternError as cause:
                problems.append(f"the pattern of {name} can't be read: {cause}")
    include = value.get("include")
    if include is None:
        problems.append(f"{name} has no include, so it would read nothing")
    elif (include := _strings(include, f"include of {name}", problems)) is not None and not include:
        problems.append(f"include of {name} is empty")
    if value.get("exclude") is not None:
        _strings(value["exclude"], f"exclude of {name}", problems)
    scope = value.get("scope")
    if scope is not None and scope not in SCOPES:
        problems.append(f"the scope of {name} is none of {', '.join(SCOPES)}")
    if value.get("severity") is not None and value["severity"] not in SEVERITIES:
        problems.append(f"the severity of {name} is neither error nor warn")
    fix = value.get("fix")
    if fix is not None and not isinstance(fix, str) and not callable(fix):
        problems.append(f"the fix of {name} is neither a text nor a function")
    if value.get("message") is not None and not isinstance(value["message"], str):
        problems.append(f"the message of {name} isn't a string")
    ends = SCOPE_EXTENSIONS.get(scope or "raw") if isinstance(scope or "raw", str) else None
    for p in include if ends and include else ():
        if not globs.VIRTUAL.fullmatch(p):
            wrong = [e for e in globs.extensions(p) or () if e not in ends]
            if wrong:
                problems.append(f'{name} has scope "{scope}", which reads {", ".join(ends)} and would find nothing in the {", ".join(wrong)} of "{p}"')


def validate(value: Any, source: str | None = None) -> dict[str, Any]:
    """The configuration, if it is right; else all its problems at once."""
    if not isinstance(value, dict):
        raise ConfigError(["it isn't an object"], source)
    problems: list[str] = []
    rules = value.get("rules")
    if not isinstance(rules, (list, tuple)):
        problems.append("rules isn't a list")
    elif not rules:
        problems.append("there are no rules, so nothing would be checked")
    else:
        seen: set[str] = set()
        for i, rule in enumerate(rules):
            if isinstance(rule, Rule):
                rule = {k: v for k, v in vars(rule).items() if k in Rule.__dataclass_fields__ and v is not None}
            _rule(rule, i, problems)
            if isinstance(rule, dict) and isinstance(id_ := rule.get("id"), str):
                if id_ in seen:
                    problems.append(f'two rules are called "{id_}"')
                seen.add(id_)
    for name in ("ignore", "textAttributes"):
        if value.get(name) is not None:
            _strings(value[name], name, problems)
    baseline = value.get("baseline")
    if baseline is not None and not isinstance(baseline, (str, bool)):
        problems.append("baseline is neither a path nor true or false")
    elif isinstance(baseline, str) and not baseline.strip():
        problems.append("baseline is an empty path")
    markup = value.get("markup")
    if markup is not None and not isinstance(markup, dict):
        problems.append("markup isn't an object")
    elif markup and markup.get("textAttributes") is not None:
        _strings(markup["textAttributes"], "markup.textAttributes", problems)
        if value.get("textAttributes") is not None:
            problems.append("textAttributes and markup.textAttributes are one setting and both are given; keep the first")
    if problems:
        raise ConfigError(problems, source)
    return value


@dataclass(frozen=True)
class Loaded:
    config: dict[str, Any]
    path: str
    root: str

    @property
    def rules(self) -> list[Rule]:
        return [Rule.of(r) for r in self.config["rules"]]


def _json(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        try:
            return json.load(f)
        except ValueError as cause:
            raise ConfigError([f"it isn't JSON: {cause}"], path) from cause


def load(start: str = ".", path: str | None = None) -> Loaded:
    """The configuration at path, or the nearest one from the start upward: a file of its own, or a key of package.json."""
    if path is not None:
        whole = os.path.abspath(os.path.join(start, path))
        if not os.path.isfile(whole):
            raise ConfigError([f"there is no file {whole}"])
        return Loaded(validate(_json(whole), whole), whole, os.path.dirname(whole))
    at = os.path.abspath(start)
    while True:
        for name in FILENAMES:
            if os.path.isfile(whole := os.path.join(at, name)):
                return Loaded(validate(_json(whole), whole), whole, at)
        if os.path.isfile(whole := os.path.join(at, "package.json")) and (own := _json(whole).get(PACKAGE_KEY)) is not None:
            return Loaded(validate(own, whole), whole, at)
        if at == (at := os.path.dirname(at)):
            raise ConfigNotFoundError(os.path.abspath(start))


def text_attributes(config: dict[str, Any]) -> tuple[str, ...] | None:
    found = config.get("textAttributes")
    if found is None:
        found = (config.get("markup") or {}).get("textAttributes")
    return None if found is None else tuple(found)


def scan_options(loaded: Loaded, paths: Iterable[str] | None = None) -> dict[str, Any]:
    """Arguments for the scan of a table of files."""
    return {"rules": file_rules(loaded.rules), "ignore": tuple(loaded.config.get("ignore") or ()), "text_attributes": text_attributes(loaded.config), "paths": paths}
