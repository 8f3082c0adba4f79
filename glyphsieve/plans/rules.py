"""Rules: what is banned, where, and what to write instead."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

import regex

from glyphsieve.functions import chars, globs, patterns
from glyphsieve.functions.sentences import FIXES, Fix

SEVERITIES = ("error", "warn")
SCOPE_EXTENSIONS: dict[str, tuple[str, ...] | None] = {
    "raw": None,
    "strings": (".ts", ".mts", ".cts", ".tsx", ".js", ".mjs", ".cjs", ".jsx"),
    "markup": (".vue",),
    "markdown": (".md", ".markdown"),
    "html": (".html", ".htm"),
}
SCOPES = tuple(SCOPE_EXTENSIONS)
DEFAULT_TEXT_ATTRIBUTES = ("title", "alt", "placeholder", "label", "aria-label", "aria-description", "aria-placeholder")


class RuleError(ValueError):
    """A rule that can't be used."""


class UnsupportedScopeError(ValueError):
    """A scope that doesn't exist."""

    def __init__(self, scope: str):
        super().__init__(f'there is no scope "{scope}"; there are {", ".join(SCOPES)}')
        self.scope = scope


def scope_supports(scope: str, file: str) -> bool:
    ends = SCOPE_EXTENSIONS[scope]
    return ends is None or file.lower().endswith(ends)


@dataclass(frozen=True)
class Rule:
    """``chars`` or ``pattern``; ``fix`` is a text, a function of a FixContext, or None."""

    id: str
    include: tuple[str, ...] = ()
    chars: tuple[str, ...] | None = None
    pattern: str | None = None
    message: str | None = None
    fix: str | Fix | None = None
    severity: str = "error"
    exclude: tuple[str, ...] = ()
    scope: str = "raw"

    @classmethod
    def of(cls, value: Rule | dict[str, Any]) -> Rule:
        if isinstance(value, cls):
            return value
        known = {k: v for k, v in value.items() if v is not None}
        for name in ("include", "exclude", "chars"):
            if name in known:
                known[name] = tuple(known[name])
        return cls(**known)

    @cached_property
    def source(self) -> str:
        """The rule's pattern in JavaScript's syntax."""
        if not self.id:
            raise RuleError("a rule needs an id")
        if (self.chars is None) == (self.pattern is None):
            raise RuleError(f'rule "{self.id}" needs either chars or a pattern, and not both')
        if self.pattern is not None:
            return self.pattern
        if not self.chars or any(not c for c in self.chars):
            raise RuleError(f'rule "{self.id}" has no chars or an empty one')
        # the longest first, so that none hides one that it begins; then by UTF-16 units
        return "|".join(patterns.escape(c) for c in sorted(self.chars, key=lambda c: (-len(c.encode("utf-16-le")), c.encode("utf-16-be"))))

    @cached_property
    def java(self) -> str:
        try:
            return patterns.for_java(self.source)
        except patterns.PatternError as cause:
            raise RuleError(f'rule "{self.id}": {cause}') from cause

    @cached_property
    def python(self) -> regex.Pattern[str]:
        try:
            return patterns.for_python(self.source)
        except patterns.PatternError as cause:
            raise RuleError(f'rule "{self.id}": {cause}') from cause

    @cached_property
    def positive(self) -> bool:
        """Whether the pattern can't match nothing, as far as Python's own parser can tell."""
        if self.chars is not None:
            return True
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                from re import _parser

                return _parser.parse(self.python.pattern).getwidth()[0] > 0
            except Exception:  # noqa: BLE001  # an expression that only other engines read
                return False

    def check(self) -> Rule:
        if self.scope not in SCOPES:
            raise UnsupportedScopeError(self.scope)
        if self.severity not in SEVERITIES:
            raise RuleError(f'rule "{self.id}" has an unknown severity')
        assert self.java
        return self

    @property
    def native(self) -> bool:
        """Whether Spark's own expressions can do all of it."""
        return self.scope == "raw" and not callable(self.fix)

    def message_for(self, match: str) -> str:
        if self.message is not None:
            return self.message
        return f"Banned character {chars.describe(match.strip(chars.SPACES) or match)}"

    def in_files(self) -> Rule | None:
        """The rule without patterns that name no files; None if no other is left."""
        include = tuple(p for p in self.include if not globs.VIRTUAL.fullmatch(p))
        return self if len(include) == len(self.include) else replace(self, include=include) if include else None


def compile_rule(value: Rule | dict[str, Any]) -> Rule:
    return Rule.of(value).check()


def file_rules(rules: list[Rule]) -> list[Rule]:
    return [r for rule in rules if (r := rule.in_files()) is not None]


def virtual_rules(rules: list[Rule], target: str) -> list[Rule]:
    """Rules for what isn't a file, such as <commit-msg>."""
    return [r for r in rules if f"<{target}>" in r.include]


def fix_named(fix: str) -> Fix:
    return FIXES[fix]


def _preset(id_: str, names: str, message: str, options: dict[str, Any]) -> Rule:
    prefix = options.get("id_prefix")
    return Rule(f"{prefix}/{id_}" if prefix else id_, tuple(options["include"]), tuple(chars.CHARS[n] for n in names.split()), None, message, exclude=tuple(options.get("exclude") or ()), scope=options.get("scope") or "raw")


def no_ai_punctuation(**options: Any) -> list[Rule]:
    """Typographic characters that keyboards don't have; options: include, exclude, scope, id_prefix."""
    return [
        _preset("no-fancy-dashes", "EM_DASH EN_DASH HORIZONTAL_BAR", "Write a hyphen or a comma, or say it in another way.", options),
        _preset("no-smart-quotes", "LEFT_SINGLE_QUOTE RIGHT_SINGLE_QUOTE LEFT_DOUBLE_QUOTE RIGHT_DOUBLE_QUOTE", "Write a straight quote.", options),
        _preset("no-ellipsis-character", "HORIZONTAL_ELLIPSIS", "Write three dots.", options),
        _preset("no-exotic-spaces", "NO_BREAK_SPACE NARROW_NO_BREAK_SPACE", "Write an ordinary space.", options),
    ]


def invisibles(**options: Any) -> list[Rule]:
    """Characters that nobody sees; options as above."""
    bidi = "LEFT_TO_RIGHT_MARK RIGHT_TO_LEFT_MARK LEFT_TO_RIGHT_EMBEDDING RIGHT_TO_LEFT_EMBEDDING POP_DIRECTIONAL_FORMATTING LEFT_TO_RIGHT_OVERRIDE RIGHT_TO_LEFT_OVERRIDE LEFT_TO_RIGHT_ISOLATE RIGHT_TO_LEFT_ISOLATE FIRST_STRONG_ISOLATE POP_DIRECTIONAL_ISOLATE"
    return [
        _preset("no-zero-width", "ZERO_WIDTH_SPACE ZERO_WIDTH_NON_JOINER ZERO_WIDTH_JOINER WORD_JOINER SOFT_HYPHEN", "It has no width. Remove it.", options),
        _preset("no-bidi-controls", bidi, "It changes the direction of text. Remove it.", options),
    ]
