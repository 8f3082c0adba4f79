"""What a user of the engine calls."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from glyphsieve.functions.chars import CHARS as chars
from glyphsieve.functions.globs import VIRTUAL as virtual_pattern
from glyphsieve.functions.globs import GlobError, normalized, relative_to_root, to_posix
from glyphsieve.functions.globs import extensions as pattern_extensions
from glyphsieve.functions.sentences import FIXES as fix_strategies
from glyphsieve.functions.sentences import FixContext, clause_separator, is_fix_name
from glyphsieve.functions.text import looks_binary, strip_bom
from glyphsieve.operators.baseline import BaselineError
from glyphsieve.operators.fix import apply_fixes, fix_to_fixpoint, fixed, fixed_files
from glyphsieve.operators.scan import ordered, scan, skipped
from glyphsieve.operators.textscan import scan_text
from glyphsieve.plans.config import FILENAMES as config_filenames
from glyphsieve.plans.config import ConfigError, ConfigNotFoundError, Loaded, define, load, scan_options, validate
from glyphsieve.plans.planner import DEFAULT_IGNORE, plan, rule_counts, warnings
from glyphsieve.plans.rules import DEFAULT_TEXT_ATTRIBUTES, Rule, RuleError, UnsupportedScopeError, compile_rule, file_rules, invisibles, no_ai_punctuation, scope_supports, virtual_rules
from glyphsieve.sources.files import GitError, folder, read_files, unreadable


def scan_with_config(files: DataFrame, loaded: Loaded, paths: list[str] | None = None, **options: Any) -> DataFrame:
    return scan(files, **scan_options(loaded, paths), **options)


__all__ = [
    "DEFAULT_IGNORE",
    "DEFAULT_TEXT_ATTRIBUTES",
    "BaselineError",
    "ConfigError",
    "ConfigNotFoundError",
    "FixContext",
    "GitError",
    "GlobError",
    "Loaded",
    "Rule",
    "RuleError",
    "UnsupportedScopeError",
    "apply_fixes",
    "chars",
    "clause_separator",
    "compile_rule",
    "config_filenames",
    "define",
    "file_rules",
    "fix_strategies",
    "fix_to_fixpoint",
    "fixed",
    "fixed_files",
    "folder",
    "invisibles",
    "is_fix_name",
    "load",
    "looks_binary",
    "no_ai_punctuation",
    "normalized",
    "ordered",
    "pattern_extensions",
    "plan",
    "read_files",
    "relative_to_root",
    "rule_counts",
    "scan",
    "scan_options",
    "scan_text",
    "scan_with_config",
    "scope_supports",
    "skipped",
    "strip_bom",
    "to_posix",
    "unreadable",
    "validate",
    "virtual_pattern",
    "virtual_rules",
    "warnings",
]
