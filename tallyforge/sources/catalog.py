"""The rule catalog and the noise rates, as small constant relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rules with their category, producer and tier.
_RULES = [
    ("clippy::arc_with_non_send_sync", "correctness", "clippy", "P1"),
    ("clippy::await_holding_lock", "correctness", "clippy", "P1"),
    ("clippy::await_holding_refcell_ref", "correctness", "clippy", "P1"),
    ("clippy::mut_mutex_lock", "correctness", "clippy", "P2"),
    ("clippy::non_send_fields_in_send_ty", "correctness", "clippy", "P1"),
    ("clippy::panic_in_result_fn", "correctness", "clippy", "P2"),
    ("clippy::rc_mutex", "correctness", "clippy", "P2"),
    ("clippy::suspicious_command_arg_space", "correctness", "clippy", "P2"),
    ("clippy::todo", "correctness", "clippy", "P2"),
    ("clippy::unimplemented", "correctness", "clippy", "P1"),
    ("clippy::unreachable", "correctness", "clippy", "P2"),
    ("clippy::exit", "reliability", "clippy", "P2"),
    ("clippy::expect_used", "reliability", "clippy", "P3"),
    ("clippy::indexing_slicing", "reliability", "clippy", "P3"),
    ("clippy::mem_forget", "reliability", "clippy", "P2"),
    ("clippy::panic", "reliability", "clippy", "P3"),
    ("clippy::string_slice", "reliability", "clippy", "P3"),
    ("clippy::unwrap_used", "reliability", "clippy", "P3"),
    ("clippy::zombie_processes", "reliability", "clippy", "P2"),
    ("clippy::format_collect", "performance", "clippy", "P3"),
    ("clippy::large_types_passed_by_value", "performance", "clippy", "P3"),
    ("clippy::manual_memcpy", "performance", "clippy", "P3"),
    ("clippy::ptr_arg", "performance", "clippy", "P3"),
    ("clippy::rc_buffer", "performance", "clippy", "P3"),
    ("clippy::redundant_allocation", "performance", "clippy", "P2"),
    ("clippy::stable_sort_primitive", "performance", "clippy", "P3"),
    ("clippy::unnecessary_to_owned", "performance", "clippy", "P3"),
    ("clippy::useless_vec", "performance", "clippy", "P3"),
    ("clippy::vec_init_then_push", "performance", "clippy", "P3"),
    ("clippy::dbg_macro", "maintainability", "clippy", "P3"),
    ("clippy::missing_safety_doc", "maintainability", "clippy", "P3"),
    ("clippy::print_stderr", "maintainability", "clippy", "P3"),
    ("clippy::print_stdout", "maintainability", "clippy", "P3"),
    ("clippy::too_many_arguments", "maintainability", "clippy", "P3"),
    ("clippy::type_complexity", "maintainability", "clippy", "P3"),
    ("clippy::unused_async", "maintainability", "clippy", "P3"),
    ("clippy::permissions_set_readonly_false", "security", "clippy", "P1"),
    ("cargo::duplicate_major_versions", "dependencies", "cargo", "P2"),
    ("cargo::missing_lockfile", "dependencies", "cargo", "P2"),
    ("cargo::path_dependency_outside_workspace", "dependencies", "cargo", "P1"),
    ("cargo::test_only_dependency", "dependencies", "cargo", "P2"),
    ("cargo::unused_dependency", "dependencies", "cargo", "P2"),
    ("cargo::permissive_lint_table", "reliability", "cargo", "P2"),
    ("cargo::permissive_rustflags", "reliability", "cargo", "P2"),
    ("cargo::release_debug_symbols", "reliability", "cargo", "P3"),
    ("cargo::unbounded_registry_dependency", "reliability", "cargo", "P3"),
    ("cargo::unchecked_release_overflow", "reliability", "cargo", "P3"),
    ("cargo::unpinned_git_dependency", "security", "cargo", "P1"),
    ("repo::hardcoded_credential", "security", "repo", "P1"),
    ("repo::tracked_secret_file", "security", "repo", "P1"),
    ("repo::unignored_build_output", "maintainability", "repo", "P3"),
    ("source::disabled_tls_verification", "security", "source", "P0"),
    ("source::dynamic_shell_command", "security", "source", "P0"),
    ("structure::complex_function", "maintainability", "structure", "P3"),
    ("structure::duplicate_function_body", "maintainability", "structure", "P3"),
    ("structure::near_duplicate_function_body", "maintainability", "structure", "P3"),
    ("structure::orphan_module_file", "maintainability", "structure", "P3"),
    ("structure::oversized_unit", "maintainability", "structure", "P3"),
    ("structure::stacked_allow_attribute", "maintainability", "structure", "P3"),
    ("structure::unreasoned_allow_attribute", "maintainability", "structure", "P3"),
    ("structure::unreferenced_feature", "maintainability", "structure", "P3"),
    ("structure::crate_level_allow", "reliability", "structure", "P2"),
]
# Measured false-positive rates in basis points.
_NOISE = {
    "clippy::exit": 10000,
    "clippy::expect_used": 8000,
    "clippy::indexing_slicing": 10000,
    "clippy::mem_forget": 10000,
    "clippy::missing_safety_doc": 0,
    "clippy::panic": 10000,
    "clippy::panic_in_result_fn": 10000,
    "clippy::print_stderr": 10000,
    "clippy::ptr_arg": 0,
    "clippy::rc_buffer": 0,
    "clippy::stable_sort_primitive": 0,
    "clippy::string_slice": 10000,
    "clippy::too_many_arguments": 10000,
    "clippy::unreachable": 8000,
    "clippy::unwrap_used": 10000,
    "cargo::duplicate_major_versions": 0,
    "cargo::unchecked_release_overflow": 3333,
    "structure::complex_function": 8709,
    "structure::crate_level_allow": 10000,
    "structure::duplicate_function_body": 4000,
    "structure::near_duplicate_function_body": 6333,
    "structure::oversized_unit": 3333,
    "structure::unreasoned_allow_attribute": 10000,
    "structure::unreferenced_feature": 10000,
}
# End of the fixed values.

#: Rules over the documents of this engine's own tables: category, producer, tier, severity, noise (None: unmeasured).
DOCUMENT_RULES = {
    "oversized_unit": ("maintainability", "structure", "P3", "warning", 3333),
    "duplicate_body": ("maintainability", "structure", "P3", "warning", 4000),
    "repeated_line": ("maintainability", "structure", "P3", "info", 10000),
    "email": ("security", "repo", "P1", "error", None),
    "license_line": ("dependencies", "cargo", "P2", "warning", 0),
    "token_literal": ("security", "repo", "P1", "error", None),
}

RULE_SCHEMA = "id string, category string, producer string, default_level string, tier string, help string"


def rules() -> list[tuple]:
    """(id, category, producer, default_level, tier, help), by id; every default level is warn."""
    return sorted((rule, category, producer, "warn", tier, rule.split("::")[1].replace("_", " ").capitalize()) for rule, category, producer, tier in _RULES)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), RULE_SCHEMA)


def noise_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(_NOISE.items()), "id string, noise_bp int")


def document_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DOCUMENT_RULES.items()], "rule string, category string, producer string, tier string, severity string, noise_bp int")
