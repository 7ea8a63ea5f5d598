"""Compiler message streams: JSON lines, classified without failing on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest line that is parsed, in bytes; a longer one counts as malformed.
LINE_BYTES = 1 << 20
KNOWN = ("compiler-artifact", "build-script-executed", "build-finished")
SPAN = "struct<file_name:string,line_start:bigint,line_end:bigint,column_start:bigint,column_end:bigint,is_primary:boolean>"
MESSAGE = f"struct<reason:string,package_id:string,target:struct<name:string,kind:array<string>>,success:boolean,message:struct<message:string,level:string,code:struct<code:string>,spans:array<{SPAN}>>>"


def _json(line: Column) -> Column:
    return F.try_parse_json(line)


def classify(line: Column) -> Column:
    """empty, noise, malformed, unknown, known or message, for one line without its end."""
    trimmed = F.regexp_replace(F.regexp_replace(line, r"\r$", ""), r"^[\x09\x0A\x0C\x0D\x20]+", "")
    reason = F.get_json_object(trimmed, "$.reason")
    parsed = _json(trimmed)
    # Text before a complete message: something else wrote on its line.
    contaminated = trimmed.rlike(r'\{.*"reason"\s*:\s*".*\}\s*$')
    return (
        F.when(F.octet_length(line) > LINE_BYTES, "malformed")
        .when(F.length(line) == 0, "empty")
        .when(trimmed == "", "noise")
        .when(~trimmed.startswith("{"), F.when(contaminated, "malformed").otherwise("noise"))
        .when(parsed.isNull() | reason.isNull(), "malformed")
        .when(reason == "compiler-message", F.when(F.get_json_object(trimmed, "$.message.message").isNull(), "malformed").otherwise("message"))
        .when(reason.isin(*KNOWN), "known")
        .otherwise("unknown")
    )


def severity(level: Column) -> Column:
    """error for errors, failure notes and crashes; warning; info for notes and help; else unknown."""
    return F.when(level.isin("error", "failure-note", "error: internal compiler error"), "error").when(level == "warning", "warning").when(level.isin("note", "help"), "info").otherwise("unknown")


def context_of_kinds(kinds: Column) -> Column:
    """The first target kind that has a context."""
    named = F.transform(kinds, lambda k: F.when(k == "test", "tests").when(k == "bench", "benches").when(k == "example", "examples").when(k == "custom-build", "build_script"))
    return F.try_element_at(F.filter(named, lambda k: k.isNotNull()), F.lit(1))


def findings(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Messages as findings: code (an empty one is none), severity, message, package, target, context, primary path and span."""
    parsed = lines.where(classify(F.col(line_col)) == "message").select(F.from_json(line_col, MESSAGE).alias("m"))
    spans = F.filter("m.message.spans", lambda s: s["is_primary"])
    keyed = F.transform(spans, lambda s: F.struct(s["file_name"].isNull().alias("no_path"), s["file_name"].alias("path"), s["line_start"], s["column_start"], s["line_end"], s["column_end"]))
    first = F.array_min(keyed)
    return parsed.select(
        F.nullif(F.col("m.message.code.code"), F.lit("")).alias("code"),
        severity(F.col("m.message.level")).alias("severity"),
        F.col("m.message.message").alias("message"),
        F.col("m.package_id").alias("package"),
        F.col("m.target.name").alias("target"),
        context_of_kinds(F.col("m.target.kind")).alias("context"),
        first["path"].alias("path"),
        F.when(first.isNotNull(), F.struct(first["line_start"].alias("line_start"), first["column_start"].alias("column_start"), first["line_end"].alias("line_end"), first["column_end"].alias("column_end"))).alias("span"),
    )
