"""Names resolved through imports in nested scopes, and the rules that need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nesting import holders, levels

# Crates that need no declaration, and what the two rules look for.
SYSROOT = ("alloc", "core", "std")
TLS_CLIENTS = ("Client", "blocking::Client")
COMMAND = "process::Command"
SHELLS = ("bash", "dash", "sh", "zsh")
CERTIFICATES = ("tls_danger_accept_invalid_certs", "danger_accept_invalid_certs")
HOST_NAMES = ("tls_danger_accept_invalid_hostnames", "danger_accept_invalid_hostnames")
# End of the fixed values.
#: Starts of the scope of a whole unit, and an end behind all places.
UNIT, END = -1, (1 << 62)


def _deal(rows: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """Rows over so many parts, as by their size alone too many would be put together: they shrink when they are sent."""
    return rows.repartition(parts, *by) if parts else rows


def scopes(marks: DataFrame, parts: int | None = None) -> DataFrame:
    """(unit, start, stop, module, inside): marks with unit, pos, mark and module (bool, of opening ones) as intervals.

    One that never closes ends with its unit. ``module`` tells those that imports
    don't cross, ``inside`` is the start of the innermost of these, itself included.
    """
    leveled = levels(marks, "unit", parts)
    closing = holders(leveled, "unit", []).where("mark < 0 and holder is not null")
    stops = closing.groupBy("unit", F.col("holder.pos").alias("start")).agg(F.min("pos").alias("stop"))
    opened = within(marks.where("mark > 0"), marks, parts).select("unit", F.col("pos").alias("start"), "module", "inside")
    own = _deal(opened, parts, "unit", "start").join(_deal(stops, parts, "unit", "start"), ["unit", "start"], "left").select("unit", F.col("start").cast("bigint").alias("start"), F.coalesce(F.col("stop").cast("bigint"), F.lit(END)).alias("stop"), "module", F.when(F.col("module"), F.col("start").cast("bigint")).otherwise(F.col("inside")).alias("inside"))
    whole = _deal(marks.select("unit").distinct(), parts, "unit").select("unit", F.lit(UNIT).cast("bigint").alias("start"), F.lit(END).alias("stop"), F.lit(True).alias("module"), F.lit(UNIT).cast("bigint").alias("inside"))
    return own.unionByName(whole)


def within(rows: DataFrame, marks: DataFrame, parts: int | None = None) -> DataFrame:
    """With ``inside``, the start of the innermost module that holds each row (unit, pos), the unit itself if none."""
    leveled = levels(marks, "unit", parts)
    closed = holders(leveled, "unit", ["module"]).where("mark < 0 and holder.module").select("unit", "pos", F.lit(-1).alias("mark"))
    bounds = marks.where("mark > 0 and module").select("unit", "pos", F.lit(1).alias("mark")).unionByName(closed)
    asked = rows.select("*", F.lit(0).alias("_asks"))
    columns = [c for c in rows.columns if c not in ("unit", "pos", "mark")]
    held = F.struct(*[F.col(c) for c in columns], *([F.col("mark").alias("_mark")] if "mark" in rows.columns else [])).alias("_row")
    probe = asked.select("unit", "pos", F.lit(0).alias("mark"), held)
    every = bounds.select("unit", "pos", "mark", F.lit(None).cast(probe.schema["_row"].dataType).alias("_row")).unionByName(probe)
    # A row on the very mark that opens a module stands outside of it.
    order = F.col("pos") * 2 + F.when(F.col("_row").isNull(), 1).otherwise(0)
    found = holders(levels(every.withColumn("pos", order), "unit", parts), "unit", []).where("_row is not null")
    restored = [F.col(f"_row.{c}").alias(c) for c in columns] + ([F.col("_row._mark").alias("mark")] if "mark" in rows.columns else [])
    return found.select("unit", F.expr("pos div 2").alias("pos"), *restored, F.coalesce(F.expr("(holder.pos - 1) div 2"), F.lit(UNIT)).cast("bigint").alias("inside"))


def resolve(scoped: DataFrame, bindings: DataFrame, uses: DataFrame, marks: DataFrame, limit: int | None = None, parts: int | None = None) -> DataFrame:
    """Uses (unit, pos, name, and more) with ``verdict`` (item, indeterminate, unbound) and ``path``.

    ``bindings`` have unit, pos, name (null: all names of some module) and path (null:
    something of that name is declared here). The innermost scope within the use's
    module that binds the name or takes in all names decides; in one scope the name
    goes before all names, the last binding before the others. All bindings count,
    however many a unit has; only with a ``limit`` more of them leave all its names undecided.

    Scopes are intervals: a binding belongs to the innermost one around it, and a use
    sees those around it. Both are found by ordering marks, so that time grows with a
    unit's rows and not with pairs of them. ``parts`` says over how many parts rows are dealt.
    """
    if limit is not None:
        bindings = _deal(bindings, parts, "unit")
        many = bindings.groupBy("unit").agg(F.count("*").alias("bound"))
        saturated = many.where(F.col("bound") > limit).select("unit", F.lit(True).alias("saturated"))
        bindings = bindings.join(many.where(F.col("bound") <= limit).select("unit"), "unit", "left_semi")
    # The innermost scope around each binding: that mark of the sequence which is still open.
    columns = marks.select("unit", "pos", "mark")
    placed = columns.select("unit", (F.col("pos") * 2 + 1).alias("pos"), "mark", F.lit(None).cast("struct<name:string,path:string>").alias("_b"))
    both = placed.unionByName(bindings.select("unit", (F.col("pos") * 2).alias("pos"), F.lit(0).alias("mark"), F.struct("name", "path").alias("_b")))
    here = holders(levels(both, "unit", parts), "unit", []).where("_b is not null")
    here = here.select("unit", F.expr("pos div 2").alias("at"), F.coalesce(F.expr("(holder.pos - 1) div 2"), F.lit(UNIT)).cast("bigint").alias("start"), "_b.name", "_b.path")
    bound = here.groupBy("unit", "start", "name").agg(F.max_by(F.struct("path"), "at").alias("b")).select("unit", "start", F.coalesce("name", F.lit("*")).alias("key"), F.col("b.path").alias("path"))
    known = _deal(bound, parts, "unit", "start").join(_deal(scoped.select("unit", "start", "stop", "inside"), parts, "unit", "start"), ["unit", "start"])
    asked = within(uses, marks, parts).withColumn("key", F.explode(F.array(F.col("name"), F.lit("*"))))
    own = [c for c in asked.columns if c not in ("unit", "key", "inside")]
    # The scopes of one module that bind one key lie in or beside one another: that which is still open at a use is the innermost around it.
    same = ["unit", "inside", "key"]
    at = lambda place, after: (F.col(place).cast("bigint") * 3 + after).alias("pos")
    probe = asked.select(*same, at("pos", 1), F.lit(0).alias("mark"), F.lit(None).cast("string").alias("path"), F.struct(*own).alias("_use"))
    none = F.lit(None).cast(probe.schema["_use"].dataType).alias("_use")
    bounds = known.withColumn("bound", F.explode(F.array(F.struct(at("start", 2), F.lit(1).alias("mark")), F.when(F.col("stop") < END, F.struct(at("stop", 0), F.lit(-1).alias("mark")))))).where("bound is not null")
    every = probe.unionByName(bounds.select(*same, "bound.pos", "bound.mark", "path", none))
    met = holders(levels(every, same, parts), same, ["path"]).where("_use is not null")
    # Of a name and all names that decides whose scope begins last; in one scope a name goes before all names.
    nearest = F.max(F.when(F.col("holder").isNotNull(), F.struct(F.col("holder.pos").alias("start"), (F.col("key") != "*").alias("named"), F.col("holder.path").alias("path")))).alias("b")
    found = met.select("unit", "_use.*", "key", "holder").groupBy("unit", *own).agg(nearest)
    item = F.col("b.named") & F.col("b.path").isNotNull()
    verdict = F.when(F.col("b").isNull(), "unbound").when(item, "item").otherwise("indeterminate")
    if limit is not None:
        found = _deal(found, parts, "unit").join(saturated, "unit", "left")
        verdict = F.when(F.col("saturated"), "indeterminate").otherwise(verdict)
    return found.select("unit", *own, verdict.alias("verdict"), F.when(verdict == "item", F.col("b.path")).alias("path"))


def called(resolved: DataFrame, crates: DataFrame, parts: int | None = None) -> DataFrame:
    """With ``crate`` and ``item``: what a written call names once its first name is resolved; null where it can't be told.

    ``rest`` is what is written behind the name, with its member last; ``crates``
    (unit, alias, crate) are each unit's dependencies by the name that its code uses.
    """
    first = F.when(F.col("verdict") == "item", F.col("path")).when(F.col("verdict") == "unbound", F.col("name"))
    full = F.concat_ws("::", first, F.nullif("rest", F.lit("")))
    root = F.when(first.isNotNull(), F.substring_index(full, "::", 1))
    rows = resolved.withColumns({"_root": root, "_item": F.when(first.isNotNull(), F.substr(full, F.length(root) + 3))})
    named = crates.select("unit", F.col("alias").alias("_root"), "crate")
    held = _deal(rows, parts, "unit", "_root").join(_deal(named, parts, "unit", "_root"), ["unit", "_root"], "left")
    return held.withColumn("crate", F.when(F.col("_root").isin(*SYSROOT), F.col("_root")).otherwise(F.col("crate"))).withColumnRenamed("_item", "item").drop("_root")


def dynamic_payload(payload: Column) -> Column:
    """Whether a written argument puts a value into a text: format! with a field, or + with something that isn't a literal."""
    bare = F.regexp_replace(F.regexp_replace(payload, r"^[&(\s]+", ""), r"[)\s]+$", "")
    fields = F.regexp_replace(F.regexp_extract(bare, r'^format!\s*[(\[{]\s*"([^"]*)"', 1), r"\{\{", "").contains("{")
    operands = F.filter(F.split(F.regexp_replace(bare, '"[^"]*"', '""'), r"\s*\+\s*"), lambda x: ~x.rlike(r'^(""|[0-9][0-9_.]*|true|false)$'))
    added = ~bare.startswith("format!") & bare.contains("+") & (F.size(operands) > 0)
    return F.coalesce(fields | added, F.lit(False))


def detect(calls: DataFrame) -> DataFrame:
    """(unit, pos, rule, message) of the two rules over calls as ``called`` gives them.

    They have method and argument (the last call of the chain and what it is given),
    shell and flag (the first argument of the command and the one before the last) and
    test (whether the place is test material, where disabled verification is meant).
    """
    tls = (F.col("crate") == "reqwest") & F.col("item").isin(*[f"{c}::builder" for c in TLS_CLIENTS]) & (F.col("argument") == "true") & ~F.col("test")
    command = (F.col("crate") == "std") & (F.col("item") == f"{COMMAND}::new") & (F.col("method") == "arg") & (F.col("flag") == "-c") & F.col("shell").isin(*SHELLS)
    rule = (
        F.when(tls & F.col("method").isin(*CERTIFICATES), F.struct(F.lit("disabled_tls_verification").alias("rule"), F.lit("certificates").alias("message")))
        .when(tls & F.col("method").isin(*HOST_NAMES), F.struct(F.lit("disabled_tls_verification").alias("rule"), F.lit("host names").alias("message")))
        .when(command & dynamic_payload(F.col("argument")), F.struct(F.lit("dynamic_shell").alias("rule"), F.lit("interpolated command").alias("message")))
    )
    return calls.withColumn("_found", rule).where("_found is not null").select("unit", "pos", "_found.rule", "_found.message")
