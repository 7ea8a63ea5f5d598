"""Rules of manifests, build settings, attributes and sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines from which a unit of each kind is too large, settings that switch checks off, and what counts as full debug and stripped.
BOUNDS = {"file": 1000, "mod": 500, "impl": 500, "fn": 150}
OFF = ("off", "false", "no", "n", "0")
FULL_DEBUG, STRIPPED = ("true", "2", "full"), ("true", "symbols", "debuginfo")
# End of the fixed values.


def oversized(kind: Column, lines: Column) -> Column:
    """Whether a unit has as many lines as its kind may not reach; other kinds are not judged."""
    most = F.lit(None).cast("int")
    for name, n in BOUNDS.items():
        most = F.when(kind == name, n).otherwise(most)
    return F.coalesce(lines >= most, F.lit(False))


def lock_state(content: Column) -> tuple[Column, Column]:
    """(absent, unusable or packages; the packages as (name, version)) of a lock file's text.

    Every line of one that can be read is blank, a comment, a table, a setting, or a
    member or the end of a list.
    """
    lines = F.split(content, r"\r?\n")
    fine = F.forall(lines, lambda x: x.rlike(r'^\s*(#.*|\[\[?[A-Za-z0-9_.\-]+\]?\]|[A-Za-z0-9_"\-]+ *= *(".*"|[0-9]+|true|false|\[.*)|"[^"]*",?|\],?)?\s*$'))
    state = F.when(content.isNull(), "absent").when(fine, "packages").otherwise("unusable")
    pattern = r'(?m)^\[\[package\]\]\r?\nname *= *"([^"]*)"\r?\nversion *= *"([^"]*)"'
    names, versions = (F.regexp_extract_all(content, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return state, F.when(fine, F.arrays_zip(names.alias("name"), versions.alias("version")))


def unchecked_overflow(binary: Column, overflow_checks: Column) -> Column:
    """A workspace that ships a binary whose release profile doesn't switch overflow checks on."""
    return binary & ~F.coalesce(overflow_checks == "true", F.lit(False))


def debug_symbols(released: Column, debug: Column, strip: Column) -> Column:
    """A release profile with full debug information that is not stripped."""
    return released & F.coalesce(debug.isin(*FULL_DEBUG), F.lit(False)) & ~F.coalesce(strip.isin(*STRIPPED), F.lit(False))


def neutralizing(arguments: Column) -> Column:
    """Flags of an argument list that switch a check off for every build, each in its separated spelling.

    A flag's value follows it or is joined to it. A value starts no flag itself, so
    each argument is judged with the one after it alone.
    """
    off = lambda s: s.rlike(f"^overflow-checks=({'|'.join(OFF)})$")

    def flag(x):
        a, after = x["a"], F.coalesce(x["after"], F.lit(""))
        return (
            F.when((a == "--cap-lints") & (after == "allow") | (a == "--cap-lints=allow"), "--cap-lints allow")
            .when(a.isin("-A", "--allow") & (after == "warnings") | a.isin("-Awarnings", "--allow=warnings"), "-A warnings")
            .when(a.isin("-C", "--codegen") & off(after) | off(F.regexp_replace(a, "^(-C|--codegen=)", "")) & a.rlike("^(-C|--codegen=)."), "-C overflow-checks=off")
        )

    beside = F.arrays_zip(arguments.alias("a"), F.slice(arguments, F.lit(2), F.size(arguments)).alias("after"))
    return F.filter(F.transform(beside, flag), lambda f: f.isNotNull())


def lints_of(arguments: Column) -> Column:
    """The lints among an attribute's arguments (as ``split_arguments`` gives them), each once and in order."""
    return F.array_sort(F.array_distinct(F.filter(arguments, lambda a: ~a.startswith('reason="'))))


def unreasoned(arguments: Column) -> Column:
    """An attribute that allows lints without a reason."""
    return (F.size(lints_of(arguments)) > 0) & ~F.exists(arguments, lambda a: a.startswith('reason="'))


def crate_level(inner: Column, place: Column, arguments: Column) -> Column:
    """An inner attribute that allows lints for a whole file or module, with or without a reason."""
    return inner & place.isin("file", "module") & (F.size(lints_of(arguments)) > 0)
