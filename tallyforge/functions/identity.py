"""Identities of findings: digests of what they say and, for some, of where they are.

The digest is SHA-256 (the engine has no other strong one); tuples are written as
JSON, so that no two of them read the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the domain of the families of one algorithm.
FAMILY_DOMAIN = "tallyforge-family-v1"
# End of the fixed value.


def _items(*columns: Column) -> Column:
    """The columns as the inside of a JSON list; null stands for itself."""
    listed = F.to_json(F.array(*[c.cast("string") for c in columns]))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def span_json(line_start: Column, column_start: Column, line_end: Column, column_end: Column) -> Column:
    """A span as JSON; null where there is none."""
    parts = zip(("line_start", "column_start", "line_end", "column_end"), (line_start, column_start, line_end, column_end), strict=True)
    text = F.concat(F.lit("{"), *[x for i, (k, c) in enumerate(parts) for x in (F.lit(("," if i else "") + f'"{k}":'), c.cast("string"))], F.lit("}"))
    return F.coalesce(text, F.lit("null"))


def positional(source: Column, code: Column, path: Column, span: Column, severity: Column, message: Column) -> Column:
    """A finding at a place: by source, code, path, span (as ``span_json`` writes it), severity before policy, and message."""
    return F.sha2(F.concat(F.lit("["), _items(source, code, path), F.lit(","), span, F.lit(","), _items(severity, message), F.lit("]")), 256)


def of_manifest(source: Column, code: Column, path: Column, severity: Column, message: Column) -> Column:
    """A finding of a manifest or a repository: like a place's, without the span."""
    return positional(source, code, path, F.lit("null"), severity, message)


def structural(source: Column, code: Column, severity: Column, structure: Column) -> Column:
    """A structural finding: by what it is and not by any path, as its members move."""
    return F.sha2(F.concat(F.lit("["), _items(source, code), F.lit(",null,"), _items(structure, severity), F.lit("]")), 256)


def family(rule: Column, key: Column) -> Column:
    """A family's structure: its rule and normalised key, each after its length in bytes (eight, little-endian)."""

    def field(text):
        n = F.octet_length(text)
        low = [F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]
        return F.concat(F.unhex(F.concat(*low, F.lit("0" * 8))), F.encode(text, "UTF-8"))

    return F.sha2(F.concat(*map(field, (F.lit(FAMILY_DOMAIN), rule, key))), 256)
