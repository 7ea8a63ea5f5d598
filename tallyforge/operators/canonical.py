"""Canonical forms: texts that differ in names and values alone read the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress, count, filterfalse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least nodes and statements of a form that is compared.
LEAST_NODES, LEAST_STATEMENTS = 30, 3
# End of the fixed values.
TOKEN = r'""|[\p{L}_][\p{L}\p{N}_]*|[0-9]+(?:\.[0-9]+)?|[^\x09-\x0D\x20]'


def tokens(text: Column) -> Column:
    """Quoted texts (each as two quotes), names, numbers and single marks with a blank between them; null for a text with an open quote, which can't be read."""
    odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1
    bare = F.regexp_replace(F.ltrim(text, F.lit("\t\n\v\f\r ")), '"[^"]*"', '""')
    # White space takes no part in a token, so one blank behind each one, in place of what stands there, is all that lies between.
    return F.when(~odd, F.rtrim(F.regexp_replace(bare, rf"({TOKEN})[\x09-\x0D\x20]*", "$1 ")))


#: Tokens of which a task remembers whether they are names, of so many characters at most.
REMEMBERED, SHORT = 200_000, 64
#: The first ordinals; texts with more names are rare.
ORDINALS = [f"${k}" for k in range(20_000)]


class _Names(dict):
    """Whether a token is a name; short ones are remembered, as texts share them."""

    def __missing__(self, t: str) -> bool:
        name = (t[0] == "_" or t[0].isalpha()) and t not in ("true", "false")
        if len(t) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[t] = name
        return name


def _label(t: str) -> str:
    """What a token becomes that is no name."""
    if t in ("true", "false"):
        return "#bool"
    if t[0] == '"':
        return "#str"
    if "0" <= t[0] <= "9":
        return "#float" if "." in t else "#int"
    return t


def _form(listed: list[str], names: _Names) -> str:
    """The tokens relabelled; only what isn't a name takes a step of its own for each distinct token."""
    distinct = dict.fromkeys(listed)  # in the order of their first appearance
    own = list(compress(distinct, map(names.__getitem__, distinct)))
    labels = dict(zip(own, ORDINALS if len(own) <= len(ORDINALS) else (f"${k}" for k in count()), strict=False))
    if len(own) < len(distinct):
        for t in filterfalse(labels.__contains__, distinct):
            labels[t] = _label(t)
    return " ".join(map(labels.__getitem__, listed))


def _reader(digest: bool):
    def read(batches):
        names = _Names()
        for batch in batches:
            made = [], [], []
            for every in batch.column(batch.num_columns - 1).to_pylist():
                if every is None:
                    row = None, None, None
                else:
                    listed = every.split(" ") if every else []
                    behind = bool(listed) and listed[-1] not in (".", ";")
                    form = _form(listed, names)
                    # A stop or semicolon of the form is a token, as numbers have become their kind.
                    row = hashlib.sha256(form.encode()).hexdigest() if digest else form, len(listed), form.count(".") + form.count(";") + behind
                for column, value in zip(made, row, strict=True):
                    column.append(value)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            kinds = zip(made, (pa.string(), pa.int32(), pa.int32()), strict=True)
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in kinds)], names=[*batch.schema.names[:-1], "digest" if digest else "form", "nodes", "statements"])

    return read


def canonical(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """The rows without their text, with ``form`` (the canonical text), ``nodes`` and ``statements``; all null for texts that can't be read.

    With ``digest`` there is the form's SHA-256 in its place, so that the form stays where it is made.

    Names become the ordinal of their first appearance, literals their kind, all else
    stays. A statement ends in a stop or a semicolon; what is left behind the last one
    is a statement too. Spark takes the tokens, a dictionary of each text relabels
    them, so that time follows the length.
    """
    rest = docs.drop(text)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields)
    return docs.select(*rest.columns, tokens(F.col(text)).alias("_tokens")).mapInArrow(_reader(digest), f"{kinds}{'digest' if digest else 'form'} string, nodes int, statements int")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def admitted(forms: DataFrame, nodes: int = LEAST_NODES, statements: int = LEAST_STATEMENTS) -> DataFrame:
    """Forms large enough to be compared."""
    return forms.where((F.col("nodes") >= nodes) & (F.col("statements") >= statements))
