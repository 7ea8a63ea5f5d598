"""Text expressions on columns, all of them in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential shapes, each a prefix and a least tail, in their order of precedence.
CREDENTIALS = (
    ("aws_access_key", r"AKIA[A-Z0-9]{16}"),
    ("github_token", r"ghp_[A-Za-z0-9]{36}"),
    ("github_pat", r"github_pat_[A-Za-z0-9_]{22}"),
    ("secret_key", r"sk-[A-Za-z0-9_-]{20}"),
    ("chat_token", r"xoxb-[A-Za-z0-9-]{10}"),
)
KEY_BEGIN, PRIVATE_KEY = "-----BEGIN ", r"^[A-Z ]*PRIVATE KEY-----"
PROOF_BYTES = 65_536
TEST_FOLDERS = ("tests", "fixtures", "testdata")
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
GENERATED = r"@generated|DO NOT EDIT|Automatically generated|automatically generated"
# End of the fixed values.


def lines_of(text: Column) -> Column:
    """Number of lines: an end at the end of the text adds none; none in an empty or null one."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((t == "") | t.endswith("\n"), 0).otherwise(1)).cast("bigint")


def credential(line: Column) -> Column:
    """Name of the first credential shape in a line, the key block first; null if none."""
    found = F.when(line.contains(KEY_BEGIN) & F.try_element_at(F.split(line, KEY_BEGIN, 2), F.lit(2)).rlike(PRIVATE_KEY), "private_key")
    for name, pattern in CREDENTIALS:
        # The prefix is looked for first, as patterns are tried at every character.
        found = found.when(line.contains(_prefix(pattern)) & line.rlike(f"(^|[^A-Za-z0-9_]){pattern}"), name)
    return found


def _prefix(pattern: str) -> str:
    return pattern.split("[")[0]


def may_hold_credential(text: Column) -> Column:
    """Whether a text holds the literal begin of any shape; a line without one has no credential."""
    return reduce(or_, [text.contains(p) for p in (KEY_BEGIN, *(_prefix(pattern) for _, pattern in CREDENTIALS))])


def major(version: Column) -> Column:
    """The major number of a version; null where it has none."""
    return F.nullif(F.regexp_extract(version, r"^([0-9]+)([.+-].*)?$", 1), F.lit(""))


def context_of_path(path: Column) -> Column:
    """tests, benches or examples from the outermost such folder, else tests for a file tests.rs; null else."""
    parts = F.split(path, "/")
    folder = F.try_element_at(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin("tests", "benches", "examples")), F.lit(1))
    return F.coalesce(folder, F.when(F.element_at(parts, -1) == "tests.rs", "tests"))


def test_material(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*TEST_FOLDERS))


def secret_file_name(name: Column) -> Column:
    return (name == ".env") | (name.startswith(".env.") & ~name.isin(".env.example", ".env.template", ".env.sample")) | name.rlike(r"\.(pem|key)$") | name.isin("id_rsa", "credentials.json")


def generated(text: Column) -> Column:
    """Whether one of the first ten lines says that the text is generated."""
    return F.exists(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 10), lambda line: line.rlike(GENERATED))


def unbounded_registry(source: Column, requirement: Column, path: Column) -> Column:
    """A dependency on a registry, not on a path, with any version."""
    return path.isNull() & F.coalesce(source.startswith("registry+"), F.lit(False)) & (requirement == "*")


def unpinned_git(source: Column, path: Column) -> Column:
    """A git source, not a path, without exactly one parameter, a full revision."""
    return path.isNull() & F.coalesce(source.startswith("git+"), F.lit(False)) & ~source.rlike(r"^[^?]*\?rev=[0-9A-Fa-f]{40}(#.*)?$")


def leaves(root: Column, path: Column) -> Column:
    return path.isNotNull() & (path != root) & ~path.startswith(F.concat(root, F.lit("/")))


def rule_title(rule: Column) -> Column:
    """'structure::oversized_unit' to 'Oversized unit'."""
    name = F.translate(F.element_at(F.split(rule, "::"), -1), "_-", "  ")
    return F.when(name == "", rule).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2))))


def plain(text: Column) -> Column:
    """Without terminal escapes and control characters."""
    return F.regexp_replace(F.regexp_replace(text, "\\x1B\\[[0-?]*[ -/]*[@-~]", ""), "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")


def mentions(text: Column, name: Column) -> Column:
    """Whether an identifier occurs with no identifier character beside it."""
    return F.regexp_like(text, F.concat(F.lit("(^|[^A-Za-z0-9_-])\\Q"), name, F.lit("\\E($|[^A-Za-z0-9_-])")))


def proof(text: Column, start: Column, length: Column) -> Column:
    """The text under a span as ``proof_words`` gives it."""
    return proof_words(F.substr(text, start, length))


def words_only(text: Column) -> Column:
    """Words with one blank between them; null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(text, f"[{WHITE}]+", " ")), F.lit(""))


def proof_words(raw: Column) -> Column:
    """What a span shows as words; null if that is nothing, or if the span itself is longer than a proof may be."""
    return F.when(F.octet_length(raw) <= PROOF_BYTES, words_only(raw))


def first_bytes(line: Column, most: int) -> Column:
    """A line cut to so many bytes, back to the end of a character."""
    raw = F.encode(line, "UTF-8")
    goes_on = lambda end: F.hex(F.substring(raw, end + 1, 1)).between("80", "BF")
    end = F.lit(most - 3)
    for k in (most - 2, most - 1, most):
        end = F.when(~goes_on(k), k).otherwise(end)
    return F.when(F.octet_length(line) <= most, line).otherwise(F.decode(F.substr(raw, F.lit(1), end), "UTF-8"))


def dep_info(text: Column) -> Column:
    """Paths of the first rule of a dep-info file; null if it has no rule or ends in an open escape.

    The rule's list begins at the first colon before white space and ends at the first
    line break without a backslash. A backslash stands before a blank, a tab, #, : or
    another one, continues a line, and else is itself.
    """
    behind = F.regexp_extract(text, r"(?s)^.*?:(?=\s)(.*)$", 1)
    body = F.regexp_extract(behind, r"^(?:[^\\\n\r]|\\\r\n|\\[\n \t#:\\]|\\(?=[^\n \t#:\\]))*+", 0)
    open_end = (F.length(body) + 1 == F.length(behind)) & behind.endswith("\\")
    units = F.regexp_extract_all(body, F.lit(r"(?:\\\r?\n|\\[ \t#:\\]|\\|[^\\\s])++"), F.lit(0))
    paths = F.transform(units, lambda u: F.regexp_replace(u, r"\\(?:\r?\n|([ \t#:\\]))", "$1"))
    return F.when(text.rlike(r":\s") & ~open_end, F.filter(paths, lambda p: p != ""))


def valid_rule(selector: Column) -> Column:
    return selector.rlike("^[a-z0-9_:]{1,128}$")


def valid_category(selector: Column) -> Column:
    return selector.rlike("^[a-z]{1,32}$")


def valid_base(ref: Column) -> Column:
    """A full digest, or a plain branch or tag name."""
    name = r"(?![.])(?!.*\.(/|$))(?!.*\.lock(/|$))[A-Za-z0-9_.][A-Za-z0-9_.-]*(/(?![.])[A-Za-z0-9_.-]+)*"
    return ref.rlike("^([0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$") | ((F.length(ref) <= 255) & ~ref.contains("..") & ref.rlike(f"^{name}$"))


def _percent(text: Column, kept: str) -> Column:
    """Each character that isn't of the class ``kept`` as the %XX of its bytes."""
    coded = lambda c: F.when(c.rlike(f"^{kept}$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), coded), ""))


def encode_path(path: Column) -> Column:
    """A relative path with % and control characters percent-encoded; null for an empty, absolute or leaving one."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    good = (F.size(parts) > 0) & ~path.startswith("/") & ~F.array_contains(parts, "..")
    return F.when(good, _percent(F.array_join(parts, "/"), r"[^%\p{Cc}]"))


def encode_component(text: Column) -> Column:
    """RFC 3986 percent-encoding: only unreserved characters stay."""
    return _percent(text, r"[A-Za-z0-9._~-]")


def iso_date(text: Column) -> Column:
    """Whether a text has the shape of a date: four digits, two and two."""
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def byte_offset(text: Column, line: Column, column: Column) -> Column:
    """Bytes before a position (line and column from 1, columns in characters).

    A line owns its end, so the column of the line end is the last one; in the last
    line so is the one past its last character. Null where the text doesn't reach.
    """
    lines = F.split(text, "\n")
    here = F.try_element_at(lines, line.cast("int"))
    before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(line - 1, F.lit(0)).cast("int")), F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x) + 1)
    return F.when((line >= 1) & (column >= 1) & (column <= F.length(here) + 1), before + F.octet_length(F.substr(here, F.lit(1), (column - 1).cast("int"))))
