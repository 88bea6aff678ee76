"""Column functions over text: folding, tokens, globs, excerpts, redaction, hashes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters whose canonical decomposition is a letter and marks, and those letters."""
    source, target = "", ""
    for code in [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if c.lower() == c and len(base) > 1 and base[0].isascii():
            source, target = source + c, target + base[0]
    return source, target


_FROM, _TO = _folds()


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(c), _FROM, _TO)


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def fold_text(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(ch))


def token_list(s: str) -> list[str]:
    """The driver's twin of ``tokens``, for queries."""
    return [t for t in re.split(r"[^\w]|_", fold_text(s)) if t]


def glob_regex(glob: str) -> str:
    """``**/`` any folders or none, ``**`` anything, ``*`` within a segment, ``?`` one character."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(p, "".join("\\" + ch if ch in r".^$+{}[]|()\-&~#" else ch for ch in p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", glob)) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def ignored(path: Column, globs: list[str]) -> Column:
    return (path == ".git") | path.startswith(".git/") | matches_any(path, globs)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_env(path: Column) -> Column:
    b = F.lower(basename(path))
    return b.isin(".env", ".envrc") | b.startswith(".env.") | b.endswith(".env") | b.contains(".env.")


def kind(path: Column) -> Column:
    return F.when(is_env(path), "env").when(extension(path) == "", "text").otherwise(extension(path))


def skip_reason(path: Column, size: Column, regular: Column, content: Column, most: int = model.MAX_FILE_BYTES) -> Column:
    """Why a file is left out, in the order of the checks; null if it is not.  ``content`` is binary."""
    return (
        F.when(~regular, "non-regular")
        .when(size > most, "file-too-large")
        .when(extension(path).isin(model.SECRET_EXTENSIONS), "secret-material")
        .when(F.contains(content, F.lit(b"\0")) | ~F.is_valid_utf8(content.cast("string")), "non-text")
    )


ASSIGNMENT = r"^(\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*[=:]).*$"


def redact_env(content: Column) -> Column:
    """Assignments keep their names only, other lines become empty; the number of lines stays."""
    return F.array_join(F.transform(F.split(content, "\n", -1), lambda line: F.when(line.rlike(ASSIGNMENT), F.concat(F.rtrim(F.regexp_extract(line, ASSIGNMENT, 1)), F.lit("<redacted>"))).otherwise(F.lit(""))), "\n")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def excerpt(c: Column, limit: int) -> Column:
    t = strip(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(strip(F.substring(t, 1, limit)), F.lit("…")))


def excerpt_limit(results: int) -> int:
    return max(model.EXCERPT_MIN, min(model.EXCERPT_MAX, model.EXCERPT_SHARED // max(1, results)))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def input_hash(title: Column, text: Column) -> Column:
    return content_hash(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), text))


def input_text(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.concat(title, F.lit("\n"), text))


def flag(metadata: Column, name: str, default: bool) -> Column:
    """A boolean of a JSON object; the default where it is absent or null."""
    v = F.get_json_object(metadata, f"$.{name}")
    return F.coalesce(F.when(v.isin("false", "0"), F.lit(False)).when(v.isNotNull(), F.lit(True)), F.lit(default))


def in_scope(path: Column, scope: str) -> Column:
    """Raw prefix, as index lanes take it."""
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope)


def in_segment_scope(path: Column, scope: str) -> Column:
    """Whole segments, as graph and live scans take it."""
    scope = scope.rstrip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def path_root(path: Column) -> Column:
    return F.when(path.contains("/"), F.split(path, "/")[0]).otherwise(F.lit("."))


def quote(literal: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch in " _") and ch.isascii() else ch for ch in literal)


def has_identifier(c: Column, literal: str) -> Column:
    """The literal stands with no identifier character on either side."""
    edge = r"[\p{L}\p{N}\p{M}_$]"
    return c.rlike(f"(?<!{edge}){quote(literal)}(?!{edge})")


def camel_spaced(c: Column) -> Column:
    """The text with spaces between the parts of its identifiers: before an upper-case letter that a lower-case one precedes or follows."""
    return F.regexp_replace(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"([\p{L}\p{N}])(\p{Lu}\p{Ll})", "$1 $2")


def byte_cut(c: Column, most: int) -> Column:
    """The longest start of a text in at most ``most`` bytes of UTF-8, cut between characters."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, most)
    whole = F.regexp_replace(F.hex(cut), "^((?:..)*?)(?:[CDEF].(?:[89AB].){0,2})?$", "$1")
    last = F.regexp_extract(F.hex(F.substring(F.encode(c, "UTF-8"), most + 1, 1)), "^[89AB]", 0)  # the next byte goes on with a character
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.when(last == "", cut).otherwise(F.unhex(whole)), "UTF-8"))


def identifier_words(c: Column) -> Column:
    """Words of an identifier: split at _, - and case boundaries, lower case, joined by spaces."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return strip(F.regexp_replace(F.lower(F.regexp_replace(spaced, "[_-]+", " ")), " +", " "))


def java_regex(pattern: str) -> str:
    """A pattern of the linear-time dialect for Java's engine; what that dialect lacks is refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<", pattern):
        raise ValueError("lookaround and back references are not supported")
    return pattern.replace("(?P<", "(?<")
