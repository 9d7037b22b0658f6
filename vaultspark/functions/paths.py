"""Logical names and paths as column expressions: validation, cleaning, components, globs, prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that no component may have before its first dot.
DEVICES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]

#: The default ignore patterns. The last three name the store itself.
DEFAULT_IGNORES = [
    "~$*", "*.tmp", "*.temp", "*.crdownload", "Thumbs.db", "desktop.ini", ".DS_Store", "*.swp", "*.swo",
    ".git", ".git/**", "node_modules", "node_modules/**", "target", "target/**", ".vault", ".vault/**", ".vaultignore",
]

MAX_NAME_BYTES = 65_535


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def components(path: Column | str) -> Column:
    """Non-empty components, split at ``/`` and ``\\``."""
    return F.filter(F.split(_col(path), r"[/\\]"), lambda c: c != "")


def name_error(name: Column | str) -> Column:
    """Null for a valid logical name, else why it is not; the first rule that fails is told."""
    n = F.trim(_col(name))
    parts = F.split(n, "/")
    device = F.exists(parts, lambda c: F.upper(F.substring_index(c, ".", 1)).isin(DEVICES))
    normal = F.exists(parts, lambda c: ~c.isin("", "."))
    return (
        F.when(_col(name).isNull() | (n == ""), "empty")
        .when(n.isin(".", ".."), "dot")
        .when(n.rlike(r"[\x00\r\n:]"), "character")
        .when(F.octet_length(n) > MAX_NAME_BYTES, "too long")
        .when(F.exists(parts, lambda c: c == ".."), "parent")
        .when(F.startswith(n, F.lit("/")), "absolute")
        .when(device, "device")
        .when(~normal, "no component")
    )


def sanitize(path: Column | str) -> Column:
    """Only the normal components of a path, joined with ``/``."""
    return F.array_join(F.filter(F.split(_col(path), "/"), lambda c: ~c.isin("", ".", "..")), "/")


def safe_restore_dir(path: Column | str) -> Column:
    """True for a relative folder without ``..`` that has a component."""
    p = _col(path)
    return ~F.startswith(p, F.lit("/")) & ~F.exists(F.split(p, "/"), lambda c: c == "..") & (sanitize(p) != "")


def normalize(path: Column | str) -> Column:
    """A path with ``.`` and ``..`` taken lexically; ``..`` at the root stays there."""
    step = lambda acc, c: F.when(c == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(c == ".", acc).otherwise(F.array_append(acc, c))
    return F.array_join(F.aggregate(components(path), F.array().cast("array<string>"), step), "/")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent(path: Column | str) -> Column:
    p = _col(path)
    at = F.length(p) - F.length(basename(p)) - 1
    return F.when(at > 0, F.substr(p, F.lit(1), at)).otherwise("")


def extension(path: Column | str) -> Column:
    """Lower-cased text after the last dot of the basename; empty without one."""
    b = basename(path)
    return F.when(F.contains(b, F.lit(".")), F.lower(F.substring_index(b, ".", -1))).otherwise("")


def under(name: Column | str, prefix: str) -> Column:
    """``name`` is ``prefix`` or lies below it: a prefix of whole components."""
    n = _col(name)
    return (n == prefix) | F.startswith(n, F.lit(prefix + "/"))


def moved(name: Column | str, old: str, new: str) -> Column:
    """The name after ``old`` became ``new``, for names :func:`under` ``old``."""
    return F.concat(F.lit(new), F.substr(_col(name), F.lit(len(old) + 1)))


def in_folder(name: Column | str, folder: str) -> Column:
    """Inside a shared folder, given with or without slashes and with either kind of them."""
    return F.startswith(_col(name), F.lit(folder.replace("\\", "/").strip("/") + "/"))


def parse_ignore_lines(lines: list[str], defaults: list[str] | None = None) -> list[str]:
    """Patterns from an ignore file: defaults first; a folder or a pattern without a dot covers what is below it too."""
    out = list(DEFAULT_IGNORES if defaults is None else defaults)
    for raw in lines:
        line = raw.strip().replace("\\", "/")
        if not line or line.startswith("#"):
            continue
        stem = line.rstrip("/")
        out.append(stem)
        if line.endswith("/") or "." not in stem:
            out += [f"{stem}/**", f"**/{stem}/**"]
    return [p for p in out if glob_regex(p) is not None]


def glob_regex(pattern: str) -> str | None:
    """A glob as an anchored regex: ``*`` and ``?`` cross ``/``; ``**`` must be a whole component; null if malformed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            whole = (i == 0 or pattern[i - 1] == "/") and (i + 2 == len(pattern) or pattern[i + 2] == "/")
            if not whole:
                return None
            last = i + 2 == len(pattern)
            out += ".*" if last else "(?:.*/)?"
            i += 2 if last else 3
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            body = "^" + body[1:] if body[0] == "!" else body
            out += "[" + body.replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def ignored(path: Column | str, patterns: list[str] | None = None) -> Column:
    """A pattern matches the basename, the whole relative path, or any component."""
    one = "|".join(r for p in (DEFAULT_IGNORES if patterns is None else patterns) if (r := glob_regex(p)))
    p = _col(path)
    return p.rlike(one) | F.exists(F.split(p, "/"), lambda c: c.rlike(one))


def overlaps(a: Column | str, b: Column | str) -> Column:
    """Whether two folders are the same or one lies in the other, compared by whole components."""
    x, y = (F.concat(F.array_join(components(c), "/"), F.lit("/")) for c in (a, b))
    return F.startswith(x, y) | F.startswith(y, x)


def found(name: Column | str, asked: str) -> Column:
    """Whether a name has what was asked for, in any case of letters; nothing asked finds all."""
    n = F.col(name) if isinstance(name, str) else name
    return F.contains(F.lower(n), F.lower(F.lit(asked.strip())))
