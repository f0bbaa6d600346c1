"""Path predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import dims
from fleetlens.functions.text import lookup, rx


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix_of(path: Column) -> Column:
    """``Path.suffix``: the last dot, not leading and not final."""
    return F.regexp_extract(name_of(path), r"(?s)\A.+(\.[^.]+)\z", 1)


def stem_of(path: Column) -> Column:
    """``Path.stem``."""
    return F.regexp_replace(name_of(path), r"(?s)\A(.+)\.[^.]+\z", "$1")


def folder_of(path: Column) -> Column:
    """Parent folder with its final slash, empty at the root."""
    return F.substr(path, F.lit(1), F.length(path) - F.length(name_of(path)))


def depth_of(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


BELOW = "(^|/)"


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern for all; those that begin at a folder or name share that beginning, so a place in a path is tried once and not once for each."""
    below = [p.removeprefix(BELOW) for p in patterns if p.startswith(BELOW)]
    rest = [p for p in patterns if not p.startswith(BELOW)]
    return "|".join(([f"(?:^|/)(?:{'|'.join(below)})"] if below else []) + rest)


def path_excluded(path: Column, ignore: Column | None = None) -> Column:
    """Unmistakably third party, or at/below one of the configured paths (array column)."""
    excluded = path.rlike(rx(any_of(dims.EXCLUDED_PATH_PATTERNS), "i"))
    if ignore is None:
        return excluded
    configured = F.exists(ignore, lambda p: (path == p) | F.startswith(path, F.concat(p, F.lit("/"))))
    return excluded | F.coalesce(configured, F.lit(False))


def path_third_party(path: Column) -> Column:
    return path.rlike(rx(any_of(dims.THIRD_PARTY_PATTERNS), "i"))


def in_ignored_folder(path: Column) -> Column:
    """Any folder component of the path is one the scan never enters."""
    names = "|".join(r"\Q" + n + r"\E" for n in dims.IGNORED_DIRS)
    return path.rlike(rf"(?:^|/)(?:{names})/")


def language_of(ext: Column) -> Column:
    return F.coalesce(lookup(dims.LANGUAGE_OF_EXTENSION, ext), F.lit("Other"))


def is_text_file(ext: Column, name: Column) -> Column:
    return ext.isin(*dims.TEXT_EXTENSIONS) | name.isin(*dims.IMPORTANT_FILES)


def test_path(path: Column) -> Column:
    return path.rlike(rx(dims.TEST_PATH, "i"))


def protected_path(path: Column) -> Column:
    return path.rlike(rx(any_of(dims.PROTECTED_PATHS), "i"))


def entry_point(content: Column) -> Column:
    return content.rlike(rx("|".join(dims.ENTRY_POINTS), "m"))


def gitignore_anchored(path: Column, patterns: Column) -> Column:
    """Covered by a pattern with a leading slash; unanchored patterns do not count."""
    def covers(pattern: Column) -> Column:
        bare = F.regexp_replace(pattern, r"\A/+|/+\z", "")
        below = F.startswith(path, F.concat(bare, F.lit("/")))
        return F.startswith(pattern, F.lit("/")) & ((path == bare) | below)

    return F.coalesce(F.exists(patterns, covers), F.lit(False))


def in_scope(name: Column, prefix: str) -> Column:
    return F.startswith(F.lower(name), F.lit(prefix))
