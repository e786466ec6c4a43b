"""File path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import fixed_values as fv


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def suffix(name: Column) -> Column:
    """Last extension with its dot; a leading dot alone does not start one."""
    return F.regexp_extract(name, "(?s)^.+(\\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def is_placeholder(name: Column) -> Column:
    return name.startswith(".") & name.endswith(".icloud")


def real_name(name: Column) -> Column:
    inner = F.substring(name, F.lit(2), F.greatest(F.length(name) - 8, F.lit(0)))
    return F.when(is_placeholder(name), inner).otherwise(name)


def extension(name: Column) -> Column:
    """Lower-case extension of the file a name stands for, placeholders resolved."""
    return F.lower(suffix(real_name(name)))


def real_path(path: Column) -> Column:
    return F.concat(parent(path), F.lit("/"), real_name(base_name(path)))


def sync_status(name: Column) -> Column:
    return F.when(is_placeholder(name), "placeholder").otherwise("local")


def _hidden(part: Column) -> Column:
    return part.startswith(".") & ~part.endswith(".icloud")


def _skipped_file(name: Column) -> Column:
    return (
        name.isin(fv.SYSTEM_FILES) | _hidden(name) | F.lower(suffix(name)).isin(fv.SKIP_EXTENSIONS)
    )


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def keep(path: Column, mode: str = "scan", root: Column | str | None = None) -> Column:
    """True for a path that is indexed.

    ``scan``: every folder below ``root`` is tested as a traversal would;
    ``any_part``: the rule of the change watcher, folders anywhere in the path;
    ``legacy``: any hidden part or listed folder anywhere drops the path.
    """
    if mode == "legacy":
        parts = F.split(path, "/")
        hidden = F.exists(parts, lambda p: p.startswith("."))
        return ~(hidden | F.arrays_overlap(parts, _words(fv.LEGACY_SKIP_DIRS)))
    name = base_name(path)
    if mode == "any_part":
        return ~(_skipped_file(name) | F.arrays_overlap(F.split(path, "/"), _words(fv.SKIP_DIRS)))
    if mode != "scan":
        raise ValueError(f"unknown mode {mode!r}")
    below = path
    if root is not None:
        root = F.lit(root) if isinstance(root, str) else root
        below = F.substring(path, F.length(root) + 1, F.length(path))
    parts = F.split(below, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    pruned = F.exists(folders, lambda p: _hidden(p) | p.isin(fv.SKIP_DIRS))
    return ~(pruned | _skipped_file(name))


def type_description(ext: Column) -> Column:
    ext = F.lower(ext)
    table = F.create_map(*[F.lit(x) for pair in fv.TYPE_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.ltrim(ext, F.lit(".")))


def relative_folder(path: Column, home: str) -> Column:
    """Folder of a path, relative to ``home`` where it lies below it."""
    folder = parent(path)
    home = home.rstrip("/")
    return (
        F.when(folder == home, ".")
        .when(folder.startswith(home + "/"), F.substring(folder, F.lit(len(home) + 2), F.length(folder)))
        .otherwise(folder)
    )


def cloud_root(home: str) -> str:
    return home.rstrip("/") + "/Library/Mobile Documents/com~apple~CloudDocs"


def classify_source(path: Column, home: str) -> Column:
    return (
        F.when(path.startswith(cloud_root(home) + "/"), "icloud")
        .when(path.startswith(home.rstrip("/") + "/Documents/"), "documents")
        .otherwise("desktop")
    )
