"""Search filters on files: type group, location, age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import fixed_values as fv

# ---------------------------------------------------------------- fixed values
TYPE_GROUPS = {
    "pdf": [".pdf"],
    "image": fv.IMAGE_EXTENSIONS,
    "document": [".txt", ".md", ".doc", ".docx", ".rtf"],
    "code": [".py", ".js", ".ts", ".json", ".html", ".css"],
    "video": [".mp4", ".mov", ".avi", ".mkv"],
    "audio": [".mp3", ".wav", ".flac"],
    "archive": [".zip", ".tar", ".gz", ".rar", ".7z"],
}
LOCATION_FOLDERS = {
    "documents": "Documents", "downloads": "Downloads", "desktop": "Desktop", "photos": "Pictures", "projects": "Projects",
}
RANGE_DAYS = {"today": 1, "week": 7, "month": 30, "year": 365}


def since(date_range: str, now: Column) -> Column | None:
    """Earliest modification time of a named range; null for any time."""
    days = RANGE_DAYS.get(date_range)
    return None if days is None else now - F.expr(f"interval {days} days")


def file_filter(types: list[str] | None = None, location: str | None = None, earliest: Column | None = None) -> Column:
    """Predicate over extension, folder and mtime; reaches the scan as plain comparisons."""
    test = F.lit(True)
    wanted = [ext for name in types or [] for ext in TYPE_GROUPS.get(name, [])]
    if wanted:
        test = test & F.col("extension").isin(wanted)
    folder = LOCATION_FOLDERS.get(location or "")
    if folder:
        test = test & ((F.col("folder") == folder) | F.col("folder").startswith(folder + "/"))
    if earliest is not None:
        test = test & (F.col("mtime") >= earliest)
    return test
