"""Search results rendered to context text, one text per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.ordering import top_k


def _lines(rows: DataFrame, line: Column, order: Column, sep: str, header: str) -> DataFrame:
    """Join at most a handful of ranked rows per query under a header."""
    return rows.groupBy("qid").agg(
        F.concat(
            F.lit(header),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t")))),
                                     lambda s: s["t"]), sep),
        ).alias("context")
    )


def _numbered(body: Column) -> Column:
    return F.concat(F.col("rank").cast("string"), F.lit(". "), body)


def file_list(hits: DataFrame, limit: int = 5) -> DataFrame:
    """Numbered list of files: qid, rank, file_name, file_path."""
    line = _numbered(F.concat(F.lit("**"), F.col("file_name"), F.lit("** - "), F.col("file_path")))
    return _lines(hits.filter(F.col("rank") <= limit), line, F.col("rank"), "\n", "\n\n## File Search Results\n")


def photo_list(hits: DataFrame, limit: int = 5) -> DataFrame:
    """Numbered photos with persons, up to three keywords and the path; ``method`` is named in the header."""
    who = F.when(F.size("persons") > 0, F.concat(F.lit(" ("), F.array_join("persons", ", "), F.lit(")"))).otherwise("")
    what = F.when(
        F.size("keywords") > 0, F.concat(F.lit(" - "), F.array_join(F.slice("keywords", 1, 3), ", "))
    ).otherwise("")
    line = _numbered(
        F.concat(F.lit("**"), F.col("file_name"), F.lit("**"), who, what, F.lit("\n   Path: "), F.col("file_path"))
    )
    body = _lines(hits.filter(F.col("rank") <= limit), line, F.col("rank"), "\n", "")
    methods = hits.groupBy("qid").agg(F.max("method").alias("method"))
    return body.join(methods, "qid").select(
        "qid",
        F.concat(F.lit("\n\n## Photo Search Results ("), "method", F.lit(" search)\n"), "context").alias("context"),
    )


def memory_list(hits: DataFrame, limit: int = 5) -> DataFrame:
    line = F.concat(F.lit("- "), F.col("text"))
    return _lines(hits.filter(F.col("rank") <= limit), line, F.col("rank"), "\n", "\n\n## What I Know About You\n")


def web_list(results: DataFrame) -> DataFrame:
    """Web result rows: qid, rank, title, snippet, link."""
    line = _numbered(
        F.concat(F.lit("**"), "title", F.lit("**\n   "), "snippet", F.lit("\n   Source: "), "link")
    )
    return _lines(results, line, F.col("rank"), "\n\n", "\n\n## Web Search\n")


def best_chunks(hits: DataFrame, per_file: int = 2) -> DataFrame:
    """The best chunks of every (query, file), kept in order of the file's best hit."""
    kept = top_k(hits, ["qid", "file_path"], [F.asc("rank")], per_file, "in_file")
    quoted = F.concat(F.lit("> "), T.strip(F.col("text")))
    return kept.groupBy("qid", "file_path").agg(
        F.min("rank").alias("first_rank"),
        F.max("file_name").alias("file_name"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("o"), quoted.alias("t")))),
                        lambda s: s["t"]),
            "\n\n...\n\n",
        ).alias("content"),
    )


def content_groups(hits: DataFrame) -> DataFrame:
    """Content hits grouped by file: qid, rank, file_path, file_name, text."""
    block = F.concat(
        F.lit("### "), "file_name", F.lit("\n*Path: "), "file_path", F.lit("*\n\n**Relevant content:**\n"),
        "content", F.lit("\n\n"),
    )
    return _lines(best_chunks(hits), block, F.col("first_rank"), "", "\n\n## File Content Results\n")


def combine_sections(parts: DataFrame) -> DataFrame:
    """Context of several sources per query: qid, section, position, success, context; failed parts left out."""
    good = parts.filter("success")
    joined = _lines(good, F.col("context"), F.col("position"), "\n", "")
    every = parts.select("qid").distinct()
    return every.join(joined, "qid", "left").select(
        "qid", F.coalesce("context", F.lit("\n\n## Context\nNo additional context available.")).alias("context")
    )


def first_with_hits(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of the primary source; queries it has no row for take the fallback's rows."""
    rest = fallback.join(primary.select("qid").distinct(), "qid", "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(rest.withColumn("origin", F.lit("fallback")))


def system_report(hosts: DataFrame) -> DataFrame:
    """System information text per host.

    Columns: host, as_of, uptime_hours, cpu struct(percent, cores_physical,
    cores_logical, frequency_mhz), memory struct(total_gb, used_gb,
    available_gb, percent, swap_total_gb, swap_used_gb, swap_percent), disks
    array<struct(mount_point, free_gb, total_gb, percent)>, top_by_ram and
    top_by_cpu array<struct(name, pid, ram_mb, cpu_percent)>, battery
    struct(percent, charging, plugged_in, time_remaining_mins).  Any part may be null.
    """
    def s(name: str) -> Column:
        return F.col(name).cast("string")

    newline = F.lit("\n")
    cpu = F.when(
        F.col("cpu").isNotNull(),
        F.concat(
            F.lit("### CPU\n- **Usage:** "), s("cpu.percent"), F.lit("%\n- **Cores:** "), s("cpu.cores_physical"),
            F.lit(" physical, "), s("cpu.cores_logical"), F.lit(" logical\n"),
            F.when(
                F.coalesce(F.col("cpu.frequency_mhz"), F.lit(0.0)) > 0,
                F.concat(F.lit("- **Frequency:** "), F.format_string("%.0f", F.bround("cpu.frequency_mhz", 0)),
                         F.lit(" MHz\n")),
            ).otherwise(""),
        ),
    )
    memory = F.when(
        F.col("memory").isNotNull(),
        F.concat(
            F.lit("### Memory (RAM)\n- **Total:** "), s("memory.total_gb"), F.lit(" GB\n- **Used:** "),
            s("memory.used_gb"), F.lit(" GB ("), s("memory.percent"), F.lit("%)\n- **Available:** "),
            s("memory.available_gb"), F.lit(" GB\n"),
            F.when(
                F.coalesce(F.col("memory.swap_total_gb"), F.lit(0.0)) > 0,
                F.concat(F.lit("- **Swap:** "), s("memory.swap_used_gb"), F.lit(" / "), s("memory.swap_total_gb"),
                         F.lit(" GB ("), s("memory.swap_percent"), F.lit("%)\n")),
            ).otherwise(""),
        ),
    )
    disks = F.when(
        F.size("disks") > 0,
        F.concat(
            F.lit("### Storage\n"),
            F.array_join(F.transform("disks", lambda d: F.concat(
                F.lit("- **"), d["mount_point"], F.lit(":** "), d["free_gb"].cast("string"), F.lit(" GB free of "),
                d["total_gb"].cast("string"), F.lit(" GB ("), d["percent"].cast("string"), F.lit("% used)\n"),
            )), ""),
        ),
    )

    def processes(column: str, title: str, ram_first: bool) -> Column:
        def line(p: Column) -> Column:
            ram = F.concat(p["ram_mb"].cast("string"), F.lit(" MB RAM"))
            cpu_share = F.concat(p["cpu_percent"].cast("string"), F.lit("% CPU"))
            a, b = (ram, cpu_share) if ram_first else (cpu_share, ram)
            return F.concat(F.lit("- **"), p["name"], F.lit("** (PID "), p["pid"].cast("string"), F.lit("): "),
                            a, F.lit(", "), b, newline)
        return F.when(
            F.size(column) > 0,
            F.concat(F.lit(f"### Top Processes (by {title})\n"),
                     F.array_join(F.transform(F.slice(column, 1, 5), line), "")),
        )

    names_differ = ~same_names("top_by_ram", "top_by_cpu")
    battery_state = (
        F.when(F.col("battery.charging"), "Charging").when(F.col("battery.plugged_in"), "Plugged in")
        .otherwise("On battery")
    )
    battery = F.when(
        F.col("battery").isNotNull(),
        F.concat(
            F.lit("### Battery\n- **Level:** "), s("battery.percent"), F.lit("% ("), battery_state,
            F.when(
                F.coalesce(F.col("battery.time_remaining_mins"), F.lit(0)) > 0,
                F.concat(F.lit(", "), s("battery.time_remaining_mins"), F.lit(" min remaining")),
            ).otherwise(""),
            F.lit(")\n"),
        ),
    )
    uptime = F.when(
        F.coalesce(F.col("uptime_hours"), F.lit(0.0)) > 0,
        F.concat(F.lit("**Uptime:** "), s("uptime_hours"), F.lit(" hours\n")),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("\n## System Information (as of "), F.coalesce(s("as_of"), F.lit("now")), F.lit(")\n")),
        uptime, cpu, memory, disks,
        processes("top_by_ram", "RAM", True),
        F.when(names_differ, processes("top_by_cpu", "CPU", False)),
        battery,
    )
    return hosts.select("host", text.alias("context"))


def same_names(a: str, b: str) -> Column:
    """Two process lists name the same set."""
    names = [F.array_sort(F.array_distinct(F.transform(c, lambda p: p["name"]))) for c in (a, b)]
    return F.coalesce(names[0] == names[1], F.lit(False))
