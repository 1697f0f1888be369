"""Report views (F11): display-rounded values of the summary tables.

Metric tables stay unrounded; these views only format numbers the way the
analysed tool's reports print them -- percentages with two decimals, counts
and line medians with none, averages of file counts with two.  Values are
rounded half-to-even before formatting, so exact ties print as Python prints
them (6.5 -> "6"); a double whose shortest decimal form is a tie but whose
binary value is not (2.675) may still differ in the last digit -- display
only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (section, metric column, label, printf format) of the summaries.
CORPUS_MEDIANS_LINES = (
    ("PAC Maintenance Frequency", "median_pac_maintenance_frequency", "Median freq", "%.2f%%"),
    ("PAC Maintenance Frequency", "median_pac_commits", "Median pac_commits", "%.0f"),
    ("PAC Maintenance Frequency", "median_total_commits", "Median total_commits", "%.0f"),
    ("PAC Maintainer Percentage", "median_pac_maintainer_percentage", "Median pac_maintainer_percentage", "%.2f%%"),
    ("PAC Maintainer Percentage", "median_pac_authors", "Median pac_authors", "%.0f"),
    ("PAC Maintainer Percentage", "median_total_authors", "Median total_authors", "%.0f"),
    ("Median Commit Sizes", "median_pac_commit_size", "Median (PAC commits)", "%.0f"),
    ("Median Commit Sizes", "median_non_pac_commit_size", "Median (non-PAC commits)", "%.0f"),
    ("PAC vs Non-PAC Code Changes", "median_pac_code_changes", "Median PAC code changes (in PAC commits)", "%.0f"),
    ("PAC vs Non-PAC Code Changes", "median_non_pac_code_changes",
     "Median non-PAC code changes (in PAC commits)", "%.0f"),
    ("PAC vs Non-PAC Code Changes", "median_non_pac_only_changes",
     "Median non-PAC code changes (in non-PAC commits)", "%.0f"),
    ("PAC vs Non-PAC Code Changes", "repos_with_pac_changes", "Total repos with PAC changes", "%d"),
    ("PAC vs Non-PAC Code Changes", "repos_with_non_pac_only", "Total repos with non-PAC only commits", "%d"),
)

PAC_COMMIT_STATS_LINES = (
    ("total_commits", "Total PaC commits", "%d"),
    ("unique_projects", "Unique projects", "%d"),
    ("only_pac_pct", "Only PaC files (%)", "%.1f"),
    ("mixed_pct", "Mixed changes (%)", "%.1f"),
    ("avg_pac_files_per_commit", "PaC files", "%.2f"),
    ("avg_other_files_per_commit", "Other files", "%.2f"),
    ("avg_pac_line_changes", "PaC line changes", "%.0f"),
    ("avg_total_line_changes", "Total line changes", "%.0f"),
)


def _lines(one_row: DataFrame, lines, with_section: bool) -> DataFrame:
    """Unpivot a one-row summary into ``(section?, label, value)`` display rows."""
    shown_lines = []
    for i, spec in enumerate(lines):
        section, col, label, fmt = spec if with_section else (None, *spec)
        v = F.col(col)
        m = re.search(r"%\.(\d)f", fmt)
        if m:  # half-even first, as Python formats exact ties (6.5 -> "6")
            v = F.bround(v, int(m.group(1)))
        shown = F.when(v.isNull(), F.lit("nan")).otherwise(F.format_string(fmt, v))
        shown_lines.append(F.struct(F.lit(i).alias("line"), F.lit(section).cast("string").alias("section"),
                                    F.lit(label).alias("label"), shown.alias("value")))
    out = one_row.select(F.inline(F.array(*shown_lines)))
    return out if with_section else out.drop("section")


def corpus_medians_report(corpus_medians: DataFrame) -> DataFrame:
    """Display lines of the cross-repository medians (A9); an empty median shows ``nan``."""
    return _lines(corpus_medians, CORPUS_MEDIANS_LINES, with_section=True)


def pac_commit_stats_report(stats: DataFrame) -> DataFrame:
    """Display lines of the PaC commit statistics."""
    return _lines(stats, PAC_COMMIT_STATS_LINES, with_section=False)
