"""Declared schemas: nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

CHANGE = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("additions", T.LongType()),
    T.StructField("deletions", T.LongType()),
    T.StructField("total_changes", T.LongType()),
    T.StructField("status", T.IntegerType()),
])

# Repository catalog CSV: one unnamed index column, then 28 named columns.
CATALOG_CSV = T.StructType([
    T.StructField("", T.IntegerType()),  # the unnamed index column
    T.StructField("id", T.LongType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("pushed_at", T.TimestampType()),
    T.StructField("first_commit_sha", T.StringType()),
    T.StructField("last_commit_sha", T.StringType()),
    T.StructField("fork", T.BooleanType()),
    T.StructField("forks_count", T.IntegerType()),
    T.StructField("stargazers_count", T.IntegerType()),
    T.StructField("archived", T.BooleanType()),
    T.StructField("url", T.StringType()),
    T.StructField("clone_url", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("contributor_count", T.IntegerType()),
    T.StructField("commit_count", T.IntegerType()),
    T.StructField("tag_count", T.IntegerType()),
    T.StructField("issue_count", T.IntegerType()),
    T.StructField("pull_request_count", T.IntegerType()),
    T.StructField("release_count", T.IntegerType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("technology", T.StringType()),
    T.StructField("commit_count_median", T.DoubleType()),
    T.StructField("age_median", T.DoubleType()),
    T.StructField("issue_count_median", T.DoubleType()),
    T.StructField("pull_request_count_median", T.DoubleType()),
    T.StructField("contributor_count_median", T.DoubleType()),
])

# Exported commit history, one JSON line per commit; pos (walk position) and parents may be missing.
HISTORY = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_email", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("date", T.LongType()),
    T.StructField("parent_count", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("files", T.ArrayType(T.StringType())),
    T.StructField("changes", T.ArrayType(CHANGE)),
    T.StructField("parents", T.ArrayType(T.StringType())),
])

# Collected result, one JSON line per commit (the persisted commit projection,
# P11, with its change lists kept apart as RESULT_CHANGE rows) carrying its
# repository keys; partitioned by owner_name / repository_name.
RESULT_COMMIT = T.StructType([
    T.StructField("repository_id", T.LongType()),
    T.StructField("project_name", T.StringType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_email", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("date", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("has_pac_changes", T.BooleanType()),
    T.StructField("pac_files_count", T.LongType()),
    T.StructField("other_files_count", T.LongType()),
    T.StructField("pac_added_lines", T.LongType()),
    T.StructField("pac_deleted_lines", T.LongType()),
    T.StructField("total_added_lines", T.LongType()),
    T.StructField("total_deleted_lines", T.LongType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# One JSON line per classified change (an entry of pac_changes / other_changes).
RESULT_CHANGE = T.StructType([
    T.StructField("repository_id", T.LongType()),
    T.StructField("project_name", T.StringType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("is_pac", T.BooleanType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("file", T.StringType()),
    T.StructField("additions", T.LongType()),
    T.StructField("deletions", T.LongType()),
    T.StructField("total_changes", T.LongType()),
    T.StructField("status", T.IntegerType()),
])

# One JSON line per touched file of a commit, in file order.
RESULT_FILE = T.StructType([
    T.StructField("repository_id", T.LongType()),
    T.StructField("project_name", T.StringType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("file", T.StringType()),
])

# A commit inside the analysed tool's own result document.
DOCUMENT_COMMIT = T.StructType([
    T.StructField("commit_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_email", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("date", T.LongType()),
    T.StructField("files", T.ArrayType(T.StringType())),
    T.StructField("pac_changes", T.ArrayType(CHANGE)),
    T.StructField("other_changes", T.ArrayType(CHANGE)),
    T.StructField("has_pac_changes", T.BooleanType()),
    T.StructField("pac_added_lines", T.LongType()),
    T.StructField("pac_deleted_lines", T.LongType()),
    T.StructField("total_added_lines", T.LongType()),
    T.StructField("total_deleted_lines", T.LongType()),
])

# Repository rows of a collected result (statistics dropped, as saved).
RESULT_REPOSITORY = T.StructType([
    T.StructField("repository_id", T.LongType()),
    T.StructField("project_name", T.StringType()),
    T.StructField("total_commits", T.LongType()),
    T.StructField("pac_changes_count", T.LongType()),
    T.StructField("pac_commits_count", T.LongType()),
    T.StructField("pac_change_ratio", T.DoubleType()),
])

# The analysed tool's own result document: {metadata, repositories[commits[]]}.
RESULT_DOCUMENT = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("analysis_start", T.DoubleType()),
        T.StructField("analysis_endtime", T.DoubleType()),
        T.StructField("analysis_duration", T.DoubleType()),
        T.StructField("configuration", T.StructType([
            T.StructField("repository_no", T.IntegerType()),
            T.StructField("use_test_mode", T.BooleanType()),
            T.StructField("csv_path", T.StringType()),
            T.StructField("pac_file_names_csv", T.StringType()),
        ])),
    ])),
    T.StructField("repositories", T.ArrayType(T.StructType([
        T.StructField("repository_id", T.LongType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("repository_name", T.StringType()),
        T.StructField("owner_name", T.StringType()),
        T.StructField("total_commits", T.LongType()),
        T.StructField("pac_changes_count", T.LongType()),
        T.StructField("pac_commits_count", T.LongType()),
        T.StructField("pac_change_ratio", T.DoubleType()),
        T.StructField("commits", T.ArrayType(DOCUMENT_COMMIT)),
    ]))),
    T.StructField("_corrupt_record", T.StringType()),
])

INSPECTION_CSV = T.StructType([
    T.StructField("project_name", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("commit_message", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("date", T.LongType()),
    T.StructField("github_url", T.StringType()),
    T.StructField("pac_files_count", T.LongType()),
    T.StructField("other_files_count", T.LongType()),
    T.StructField("pac_added_lines", T.LongType()),
    T.StructField("pac_deleted_lines", T.LongType()),
    T.StructField("total_added_lines", T.LongType()),
    T.StructField("total_deleted_lines", T.LongType()),
    T.StructField("pac_files", T.StringType()),
    T.StructField("pac_files_detailed", T.StringType()),
])
