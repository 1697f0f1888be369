"""DuckDB oracle SQL, one string per registered query.

The adapter views of FIXTURES.md §3 are inlined as CTEs over the raw tables
(``date`` as epoch seconds).  Where the Spark plan avoids a per-repository
sort, the SQL here states the definition directly -- row numbers in date
order, ``idx >= first_idx`` -- so the check compares two formulations.
"""

from __future__ import annotations

from histofold.operators.reports import CORPUS_MEDIANS_LINES, PAC_COMMIT_STATS_LINES

ADAPTER_CTES = r"""
repos AS (
  SELECT n_nationkey AS repo_id, r_name || '/' || n_name AS full_name, n_nationkey + 1 AS idx,
         CASE WHEN n_nationkey % 6 = 5 THEN 'deadbeef' ELSE cast(k AS varchar(20)) END AS sha,
         cast(h AS varchar(20)) AS head_sha
  FROM nation JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT c_nationkey, min(o_orderkey) AS k, max(o_orderkey) AS h
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) x ON c_nationkey = n_nationkey
),
done_repos AS (SELECT full_name FROM repos WHERE idx % 5 <> 0),
gone_repos AS (SELECT full_name FROM repos WHERE idx = 10),
paths AS (
  SELECT p_partkey,
         CASE p_type WHEN 'ECONOMY' THEN 'policy/' || cast(p_partkey AS varchar(20)) || '.rego'
                     WHEN 'SMALL' THEN 'k8s/' || cast(p_partkey AS varchar(20)) || '.YAML'
                     WHEN 'MEDIUM' THEN 'src.d/' || cast(p_partkey AS varchar(20)) || '.test.py'
                     WHEN 'LARGE' THEN 'dist/' || cast(p_partkey AS varchar(20)) || '.tar.gz'
                     WHEN 'STANDARD' THEN 'cfg.d/.hidden' || cast(p_partkey AS varchar(20))
                     ELSE 'Makefile' || cast(p_partkey AS varchar(20)) END AS path
  FROM part
),
pac_files AS (
  SELECT n_nationkey AS repo_id, path FROM nation CROSS JOIN paths WHERE (p_partkey + n_nationkey) % 8 = 0
  UNION ALL
  SELECT n_nationkey AS repo_id, path FROM nation CROSS JOIN paths
  WHERE (p_partkey + n_nationkey) % 8 = 0 AND p_partkey % 16 = 0
),
commits AS (
  SELECT c_nationkey AS repo_id, o_orderkey AS commit_id,
         CASE WHEN o_custkey % 50 = 0 THEN '' ELSE c_name END AS author,
         CASE WHEN o_custkey % 50 <> 0 THEN lower(replace(c_name, '#', '.')) || '@example.org' END AS author_email,
         o_orderpriority || chr(10) || o_orderstatus AS message,
         date_diff('second', TIMESTAMP '1970-01-01 00:00:00', o_orderdate) AS date,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderkey % 500 = 0 THEN 0 ELSE 1 END AS parent_count,
         cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey DESC) - 1 AS INTEGER) AS pos
  FROM orders JOIN customer ON o_custkey = c_custkey
),
files_full AS (
  SELECT l_orderkey AS commit_id, path AS file, l_tax, l_quantity, l_discount, l_returnflag, l_linestatus,
         cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                            l_quantity, l_discount, l_tax, l_shipdate) - 1 AS INTEGER) AS pos
  FROM lineitem JOIN paths ON l_partkey = p_partkey
),
files AS (SELECT commit_id, file, pos FROM files_full),
changes AS (
  SELECT commit_id, pos, file, cast(l_quantity AS int) AS additions,
         cast(round(l_discount * 100) AS int) AS deletions,
         CASE WHEN l_tax > 0.065 THEN cast(NULL AS int)
              WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1
              WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 2
              WHEN l_returnflag = 'R' THEN 4 ELSE 3 END AS status
  FROM files_full WHERE l_tax < 0.075
)"""

PIPELINE_CTES = r"""
live AS (SELECT * FROM commits WHERE NOT coalesce(parent_count >= 2, false)),
exported AS (
  SELECT ch.commit_id, ch.pos, ch.file, ch.additions,
         CASE WHEN c.parent_count = 0 THEN 0 ELSE ch.deletions END AS deletions,
         CASE WHEN c.parent_count = 0 THEN 1 ELSE ch.status END AS status
  FROM changes ch JOIN commits c ON c.commit_id = ch.commit_id
),
last_change AS (
  SELECT commit_id, file, additions, deletions, status FROM (
    SELECT *, row_number() OVER (PARTITION BY commit_id, file ORDER BY pos DESC) AS rn FROM exported) z
  WHERE rn = 1
),
pac_distinct AS (SELECT DISTINCT repo_id, path FROM pac_files),
classified AS (
  SELECT l.repo_id, f.commit_id, f.pos, f.file, (p.path IS NOT NULL) AS is_pac,
         CASE WHEN c.file IS NOT NULL THEN c.additions ELSE 0 END AS additions,
         CASE WHEN c.file IS NOT NULL THEN c.deletions ELSE 0 END AS deletions,
         CASE WHEN c.file IS NOT NULL THEN c.additions + c.deletions ELSE 0 END AS total_changes,
         c.status
  FROM files f JOIN live l ON f.commit_id = l.commit_id
  LEFT JOIN pac_distinct p ON p.repo_id = l.repo_id AND p.path = f.file
  LEFT JOIN last_change c ON c.commit_id = f.commit_id AND c.file = f.file
  WHERE NOT coalesce(c.status IN (1, 2), false) AND (c.file IS NOT NULL OR p.path IS NULL)
),
facts AS (
  SELECT l.repo_id, r.full_name AS project_name, l.commit_id, l.author, l.author_email, l.message, l.date, l.pos,
         cast(coalesce(k.pac_files_count, 0) AS BIGINT) AS pac_files_count,
         cast(coalesce(k.other_files_count, 0) AS BIGINT) AS other_files_count,
         cast(coalesce(k.pac_added_lines, 0) AS BIGINT) AS pac_added_lines,
         cast(coalesce(k.pac_deleted_lines, 0) AS BIGINT) AS pac_deleted_lines,
         cast(coalesce(t.total_added_lines, 0) AS BIGINT) AS total_added_lines,
         cast(coalesce(t.total_deleted_lines, 0) AS BIGINT) AS total_deleted_lines,
         coalesce(k.pac_files_count, 0) > 0 AS has_pac_changes
  FROM live l JOIN repos r ON r.repo_id = l.repo_id
  LEFT JOIN (SELECT commit_id,
                    count(*) FILTER (WHERE is_pac) AS pac_files_count,
                    count(*) FILTER (WHERE NOT is_pac) AS other_files_count,
                    sum(CASE WHEN is_pac THEN additions END) AS pac_added_lines,
                    sum(CASE WHEN is_pac THEN deletions END) AS pac_deleted_lines
             FROM classified GROUP BY commit_id) k ON k.commit_id = l.commit_id
  LEFT JOIN (SELECT commit_id, sum(additions) AS total_added_lines, sum(deletions) AS total_deleted_lines
             FROM exported GROUP BY commit_id) t ON t.commit_id = l.commit_id
),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(date, 0), pos) - 1 AS idx FROM facts
),
firsts AS (
  SELECT repo_id, min(idx) AS first_idx FROM indexed WHERE has_pac_changes GROUP BY repo_id
),
slice AS (
  SELECT i.*, s.first_idx FROM indexed i JOIN firsts s ON s.repo_id = i.repo_id WHERE i.idx >= s.first_idx
)"""


def _q(body: str) -> str:
    return "WITH " + ADAPTER_CTES.strip() + ",\n" + PIPELINE_CTES.strip() + "\n" + body.strip()


SQL: dict[str, str] = {}


def register(name: str, body: str) -> None:
    SQL[name] = _q(body)


# ----------------------------------------------------------------- metrics
_SLICE_METRICS = """
metrics AS (
  SELECT repo_id, project_name AS repository, count(*) AS total_commits,
         count(*) FILTER (WHERE has_pac_changes) AS pac_commits,
         count(*) FILTER (WHERE NOT has_pac_changes) AS non_pac_commits,
         count(*) FILTER (WHERE has_pac_changes) / count(*) * 100 AS pac_maintenance_frequency,
         cast(min(first_idx) AS BIGINT) AS first_pac_commit_index,
         coalesce(median(CASE WHEN has_pac_changes THEN cast(total_added_lines + total_deleted_lines AS DOUBLE) END), 0)
           AS pac_commit_median_size,
         coalesce(median(CASE WHEN NOT has_pac_changes THEN cast(total_added_lines + total_deleted_lines AS DOUBLE) END), 0)
           AS non_pac_commit_median_size,
         count(pv) AS pac_commits_with_changes, coalesce(median(cast(pv AS DOUBLE)), 0) AS pac_code_median_changes,
         coalesce(min(pv), 0) AS pac_changes_min, coalesce(max(pv), 0) AS pac_changes_max,
         count(nv) AS non_pac_commits_with_changes, coalesce(median(cast(nv AS DOUBLE)), 0) AS non_pac_code_median_changes,
         coalesce(min(nv), 0) AS non_pac_changes_min, coalesce(max(nv), 0) AS non_pac_changes_max,
         count(ov) AS non_pac_only_commits_count, coalesce(median(cast(ov AS DOUBLE)), 0) AS non_pac_only_median_changes,
         coalesce(min(ov), 0) AS non_pac_only_changes_min, coalesce(max(ov), 0) AS non_pac_only_changes_max
  FROM (SELECT *,
          CASE WHEN has_pac_changes AND pac_added_lines + pac_deleted_lines > 0
               THEN pac_added_lines + pac_deleted_lines END AS pv,
          CASE WHEN has_pac_changes AND (total_added_lines + total_deleted_lines)
                                        - (pac_added_lines + pac_deleted_lines) > 0
               THEN (total_added_lines + total_deleted_lines) - (pac_added_lines + pac_deleted_lines) END AS nv,
          CASE WHEN NOT has_pac_changes AND total_added_lines + total_deleted_lines > 0
               THEN total_added_lines + total_deleted_lines END AS ov
        FROM slice) s
  GROUP BY repo_id, project_name
),
authors AS (
  SELECT repo_id, project_name AS repository,
         count(DISTINCT CASE WHEN author <> '' THEN author END) AS total_authors,
         count(DISTINCT CASE WHEN author <> '' AND has_pac_changes THEN author END) AS pac_authors
  FROM slice GROUP BY repo_id, project_name
),
shares AS (
  SELECT repo_id, repository, total_authors, pac_authors,
         CASE WHEN total_authors > 0 THEN pac_authors / total_authors * 100 ELSE 0.0 END
           AS pac_maintainer_percentage
  FROM authors
),
all_metrics AS (
  SELECT m.*, s.total_authors, s.pac_authors, s.pac_maintainer_percentage
  FROM metrics m JOIN shares s ON s.repo_id = m.repo_id
),
repo_totals AS (
  SELECT repo_id AS repository_id, project_name, count(*) AS total_commits,
         cast(sum(pac_files_count) AS BIGINT) AS pac_changes_count,
         count(*) FILTER (WHERE has_pac_changes) AS pac_commits_count,
         cast(sum(total_added_lines) AS BIGINT) AS total_added_lines,
         cast(sum(total_deleted_lines) AS BIGINT) AS total_deleted_lines,
         cast(sum(pac_added_lines) AS BIGINT) AS pac_added_lines,
         cast(sum(pac_deleted_lines) AS BIGINT) AS pac_deleted_lines
  FROM facts GROUP BY repo_id, project_name
)"""


def register_m(name: str, body: str) -> None:
    """Like ``register`` with the per-repository metric CTEs in scope."""
    SQL[name] = ("WITH " + ADAPTER_CTES.strip() + ",\n" + PIPELINE_CTES.strip() + ","
                 + _SLICE_METRICS.rstrip() + "\n" + body.strip())


register_m("pac_frequency", """
SELECT repo_id, repository, total_commits, pac_commits, pac_maintenance_frequency, first_pac_commit_index
FROM metrics
""")

register("first_pac_index", """
SELECT f.repo_id, f.project_name AS repository, count(*) AS total_commits,
       cast(coalesce(min(s.first_idx), -1) AS BIGINT) AS first_pac_commit_index
FROM facts f LEFT JOIN firsts s ON s.repo_id = f.repo_id
GROUP BY f.repo_id, f.project_name
""")

register("commit_index", "SELECT repo_id, commit_id, date, pos, idx FROM indexed")

register("since_first_pac", """
SELECT repo_id, commit_id, date, pos, has_pac_changes FROM slice
""")

register_m("commit_size_medians", """
SELECT repo_id, repository, pac_commits AS pac_commits_count, non_pac_commits AS non_pac_commits_count,
       pac_commit_median_size, non_pac_commit_median_size
FROM metrics
""")

register_m("maintainer_share", """
SELECT repo_id, repository, total_authors, pac_authors, pac_maintainer_percentage FROM shares
""")

register_m("code_change_sizes", """
SELECT repo_id, repository, pac_commits_with_changes, pac_code_median_changes, pac_changes_min, pac_changes_max,
       non_pac_commits_with_changes, non_pac_code_median_changes, non_pac_changes_min, non_pac_changes_max,
       non_pac_only_commits_count, non_pac_only_median_changes, non_pac_only_changes_min, non_pac_only_changes_max
FROM metrics
""")

register_m("corpus_medians", """
SELECT count(*) AS repositories,
       median(cast(pac_maintenance_frequency AS DOUBLE)) AS median_pac_maintenance_frequency,
       median(cast(pac_commits AS DOUBLE)) AS median_pac_commits,
       median(cast(total_commits AS DOUBLE)) AS median_total_commits,
       median(cast(pac_maintainer_percentage AS DOUBLE)) AS median_pac_maintainer_percentage,
       median(cast(pac_authors AS DOUBLE)) AS median_pac_authors,
       median(cast(total_authors AS DOUBLE)) AS median_total_authors,
       median(pac_commit_median_size) AS median_pac_commit_size,
       median(non_pac_commit_median_size) AS median_non_pac_commit_size,
       median(pac_code_median_changes) AS median_pac_code_changes,
       median(CASE WHEN non_pac_code_median_changes > 0 THEN non_pac_code_median_changes END)
         AS median_non_pac_code_changes,
       median(CASE WHEN non_pac_only_median_changes > 0 THEN non_pac_only_median_changes END)
         AS median_non_pac_only_changes,
       count(*) FILTER (WHERE pac_commits_with_changes > 0) AS repos_with_pac_changes,
       count(*) FILTER (WHERE non_pac_only_commits_count > 0) AS repos_with_non_pac_only
FROM all_metrics
""")

register_m("repo_fold", """
SELECT repository_id, project_name, total_commits, pac_changes_count, pac_commits_count,
       total_added_lines, total_deleted_lines, pac_added_lines, pac_deleted_lines,
       CASE WHEN total_commits > 0 THEN pac_changes_count / total_commits ELSE 0.0 END AS pac_change_ratio,
       total_added_lines + total_deleted_lines AS total_modified_lines,
       pac_added_lines + pac_deleted_lines AS pac_modified_lines,
       CASE WHEN contains(project_name, '/') THEN split_part(project_name, '/', 1) END AS owner_name,
       CASE WHEN contains(project_name, '/') THEN split_part(project_name, '/', 2) END AS repository_name
FROM repo_totals
""")

register_m("corpus_summary", """
SELECT count(*) AS repositories, cast(sum(total_commits) AS BIGINT) AS total_commits,
       cast(sum(pac_changes_count) AS BIGINT) AS total_pac_changes,
       cast(sum(pac_commits_count) AS BIGINT) AS pac_commits,
       CASE WHEN sum(total_commits) > 0 THEN sum(pac_changes_count) / sum(total_commits) END AS pac_change_ratio,
       CASE WHEN sum(total_commits) > 0 THEN sum(pac_commits_count) / sum(total_commits) END AS pac_commit_ratio
FROM repo_totals
""")

register_m("boxplot_summary", """
, long AS (
  SELECT 'PaC Files' AS series, pac_code_median_changes AS v FROM metrics WHERE pac_code_median_changes > 0
  UNION ALL
  SELECT 'Non-PaC Files', non_pac_code_median_changes FROM metrics WHERE non_pac_code_median_changes > 0
), q AS (
  SELECT series, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM long GROUP BY series
)
SELECT l.series, q.q1, q.median, q.q3, count(*) AS n, min(v) AS min, max(v) AS max,
       min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low,
       max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high,
       count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM long l JOIN q ON q.series = l.series
GROUP BY l.series, q.q1, q.median, q.q3
""")

register_m("share_histogram", """
, long AS (
  SELECT 'pac_maintenance_frequency' AS metric, pac_maintenance_frequency AS x FROM all_metrics
  UNION ALL
  SELECT 'pac_maintainer_percentage', pac_maintainer_percentage FROM all_metrics
)
SELECT metric, cast(floor(x / 5.0) * 5.0 AS DOUBLE) AS bin_start, count(*) AS repositories
FROM long GROUP BY metric, cast(floor(x / 5.0) * 5.0 AS DOUBLE)
""")

register_m("code_changes_long", """
SELECT repository, 'PAC Code' || chr(10) || '(in PAC commits)' AS code_type,
       pac_code_median_changes AS median_lines_changed FROM metrics WHERE pac_code_median_changes > 0
UNION ALL
SELECT repository, 'Non-PAC Code' || chr(10) || '(in PAC commits)', non_pac_code_median_changes
FROM metrics WHERE non_pac_code_median_changes > 0
UNION ALL
SELECT repository, 'Non-PAC Code' || chr(10) || '(in non-PAC commits)', non_pac_only_median_changes
FROM metrics WHERE non_pac_only_median_changes > 0
""")

# ----------------------------------------------------------- classification
register("drop_merges", "SELECT repo_id, commit_id, author, date, parent_count, pos FROM live")

register("root_commit_changes", """
SELECT ch.commit_id, ch.pos, ch.file, ch.additions,
       CASE WHEN c.parent_count = 0 THEN 0 ELSE ch.deletions END AS deletions,
       CASE WHEN c.parent_count = 0 THEN 1 ELSE ch.status END AS status
FROM changes ch JOIN commits c ON c.commit_id = ch.commit_id
""")

register("newline_count", """
SELECT doc_id, cast(coalesce(length(text) - length(replace(text, chr(10), '')), 0) AS BIGINT) AS newline_count
FROM documents
""")

register("change_totals", """
SELECT commit_id, pos, file, additions, deletions, status, additions + deletions AS total_changes FROM changes
""")

register("parse_commits", """
SELECT repo_id, commit_id, coalesce(author, '') AS author, coalesce(message, '') AS message, date, pos
FROM commits WHERE commit_id IS NOT NULL
""")

register("filter_status", """
SELECT * FROM changes WHERE status IS NULL OR status NOT IN (1, 2)
""")

register("pac_changes", """
SELECT repo_id, commit_id, pos, file, additions, deletions, total_changes, status FROM classified WHERE is_pac
""")

register("other_changes", """
SELECT repo_id, commit_id, pos, file, additions, deletions, total_changes, status FROM classified WHERE NOT is_pac
""")

register("commit_fold", "SELECT * FROM facts")

register("collection_diagnostics", """
SELECT repo_id, full_name, 'No commits found' AS reason
FROM (SELECT CAST(repo_id AS INT) AS repo_id, full_name FROM repos
      UNION ALL SELECT CAST(1000 + r_regionkey AS INT), r_name || '/IDLE' FROM region)
WHERE repo_id NOT IN (SELECT repo_id FROM live)
""")

register("split_full_name", """
SELECT repo_id, full_name AS project_name,
       CASE WHEN contains(full_name, '/') THEN split_part(full_name, '/', 1) END AS owner_name,
       CASE WHEN contains(full_name, '/') THEN split_part(full_name, '/', 2) END AS repository_name
FROM repos
""")

register("pac_membership", """
SELECT l.repo_id, f.commit_id, f.pos, f.file, (p.path IS NOT NULL) AS is_pac
FROM files f JOIN live l ON l.commit_id = f.commit_id
LEFT JOIN pac_distinct p ON p.repo_id = l.repo_id AND p.path = f.file
""")

register("pac_files_semi", """
SELECT f.commit_id, f.file, f.pos, l.repo_id
FROM files f JOIN live l ON l.commit_id = f.commit_id
WHERE EXISTS (SELECT 1 FROM pac_files p WHERE p.repo_id = l.repo_id AND p.path = f.file)
""")

register("other_files_anti", """
SELECT f.commit_id, f.file, f.pos, l.repo_id
FROM files f JOIN live l ON l.commit_id = f.commit_id
WHERE NOT EXISTS (SELECT 1 FROM pac_files p WHERE p.repo_id = l.repo_id AND p.path = f.file)
""")

register("change_lookup_last", """
SELECT commit_id, file, additions, deletions, status FROM (
  SELECT *, row_number() OVER (PARTITION BY commit_id, file ORDER BY pos DESC) AS rn FROM changes) z
WHERE rn = 1
""")

register("pac_change_counts", """
SELECT repo_id, commit_id, count(*) AS pac_changes, string_agg(file, '; ' ORDER BY pos) AS pac_files
FROM classified WHERE is_pac GROUP BY repo_id, commit_id
""")

# --------------------------------------------------------------- inspection
_INSPECTION = r"""
file_lists AS (
  SELECT repo_id, commit_id, string_agg(file, '; ' ORDER BY pos) AS pac_files,
         string_agg(file || ' (+' || cast(additions AS VARCHAR) || '/-' || cast(deletions AS VARCHAR) || ')', '; '
                    ORDER BY pos) AS pac_files_detailed
  FROM classified WHERE is_pac GROUP BY repo_id, commit_id
),
insp AS (
  SELECT f.repo_id, f.project_name, cast(f.commit_id AS VARCHAR) AS commit_sha,
         replace(coalesce(f.message, ''), chr(10), ' ') AS commit_message, coalesce(f.author, '') AS author, f.date,
         CASE WHEN contains(f.project_name, '/') AND cast(f.commit_id AS VARCHAR) <> ''
              THEN 'https://github.com/' || f.project_name || '/commit/' || cast(f.commit_id AS VARCHAR)
              ELSE '' END AS github_url,
         f.pac_files_count, f.other_files_count, f.pac_added_lines, f.pac_deleted_lines,
         f.total_added_lines, f.total_deleted_lines,
         coalesce(l.pac_files, '') AS pac_files, coalesce(l.pac_files_detailed, '') AS pac_files_detailed
  FROM facts f LEFT JOIN file_lists l ON l.repo_id = f.repo_id AND l.commit_id = f.commit_id
  WHERE f.has_pac_changes
),
sample AS (
  SELECT * FROM insp
  ORDER BY md5(concat_ws(':', '42', project_name, commit_sha)), project_name, commit_sha LIMIT 362
)"""

_EXT = r"""
ext_named AS (
  SELECT c.repo_id, c.commit_id, c.is_pac, c.file,
         coalesce(list_filter(string_split(c.file, '/'), lambda x: x <> '' AND x <> '.')[-1], '') AS name
  FROM classified c
),
ext_split AS (
  SELECT *, regexp_extract(name, '(?s)^(.+)(\.[^.]+)$', 2) AS suffix FROM ext_named
),
ext_stem AS (
  SELECT *, CASE WHEN suffix <> '' THEN regexp_extract(name, '(?s)^(.+)(\.[^.]+)$', 1) ELSE name END AS stem
  FROM ext_split
),
ext_all AS (
  SELECT repo_id, commit_id, is_pac, file,
         CASE WHEN stem <> '' AND ends_with(stem, '.tar') THEN '.tar' || lower(suffix) ELSE lower(suffix) END AS e
  FROM ext_stem
),
ext_rows AS (
  SELECT DISTINCT a.repo_id, a.commit_id, a.is_pac, CASE WHEN a.e = '' THEN 'no_extension' ELSE a.e END AS ext
  FROM ext_all a JOIN facts f ON f.repo_id = a.repo_id AND f.commit_id = a.commit_id AND f.has_pac_changes
),
sided AS (SELECT *, CASE WHEN is_pac THEN 'pac' ELSE 'other' END AS side FROM ext_rows),
ext_counts AS (SELECT side, ext, count(*) AS commits FROM sided GROUP BY side, ext),
side_totals AS (
  SELECT side, count(*) AS side_commits FROM (SELECT DISTINCT side, repo_id, commit_id FROM sided) z GROUP BY side
),
two_sided AS (
  SELECT repo_id, commit_id FROM sided GROUP BY repo_id, commit_id
  HAVING count(*) FILTER (WHERE side = 'pac') > 0 AND count(*) FILTER (WHERE side = 'other') > 0
),
pairs AS (
  SELECT a.ext AS pac_extension, b.ext AS other_extension, count(*) AS count
  FROM sided a JOIN sided b ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id
  WHERE a.side = 'pac' AND b.side = 'other'
  GROUP BY a.ext, b.ext
),
n_tx AS (SELECT count(*) AS n FROM two_sided),
items AS (
  SELECT s.side, s.ext, count(*) AS c FROM sided s
  JOIN two_sided t ON t.repo_id = s.repo_id AND t.commit_id = s.commit_id GROUP BY s.side, s.ext
),
rules_all AS (
  SELECT p.pac_extension AS antecedent, p.other_extension AS consequent, p.count,
         a.c AS antecedent_count, b.c AS consequent_count, n.n
  FROM pairs p JOIN items a ON a.side = 'pac' AND a.ext = p.pac_extension
  JOIN items b ON b.side = 'other' AND b.ext = p.other_extension
  CROSS JOIN n_tx n
),
top_ext AS (
  SELECT side, ext, commits, row_number() OVER (PARTITION BY side ORDER BY commits DESC, ext) AS rank
  FROM ext_counts
)"""


def rules_sql(min_support: float, min_confidence: float) -> str:
    return f"""
rules AS (
  SELECT antecedent, consequent, count / n AS support, count / antecedent_count AS confidence,
         CASE WHEN consequent_count / n > 0 THEN (count / antecedent_count) / (consequent_count / n) ELSE 0.0 END
           AS lift,
         cast(count AS BIGINT) AS count, cast(antecedent_count AS BIGINT) AS antecedent_count,
         cast(consequent_count AS BIGINT) AS consequent_count
  FROM rules_all
  WHERE count >= floor(cast({min_support!r} AS DOUBLE) * n)
    AND count / antecedent_count >= cast({min_confidence!r} AS DOUBLE)
)"""


def register_x(name: str, body: str, *extra: str) -> None:
    """Like ``register`` with inspection / extension CTEs (and ``extra``) in scope."""
    ctes = [ADAPTER_CTES.strip(), PIPELINE_CTES.strip(), _INSPECTION.strip(), _EXT.strip(),
            *[e.strip() for e in extra]]
    SQL[name] = "WITH " + ",\n".join(ctes) + "\n" + body.strip()


register_x("commit_url", """
SELECT repo_id, cast(commit_id AS VARCHAR) AS commit_sha,
       CASE WHEN contains(project_name, '/') AND cast(commit_id AS VARCHAR) <> ''
            THEN 'https://github.com/' || project_name || '/commit/' || cast(commit_id AS VARCHAR)
            ELSE '' END AS github_url
FROM facts
""")
register_x("pac_file_lists", "SELECT * FROM file_lists")
register_x("inspection_rows", "SELECT * FROM insp")
register_x("inspection_sorted", "SELECT * FROM sample ORDER BY project_name, date, commit_sha")
register_x("seeded_sample", "SELECT * FROM sample")
register_x("sample_100", """
SELECT * FROM insp WHERE (SELECT count(*) FROM insp) > 100
ORDER BY md5(concat_ws(':', '42', project_name, commit_sha)), project_name, commit_sha LIMIT 100
""")
register_x("pac_commit_stats", """
SELECT * , commits_with_only_pac / total_commits * 100 AS only_pac_pct,
       commits_with_mixed_changes / total_commits * 100 AS mixed_pct
FROM (
  SELECT count(*) AS total_commits, count(DISTINCT project_name) AS unique_projects,
         sum(pac_files_count) / count(*) AS avg_pac_files_per_commit,
         sum(other_files_count) / count(*) AS avg_other_files_per_commit,
         sum(pac_added_lines + pac_deleted_lines) / count(*) AS avg_pac_line_changes,
         sum(total_added_lines + total_deleted_lines) / count(*) AS avg_total_line_changes,
         count(*) FILTER (WHERE other_files_count = 0) AS commits_with_only_pac,
         count(*) FILTER (WHERE other_files_count > 0) AS commits_with_mixed_changes
  FROM facts WHERE has_pac_changes
) s WHERE total_commits > 0
""")
register_x("commits_by_project", """
SELECT project_name, count(*) AS pac_commits FROM facts WHERE has_pac_changes GROUP BY project_name
""")
register_x("top_projects", """
SELECT project_name, count(*) AS pac_commits FROM facts WHERE has_pac_changes GROUP BY project_name
ORDER BY pac_commits DESC, project_name LIMIT 10
""")

# ---------------------------------------------------------------- co-change
register_x("file_extension", """
SELECT DISTINCT file, extension FROM (
  SELECT file, CASE WHEN e = '' THEN 'no_extension' ELSE e END AS extension FROM (
    SELECT file, CASE WHEN stem <> '' AND ends_with(stem, '.tar') THEN '.tar' || lower(suffix) ELSE lower(suffix) END AS e
    FROM (SELECT file, suffix, CASE WHEN suffix <> '' THEN regexp_extract(name, '(?s)^(.+)(\\.[^.]+)$', 1) ELSE name END AS stem
          FROM (SELECT file, name, regexp_extract(name, '(?s)^(.+)(\\.[^.]+)$', 2) AS suffix
                FROM (SELECT file, coalesce(list_filter(string_split(file, '/'), lambda x: x <> '' AND x <> '.')[-1], '') AS name
                      FROM (SELECT DISTINCT file FROM files) d) a) b) c) e) f
""")
register_x("cochange_transactions", """
SELECT f.project_name AS repository, f.commit_id, f.pac_files_count AS num_pac_files,
       f.other_files_count AS num_other_files,
       coalesce(array_to_string(list_sort(list(DISTINCT s.ext) FILTER (WHERE s.is_pac)), ','), '') AS pac_extensions,
       coalesce(array_to_string(list_sort(list(DISTINCT s.ext) FILTER (WHERE NOT s.is_pac)), ','), '') AS other_extensions,
       coalesce(array_to_string(list_sort(list(DISTINCT s.ext)), ','), '') AS all_extensions
FROM facts f JOIN ext_rows s ON s.repo_id = f.repo_id AND s.commit_id = f.commit_id
WHERE f.has_pac_changes
GROUP BY f.project_name, f.repo_id, f.commit_id, f.pac_files_count, f.other_files_count
""")
register_x("extension_counts", "SELECT * FROM ext_counts")
register_x("cochange_pairs", "SELECT pac_extension, other_extension, cast(count AS BIGINT) AS count FROM pairs")
register_x("cochange_totals", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT repo_id, commit_id FROM sided) z) AS total_commits,
       (SELECT count(*) FROM (SELECT DISTINCT repo_id, commit_id FROM sided WHERE side = 'other') z)
         AS commits_with_other_files,
       (SELECT count(DISTINCT ext) FROM sided WHERE side = 'pac') AS unique_pac_extensions,
       (SELECT count(DISTINCT ext) FROM sided WHERE side = 'other') AS unique_other_extensions,
       CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT repo_id, commit_id FROM sided) z) > 0
            THEN (SELECT count(*) FROM (SELECT DISTINCT repo_id, commit_id FROM sided WHERE side = 'other') z)
                 / (SELECT count(*) FROM (SELECT DISTINCT repo_id, commit_id FROM sided) z) * 100 END AS cochange_rate
""")
register_x("extension_share", """
SELECT c.side, c.ext, c.commits,
       CASE WHEN t.side_commits > 0 THEN c.commits / t.side_commits * 100 ELSE 0.0 END AS percentage
FROM ext_counts c LEFT JOIN side_totals t ON t.side = c.side
""")
register_x("association_rules", "SELECT * FROM rules", rules_sql(0.01, 0.1))
register_x("association_rules_main", "SELECT * FROM rules", rules_sql(0.1, 0.8))
register_x("association_rules_selective", "SELECT * FROM rules", rules_sql(0.07, 0.4))
register_x("top_rules", """
SELECT * FROM rules ORDER BY confidence DESC, support DESC, antecedent, consequent LIMIT 20
""", rules_sql(0.01, 0.1))
register_x("top_rules_by_lift", """
SELECT * FROM rules ORDER BY lift DESC, confidence DESC, support DESC, antecedent, consequent LIMIT 3
""", rules_sql(0.01, 0.1))
register_x("top_extensions", "SELECT side, ext, commits, cast(rank AS INTEGER) AS rank FROM top_ext WHERE rank <= 10")
register_x("cochange_grid", """
SELECT a.ext AS pac_extension, b.ext AS other_extension, cast(a.rank AS INTEGER) AS pac_rank,
       cast(b.rank AS INTEGER) AS other_rank, cast(coalesce(p.count, 0) AS BIGINT) AS count
FROM (SELECT * FROM top_ext WHERE side = 'pac' AND rank <= 5) a
CROSS JOIN (SELECT * FROM top_ext WHERE side = 'other' AND rank <= 5) b
LEFT JOIN pairs p ON p.pac_extension = a.ext AND p.other_extension = b.ext
""")

# ------------------------------------------------------------------ coverage
register("coverage_missing", """
SELECT DISTINCT full_name FROM repos WHERE full_name NOT IN (SELECT full_name FROM done_repos)
""")
register("coverage_collected", """
SELECT DISTINCT full_name FROM repos WHERE full_name IN (SELECT full_name FROM done_repos)
""")
register("coverage_except", "SELECT full_name FROM repos EXCEPT SELECT full_name FROM done_repos")
register("coverage_summary", """
SELECT a AS all_repositories, c AS collected_repositories, a - c AS missed_repositories,
       c / a AS collected_fraction, (a - c) / a AS missed_fraction
FROM (SELECT count(DISTINCT full_name) AS a,
             count(DISTINCT full_name) FILTER (WHERE full_name IN (SELECT full_name FROM done_repos)) AS c
      FROM repos) s
""")
register("retry_worklist", """
SELECT full_name, min(idx) AS idx FROM repos
WHERE full_name NOT IN (SELECT full_name FROM done_repos) AND full_name NOT IN (SELECT full_name FROM gone_repos)
GROUP BY full_name
""")
register("incremental_todo", """
SELECT repo_id, full_name, idx, sha FROM repos WHERE full_name NOT IN (SELECT full_name FROM done_repos)
""")
register("suffix_lookup", """
, names AS (
  SELECT DISTINCT name FROM (
    SELECT split_part(full_name, '/', 2) AS name FROM repos
    UNION ALL SELECT lower(split_part(full_name, '/', 2)) FROM repos
    UNION ALL SELECT split_part(full_name, '/', 1) FROM repos) z
), m AS (
  SELECT n.name, r.repo_id, r.full_name, r.idx,
         row_number() OVER (PARTITION BY n.name ORDER BY r.idx) AS rn
  FROM names n JOIN repos r ON ends_with(r.full_name, n.name)
)
SELECT n.name, m.repo_id, m.full_name, m.idx FROM names n LEFT JOIN m ON m.name = n.name AND m.rn = 1
""")
register("resolve_revision", """
, found AS (
  SELECT DISTINCT r.repo_id FROM repos r JOIN commits c ON c.repo_id = r.repo_id AND cast(c.commit_id AS VARCHAR) = r.sha
)
SELECT r.repo_id, r.full_name, r.sha,
       CASE WHEN r.idx = 7 OR f.repo_id IS NULL THEN r.head_sha ELSE r.sha END AS revision,
       (r.idx = 7 OR f.repo_id IS NULL) AS uses_head
FROM repos r LEFT JOIN found f ON f.repo_id = r.repo_id
""")

# ----------------------------------------------------------- sources, sinks
register("scan_repo_catalog", "SELECT cast(repo_id AS BIGINT) AS repo_id, full_name, sha, idx FROM repos")
register("select_repo_by_number", """
SELECT cast(repo_id AS BIGINT) AS repo_id, full_name, sha, idx FROM repos WHERE idx = 7
""")
register("scan_pac_files", "SELECT DISTINCT cast(repo_id AS BIGINT) AS repo_id, path FROM pac_files")
register("scan_commit_history", """
SELECT cast(c.repo_id AS BIGINT) AS repo_id, cast(ch.commit_id AS VARCHAR) AS commit_id,
       cast(row_number() OVER (PARTITION BY ch.commit_id ORDER BY ch.pos) - 1 AS INTEGER) AS change_pos,
       ch.file, cast(ch.additions AS BIGINT) AS additions, cast(ch.deletions AS BIGINT) AS deletions,
       cast(ch.additions + ch.deletions AS BIGINT) AS total_changes, ch.status
FROM changes ch JOIN commits c ON c.commit_id = ch.commit_id
""")
register("scan_history_files", """
SELECT cast(c.repo_id AS BIGINT) AS repo_id, cast(c.commit_id AS VARCHAR) AS commit_id, f.pos, f.file
FROM commits c LEFT JOIN files f ON f.commit_id = c.commit_id
""")
register("write_results_roundtrip", """
SELECT cast(repo_id AS BIGINT) AS repo_id, project_name, cast(commit_id AS VARCHAR) AS commit_id, author,
       author_email, message, date, pos, pac_files_count, other_files_count, pac_added_lines, pac_deleted_lines,
       total_added_lines, total_deleted_lines, has_pac_changes
FROM facts
""")
register("read_result_files", """
SELECT cast(l.repo_id AS BIGINT) AS repository_id, r.full_name AS project_name, cast(f.commit_id AS VARCHAR) AS commit_id,
       f.pos, f.file, split_part(r.full_name, '/', 1) AS owner_name, split_part(r.full_name, '/', 2) AS repository_name
FROM files f JOIN live l ON l.commit_id = f.commit_id JOIN repos r ON r.repo_id = l.repo_id
""")
register("collect_job", """
SELECT cast(repo_id AS BIGINT) AS repo_id, project_name, cast(commit_id AS VARCHAR) AS commit_id, author, author_email,
       message, date, pos, pac_files_count, other_files_count, pac_added_lines, pac_deleted_lines,
       total_added_lines, total_deleted_lines, has_pac_changes
FROM facts
""")
register("discover_results", """
SELECT DISTINCT split_part(project_name, '/', 1) AS owner_name, split_part(project_name, '/', 2) AS repository_name
FROM facts
""")
register_m("read_results", """
SELECT cast(repository_id AS BIGINT) AS repository_id, project_name, total_commits, pac_changes_count,
       pac_commits_count,
       CASE WHEN total_commits > 0 THEN pac_changes_count / total_commits ELSE 0.0 END AS pac_change_ratio,
       split_part(project_name, '/', 1) AS owner_name, split_part(project_name, '/', 2) AS repository_name
FROM repo_totals
""")
register("flatten_commits", """
SELECT cast(c.repo_id AS BIGINT) AS repository_id, r.full_name AS project_name,
       cast(c.commit_id AS VARCHAR) AS commit_id, c.is_pac, c.pos, c.file,
       cast(c.additions AS BIGINT) AS additions, cast(c.deletions AS BIGINT) AS deletions,
       cast(c.total_changes AS BIGINT) AS total_changes, c.status,
       split_part(r.full_name, '/', 1) AS owner_name, split_part(r.full_name, '/', 2) AS repository_name
FROM classified c JOIN repos r ON r.repo_id = c.repo_id
""")
register("safe_output_name", r"""
SELECT full_name,
       'outputs/' || regexp_replace(split_part(full_name, '/', 1), '[^\p{L}\p{N}_.\-]', '_', 'g') || '/'
       || regexp_replace(split_part(full_name, '/', 2), '[^\p{L}\p{N}_.\-]', '_', 'g') || '.json' AS output_file
FROM repos
""")
register_x("write_inspection_csv", """
SELECT project_name, commit_sha, commit_message, author, date, github_url, pac_files_count, other_files_count,
       pac_added_lines, pac_deleted_lines, total_added_lines, total_deleted_lines, pac_files, pac_files_detailed
FROM sample
""")


def _report(source: str, lines, sectioned: bool) -> str:
    """The display lines of a one-row summary, one SELECT each."""
    rows = []
    for i, spec in enumerate(lines):
        section, col, label, fmt = spec if sectioned else (None, *spec)
        value = f"coalesce(printf('{fmt}', {col}), 'nan')"
        head = f"'{section}' AS section, " if sectioned else ""
        rows.append(f"SELECT CAST({i} AS INTEGER) AS line, {head}'{label}' AS label, {value} AS value FROM ({source})")
    return " UNION ALL ".join(rows)


# The printed labels and formats are fixed values shared with the report views.
SQL["corpus_medians_report"] = _report(SQL["corpus_medians"], CORPUS_MEDIANS_LINES, True)
SQL["pac_commit_stats_report"] = _report(SQL["pac_commit_stats"], PAC_COMMIT_STATS_LINES, False)

# ------------------------------------------------- history records
register("history_records", """
SELECT cast(c.repo_id AS BIGINT) AS repo_id, cast(c.commit_id AS VARCHAR) AS commit_id,
       CASE WHEN c.commit_id % 35 = 0 THEN 'late ' || c.author ELSE c.author END AS author, c.pos,
       (SELECT count(*) FROM files f WHERE f.commit_id = c.commit_id) AS files,
       (SELECT count(*) FROM changes h WHERE h.commit_id = c.commit_id) AS changes,
       cast(CASE WHEN c.commit_id % 70 = 0 THEN 2 WHEN c.commit_id % 35 = 0 THEN 1 ELSE 0 END AS BIGINT) AS differing_records
FROM commits c
""")
register("walk_positions", "SELECT cast(repo_id AS BIGINT) AS repo_id, cast(commit_id AS VARCHAR) AS commit_id, pos FROM commits")
register("reachable_history", """
, links AS (
  SELECT repo_id, pos, pos + CASE WHEN parent_count <> 2 AND pos % 7 = 3 THEN 2 ELSE 1 END AS up FROM commits WHERE parent_count <> 0
  UNION ALL
  SELECT repo_id, pos, pos + 2 + pos % 5 FROM commits WHERE parent_count = 2
),
reached AS (
  SELECT c.repo_id, c.pos FROM commits c JOIN repos r ON r.repo_id = c.repo_id AND c.pos = r.idx * 3
  UNION
  SELECT c.repo_id, c.pos FROM reached x JOIN links l ON l.repo_id = x.repo_id AND l.pos = x.pos
  JOIN commits c ON c.repo_id = l.repo_id AND c.pos = l.up
)
SELECT cast(c.repo_id AS BIGINT) AS repo_id, cast(c.commit_id AS VARCHAR) AS commit_id
FROM commits c JOIN reached x ON x.repo_id = c.repo_id AND x.pos = c.pos
""")
SQL["reachable_history"] = SQL["reachable_history"].replace("WITH", "WITH RECURSIVE", 1)

register("documents_roundtrip", """
SELECT cast(a.repo_id AS BIGINT) AS repository_id, a.project_name, cast(a.commit_id AS VARCHAR) AS commit_id, a.author, a.message, a.date,
       cast(row_number() OVER (PARTITION BY a.repo_id ORDER BY a.pos) - 1 AS INTEGER) AS pos,
       (SELECT count(*) FROM files f WHERE f.commit_id = a.commit_id) AS files, a.pac_files_count AS pac_changes,
       a.other_files_count AS other_changes, a.has_pac_changes, a.pac_added_lines, a.pac_deleted_lines, a.total_added_lines,
       a.total_deleted_lines
FROM facts a
""")

# ------------------------------------- one CSV file, mixed catalog, manifest
register_x("inspection_file", """
SELECT cast(row_number() OVER (ORDER BY project_name, date, commit_sha) AS INTEGER) AS line, project_name, commit_sha, commit_message,
       author, date, github_url, pac_files_count, other_files_count, pac_added_lines, pac_deleted_lines, total_added_lines,
       total_deleted_lines, pac_files, pac_files_detailed
FROM insp
""")
register("scan_mixed_catalog", "SELECT cast(repo_id AS BIGINT) AS repo_id, full_name, sha, idx FROM repos")
register("discover_published", """
SELECT split_part(project_name, '/', 1) AS owner_name, split_part(project_name, '/', 2) AS repository_name,
       CASE WHEN max(repo_id) % 3 = 0 THEN 'second' ELSE 'first' END AS run
FROM facts GROUP BY project_name
""")
