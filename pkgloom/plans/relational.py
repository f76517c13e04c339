"""Relational operators on the benchmark tables, each one SQL text that Spark's planner and the oracle both read.

A few words stand for functions that the two spell differently: see WORDS.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: word: (Spark, oracle)
WORDS = {
    r"SETJOIN\(([^()]+)\)": (r"array_join(array_sort(collect_set(\1)), ',')", r"coalesce(array_to_string(list_sort(list_distinct(list(\1))), ','), '')"),
    r"MICROS\((\w+)\)": (r"unix_micros(CAST(\1 AS TIMESTAMP))", r"epoch_us(\1)"),
    r"MATCHES\(([^()]+)\)": (r"regexp_like(\1)", r"regexp_matches(\1)"),
    r"WORDSOF\(([^()]+)\)": (r"explode(array_distinct(split(\1, ' ')))", r"unnest(list_distinct(string_split(\1, ' ')))"),
}

#: Query: (SQL, tables that it reads).
QUERIES = {
    "j05_token_overlap_join": "SELECT b.item_id, count(*) AS n_docs, sum(k) AS n_shared FROM (SELECT bt.item_id, dt.doc_id, count(*) AS k FROM (SELECT item_id, WORDSOF(text) AS w FROM benchmark) bt JOIN (SELECT doc_id, WORDSOF(text) AS w FROM documents) dt ON bt.w = dt.w GROUP BY bt.item_id, dt.doc_id) b GROUP BY b.item_id",
    "j09_three_way": "SELECT r_name, n_name, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name",
    "j08_sibling_join": "SELECT s_suppkey, n - 1 AS n_siblings, least(coalesce(a, b), coalesce(b, a)) AS first_sibling FROM (SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n, min(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, min(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM supplier) x WHERE n > 1",
    "j13_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "j13_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "j14_left_default": "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey",
    "j10_left_array": "SELECT c_custkey, coalesce(s, '') AS statuses FROM customer LEFT JOIN (SELECT o_custkey, SETJOIN(o_orderstatus) AS s FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey",
    "j12_inner_pair": "SELECT o_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "j15_set_match": "SELECT l_orderkey, SETJOIN(l_returnflag) AS flags, CASE WHEN SETJOIN(l_returnflag) = 'A,R' THEN 'exact' WHEN max(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END) = 1 THEN 'partial' ELSE 'none' END AS status FROM lineitem GROUP BY l_orderkey",
    "j17_division": "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey HAVING min(CASE WHEN p_size < 40 THEN 1 ELSE 0 END) = 1",
    "j18_resume": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IS NOT NULL)",
    "j19_change_sets": "SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'edited' END AS change FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01 00:00:00' GROUP BY o_custkey) a FULL OUTER JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey",
    "w01_gated_topk": "SELECT l_suppkey, l_orderkey, l_linenumber, rk FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_discount, max(l_discount) OVER (PARTITION BY l_suppkey) AS best FROM lineitem) x WHERE best <= 0.05 OR l_discount > 0) y WHERE rk <= 2",
    "w03_intervals": "SELECT user_id, count(days) AS n_gaps, sum(days) AS days, max(days) AS longest FROM (SELECT user_id, CAST(floor((MICROS(ts) - lag(MICROS(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400000000) AS BIGINT) AS days FROM events) x GROUP BY user_id",
    "w04_all_but_last": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r > 1",
    "w05_after_flag": "SELECT user_id, sum(CASE WHEN seen = 1 THEN 1 ELSE 0 END) AS n_after FROM (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) x GROUP BY user_id",
    "w06_last_non": "SELECT user_id, event_id AS last_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'click') x WHERE r = 1",
    "w07_last_writer": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1",
    "w08_priority_pick": "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 WHEN o_orderpriority LIKE '3%' THEN 2 ELSE 4 END, o_orderdate, o_orderkey) AS r FROM orders) x WHERE r = 1",
    "w02_first_with_fallback": "SELECT n.n_nationkey, coalesce(s.first_name, f.first_name) AS first_name FROM nation n LEFT JOIN (SELECT s_nationkey, min(s_name) AS first_name FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey LEFT JOIN (SELECT n_regionkey, min(s_name) AS first_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey) f ON f.n_regionkey = n.n_regionkey",
    "a05_multilabel_hist": "SELECT w AS label, count(*) AS n FROM (SELECT WORDSOF(p_name) AS w FROM part) x GROUP BY w",
    "a07_duration_stats": "SELECT o_orderpriority, count(*) AS n, round(avg(h), 6) AS mean_hours, round(median(h), 6) AS median_hours FROM (SELECT o_orderpriority, (MICROS(l_shipdate) - MICROS(o_orderdate)) / 3600000000.0E0 AS h FROM orders JOIN lineitem ON l_orderkey = o_orderkey) x GROUP BY o_orderpriority",
    "a08_share_stats": "SELECT event_type, count(*) AS n, round(sum(CASE WHEN value > 50 THEN 1.0E0 ELSE 0.0E0 END) / count(*), 6) AS share, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY event_type",
    "a09_revisits": "SELECT count(*) AS n_keys, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS n_multi, round(avg(n), 6) AS mean_n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) x",
    "a10_commenters": "SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS n_assistant, max(CASE WHEN role LIKE '%s%' THEN 1 ELSE 0 END) AS any_s FROM conversations GROUP BY conv_id",
    "a11_before_after_distinct": "SELECT o_custkey, count(DISTINCT CASE WHEN o_orderdate < TIMESTAMP '1995-01-01 00:00:00' THEN o_orderpriority END) AS n_before, count(DISTINCT o_orderpriority) AS n_after FROM orders GROUP BY o_custkey",
    "a12_label_class": "SELECT CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_type LIKE '% %' THEN 'worded' ELSE 'other' END AS class, count(*) AS n FROM part GROUP BY 1",
    "a13_distinct_levels": "SELECT host, count(DISTINCT url) AS n_raw, count(DISTINCT bare) AS n_bare, count(DISTINCT lang) AS n_lang FROM (SELECT url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) AS lang FROM pages) x GROUP BY host",
    "a15_prf": "SELECT round(tp / nullif(p, 0), 6) AS prec, round(tp / nullif(t, 0), 6) AS rec, round(2 * tp / nullif(p + t, 0), 6) AS f1 FROM (SELECT sum(CASE WHEN quality = 1 AND n_chars > 500 THEN 1.0E0 ELSE 0.0E0 END) AS tp, sum(CASE WHEN n_chars > 500 THEN 1.0E0 ELSE 0.0E0 END) AS p, sum(CASE WHEN quality = 1 THEN 1.0E0 ELSE 0.0E0 END) AS t FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x",
    "a16_rates": "SELECT source, count(*) AS n, round(100.0E0 * sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY source",
    "a19_recall": "SELECT lang, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS n_expected, sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS n_both FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY lang",
    "a20_set_status": "SELECT user_id, a, b, CASE WHEN a = b THEN 'exact' WHEN a = '' OR b = '' THEN 'mismatch' ELSE 'other' END AS status FROM (SELECT user_id, SETJOIN(e1) AS a, SETJOIN(e2) AS b FROM (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS e1, CASE WHEN event_id % 2 = 1 THEN event_type END AS e2 FROM events) x GROUP BY user_id) y",
    "a21_type_distribution": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_entries, count(*) AS n_instances FROM lineitem GROUP BY l_returnflag",
    "a22_instances": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "a23_joined_types": "SELECT l_orderkey, SETJOIN(l_linestatus) AS types FROM lineitem GROUP BY l_orderkey",
    "a24_overlap_counts": "SELECT count(*) AS n, sum(CASE WHEN q = 0 AND t = 1 THEN 1 ELSE 0 END) AS n_overlap FROM (SELECT doc_id, min(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) x",
    "a25_contexts": "SELECT l_partkey, SETJOIN(ctx) AS contexts FROM (SELECT l_partkey, concat(CAST(l_suppkey AS VARCHAR(20)), ':', l_returnflag) AS ctx FROM lineitem) x GROUP BY l_partkey",
    "a26_comment_counter": "SELECT conv_id, role, count(*) AS n FROM conversations WHERE text <> '' GROUP BY conv_id, role",
    "a28_label_map": "SELECT p_brand, SETJOIN(p_type) AS types FROM part WHERE p_size > 10 GROUP BY p_brand",
    "a01_group_by_repo": "SELECT p_brand, p_size, count(*) AS n, min(p_name) AS first_name FROM part GROUP BY p_brand, p_size",
    "a04_counts": "SELECT count(*) AS n, count(DISTINCT p_name) AS n_names, count(DISTINCT p_brand) AS n_repos FROM part",
    "a06_rollup_pair": "SELECT sum(CASE WHEN l_returnflag IN ('A', 'N') THEN 1 ELSE 0 END) AS coverage, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS correctness FROM lineitem",
    "k11_grouped_messages": "SELECT n_name, count(DISTINCT msg) AS n, SETJOIN(msg) AS messages FROM (SELECT n_name, concat('package ', s_name) AS msg FROM supplier JOIN nation ON s_nationkey = n_nationkey) x GROUP BY n_name",
    "l01_topn": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "l02_rank_rates": "SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) x",
    "l04_slice": "SELECT c_custkey, 10 + row_number() OVER (ORDER BY c_name, c_custkey) AS r FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 30 OFFSET 10) x",
    "l05_sorted_lists": "SELECT s_nationkey, SETJOIN(s_name) AS names FROM supplier GROUP BY s_nationkey",
    "u01_union_dedup": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "u02_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "u03_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "u05_right_biased": "SELECT k, name FROM (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY src DESC) AS r FROM (SELECT c_custkey AS k, c_name AS name, 0 AS src FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) x) y WHERE r = 1",
    "p20_cutoff": "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00'",
    "p21_label_filter": "SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('', 'error', 'Other')",
    "p22_having": "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey HAVING max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AND count(DISTINCT l_suppkey) >= 2",
    "p24_having_one": "SELECT o_custkey FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority) x GROUP BY o_custkey HAVING max(n) = 1 AND count(*) >= 2",
    "p06_cross_expand": "SELECT r_name, n_name, concat(lower(r_name), '-', lower(n_name)) AS key FROM region CROSS JOIN nation",
    "p12_accessors": "SELECT DISTINCT p_brand, p_size FROM part",
    "p23_ignore": "SELECT p_partkey FROM part WHERE p_name NOT LIKE 'a%' AND p_name NOT LIKE '%-debuginfo'",
    "p28_os_list": "SELECT n_name FROM nation WHERE n_name NOT IN ('FRANCE', 'CHINA') ORDER BY n_name",
    "m02_hours": "SELECT l_orderkey, l_linenumber, round((MICROS(l_shipdate) - MICROS(o_orderdate)) / 3600000000.0E0, 6) AS hours FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "m03_days": "SELECT l_orderkey, l_linenumber, CAST(floor((MICROS(l_shipdate) - MICROS(o_orderdate)) / 86400000000.0E0) AS BIGINT) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "m05_pct": "SELECT lang, round(100.0E0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM documents GROUP BY lang",
    "f24_url_parts": "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS number FROM pages",
    "f26_md5": "SELECT page_id, md5(url) AS key FROM pages",
    "f12_subtype": "SELECT p_partkey, regexp_replace(concat('B.', CAST(p_size AS VARCHAR(9)), 'a'), '^([A-Z][.][0-9]+)[a-z]$', CAPTURE1) AS main FROM part",
    "f29_message": "SELECT s_suppkey, concat('Package ', s_name, ' is missing in nation ', CAST(s_nationkey AS VARCHAR(9))) AS message FROM supplier",
    "p25_clamp": "SELECT p_partkey, greatest(1, least(coalesce(p_size, 5), 20)) AS k FROM part",
    "s02_codec_by_url": "SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'html' WHEN url LIKE '%/' THEN 'index' WHEN MATCHES(url, '[?#]') THEN 'query' ELSE 'plain' END AS kind FROM pages",
    "a03_build_table": "SELECT concat(p_brand, '_', CAST(p_size AS VARCHAR(9))) AS repo_key, SETJOIN(p_name) AS packages FROM part GROUP BY 1",
    "a14_overlap_summary": "SELECT lang, count(*) AS n, sum(hit) AS n_overlap, round(100.0E0 * sum(hit) / count(*), 4) AS pct FROM (SELECT d.lang, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = d.doc_id) x GROUP BY lang",
    "a17_verification_counts": "SELECT event_type AS tool, count(*) AS n_entries, count(c_custkey) AS n_verified, count(*) - count(c_custkey) AS n_fake FROM events LEFT JOIN customer ON c_custkey = user_id * 2 GROUP BY event_type",
    "a18_source_comparison": "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_lang, sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS n_empty FROM documents GROUP BY source",
    "a27_counters": "SELECT count(*) AS n_calls, round(sum(value), 2) AS total FROM events",
    "j16_pair_matrix": "SELECT a.user_id, a.event_type AS p1, b.event_type AS p2, a.n + b.n AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) a JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) b ON a.user_id = b.user_id AND a.event_type < b.event_type",
    "j21_extras": "SELECT o_orderpriority AS tool, unverified, extra, round(100.0E0 * unverified / nullif(extra, 0), 4) AS rate FROM (SELECT o_orderpriority, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS extra, sum(CASE WHEN o_orderstatus = 'O' AND c_custkey IS NULL THEN 1 ELSE 0 END) AS unverified FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey GROUP BY o_orderpriority) x",
    "j24_assembly": "SELECT k, name, load_ord FROM (SELECT k, name, load_ord, row_number() OVER (PARTITION BY k ORDER BY load_ord DESC, name) AS r FROM (SELECT n_name AS k, 'base' AS name, 0 AS load_ord FROM nation UNION ALL SELECT n_name, s_name, 1 FROM nation JOIN supplier ON s_nationkey = n_nationkey) x) y WHERE r = 1",
    "k04_rows_with_clean_keys": "SELECT o_orderkey AS entry_key, coalesce(l_linenumber, 0) AS line, coalesce(l_returnflag, 'no_issues') AS status FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R') l ON l_orderkey = o_orderkey",
    "k05_markdown": "SELECT n_name, concat('# ', n_name, chr(10), '- ', replace(SETJOIN(s_name), ',', concat(chr(10), '- '))) AS report FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    "k08_latex_rows": "SELECT n_name, concat(replace(n_name, '_', '-'), ' & ', CAST(count(*) AS VARCHAR(20)), ' & ', CAST(min(s_suppkey) AS VARCHAR(20))) AS latex FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    "l03_head": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25",
    "m04_utc": "SELECT event_id, MICROS(ts) AS us FROM events",
    "m07_weighted": "SELECT l_orderkey, l_linenumber, round(0.7E0 / 3 * (l_discount + l_tax + 1) + 0.3E0 / 3 * (l_discount + 2), 6) AS score FROM lineitem",
    "m08_stats": "SELECT p_brand, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi, round(avg(p_size), 6) AS mean, round(median(p_size), 6) AS mid, round(100.0E0 * sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) / count(*), 4) AS share FROM part GROUP BY p_brand",
    "m11_list_strings": "SELECT p_partkey, replace(p_name, ' ', ',') AS binnames, concat(p_name, ' ', p_type) AS description FROM part",
    "p27_key_parts": "SELECT k, CASE WHEN length(k) - length(replace(k, '_', '')) = 1 THEN split_part(k, '_', 1) ELSE k END AS platform, CASE WHEN length(k) - length(replace(k, '_', '')) = 1 THEN split_part(k, '_', 2) ELSE '' END AS version FROM (SELECT concat(lower(r_name), '_', lower(n_name)) AS k FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT lower(r_name) FROM region UNION SELECT concat(lower(r_name), '_x_', r_name) FROM region) x",
    "p30_distribution_accessors": "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS n_repos FROM orders GROUP BY o_orderstatus",
    "p31_membership": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)",
    "p07_repo_accessors": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS status, coalesce(n, 1) AS n_packages FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) l ON l_orderkey = o_orderkey",
    "w10_key_choice": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 9 END, o_orderdate, o_orderkey) AS r FROM orders) x WHERE r = 1",
    "c09_ground_truth": "SELECT l_partkey AS key, l_orderkey AS change_id, l_suppkey AS package FROM (SELECT l_partkey, l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x WHERE r = 1",
    "c10_change_database": "SELECT c_custkey, n_orders, first_order FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey HAVING count(*) > 1) o ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'",
    "q01_flagship_pricing": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
}


def _spell(sql: str, which: int) -> str:
    for pattern, by in WORDS.items():
        sql = re.sub(pattern, by[which], sql)
    return sql.replace("CAPTURE1", ("'$1'", r"'\1'")[which])


#: Spark's own text where its plan for the common one sends a table that grows through the driver: of NOT IN the keys are
#: broadcast. Null is in no list, but where that is empty.
SPARK = {
    "j18_resume": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = o_orderkey) AND (o_orderkey IS NOT NULL OR (SELECT count(l_orderkey) FROM lineitem WHERE l_returnflag = 'R') = 0)",
}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the Parquet tables in sf_dir; only those that it names are opened."""
    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = _spell(sql, 0)
    for t in names:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{t_{t}}}", text)
    braces = re.sub(r"\{(?!t_)|(?<!\w)\}", lambda m: m[0] * 2, text)
    return spark.sql(braces, **{f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def queries() -> dict:
    return {name: (lambda spark, sf_dir, sql=sql: run(spark, sf_dir, sql)) for name, sql in (QUERIES | SPARK).items()}


def oracle_sql() -> dict[str, str]:
    return {name: _spell(sql, 1) for name, sql in QUERIES.items()}
