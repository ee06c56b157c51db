"""Text signatures of database extensions (name, pattern).

Patterns are matched per line, in any letter case.
"""

DECLARED = r"""create\s+extension\s+(?:if\s+not\s+exists\s+)?["']?([a-zA-Z0-9_\-]+)["']?"""

SIGNATURES = {
    "uuid-ossp": r"\buuid_generate_v[1-5]\b|\buuid_nil\b|\buuid_ns_dns\b|\buuid_ns_url\b|\buuid_ns_oid\b|\buuid_ns_x500\b",
    "pgcrypto": r"\bgen_salt\b|\bpgp_sym_(en|de)crypt\b|\bpgp_pub_(en|de)crypt\b|\bcrypt\b|\bdigest\b|\bhmac\b",
    "postgis": r"\bgeometry\b|\bgeography\b|\bst_[a-zA-Z0-9_]+",
    "hstore": r"\bhstore\b",
    "unaccent": r"\bunaccent\b",
    "citext": r"\bcitext\b",
    "pg_trgm": r"\bsimilarity\b|\bword_similarity\b|\bshow_trgm\b",
    "fuzzystrmatch": r"\blevenshtein\b|\bsoundex\b|\bmetaphone\b",
    "ltree": r"\bltree\b|\blquery\b|\bltxtquery\b",
    "cube": r"\bcube\b|\bcube_dim\b|\bcube_ll_ur\b",
    "earthdistance": r"\bll_to_earth\b|\bearth_distance\b|\bearth_box\b",
    "isn": r"\bisbn\b|\bissn\b|\bupc\b|\bean13\b",
    "lo": r"\blo_manage\b|\blo_oid\b",
    "tablefunc": r"\bcrosstab\b|\bcrosstab[2-4]\b|\bconnectby\b",
    "intarray": r"\bicount\b|\buniq\b|\bsubarray\b",
    "pg_visibility": r"\bpg_visibility\b|\bpg_visibility_map\b",
    "pgrowlocks": r"\bpgrowlocks\b",
    "pg_buffercache": r"\bpg_buffercache_pages\b",
    "pg_stat_statements": r"\bpg_stat_statements_reset\b|\bpg_stat_statements\b",
    "dblink": r"\bdblink_connect\b|\bdblink_exec\b",
    "amcheck": r"\bbt_index_check\b|\bbt_index_parent_check\b",
    "pageinspect": r"\bget_raw_page\b|\bheap_page_items\b",
    "xml2": r"\bxml_valid\b|\bxpath_string\b|\bxslt_process\b",
    "bloom": r"\busing\s+bloom\b",
    "semver": r"\bsemver\b",
    "adminpack": r"\bpg_file_write\b|\bpg_file_rename\b|\bpg_logdir_ls\b",
    "file_fdw": r"\bfile_fdw_handler\b|\bfile_fdw_validator\b",
    "postgres_fdw": r"\bpostgres_fdw_handler\b|\bpostgres_fdw_validator\b",
    "tsm_system_rows": r"\btsm_system_rows_handler\b",
    "tsm_system_time": r"\btsm_system_time_handler\b",
    "pg_prewarm": r"\bpg_prewarm\b",
    "hll": r"\bhll\b",
    "pgvector": r"\bvector\b|\bcosine_distance\b|\bl2_distance\b|\binner_product\b",
    "timescaledb": r"\bcreate_hypertable\b|\btime_bucket\b|\btime_bucket_gapfill\b",
    "pg_partman": r"\bcreate_parent\b|\brun_maintenance\b|\bpartman\b",
    "pg_cron": r"\bcron\.schedule\b|\bcron\.unschedule\b|\bcron\.job\b",
    "prefix": r"\bprefix_range\b|\bprefix_gist\b",
    "ip4r": r"\bip4\b|\bip6\b|\bip4r\b|\bip6r\b",
    "pgjwt": r"\bjwt\.sign\b|\bjwt\.verify\b",
    "plv8": r"\blanguage\s+plv8\b|\bplv8_\b",
    "chkpass": r"\bchkpass\b",
    "pg_dirtyread": r"\bpg_dirtyread\b",
    "pg_repack": r"\bpg_repack\b",
    "pg_stat_kcache": r"\bpg_stat_kcache\b",
    "pg_wait_sampling": r"\bpg_wait_sampling\b",
    "pg_hint_plan": r"\bpg_hint_plan\b",
    "pgaudit": r"\bpgaudit\b",
    "orafce": r"\bdbms_output\b|\badd_months\b|\blast_day\b",
    "tcn": r"\btriggered_change_notification\b",
    "pglogical": r"\bpglogical_node\b|\bpglogical_sub\b",
    "tds_fdw": r"\btds_fdw_handler\b",
    "mysql_fdw": r"\bmysql_fdw_handler\b",
    "oracle_fdw": r"\boracle_fdw_handler\b",
    "sqlite_fdw": r"\bsqlite_fdw_handler\b",
}
