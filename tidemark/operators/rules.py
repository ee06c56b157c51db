"""Rules that drop or rewrite script statements."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DropRule:
    """A statement whose squeezed text matches is left out, for this reason."""

    name: str
    pattern: str
    reason: str


@dataclass(frozen=True)
class RewriteRule:
    """Where the trimmed text matches ``when`` and not ``unless``, the pattern
    is replaced. Of the rules of a chain only the first whose ``when`` matches
    is used."""

    name: str
    when: str
    pattern: str
    replacement: str
    unless: str | None = None


# In the order in which they are tried.
DROP_RULES = (
    DropRule(
        "transaction",
        r"(?i)^;*\s*(BEGIN|BEGIN TRANSACTION|START TRANSACTION|COMMIT|COMMIT TRANSACTION|END|BEGIN WORK|COMMIT WORK)\s*;*$",
        "Transaction statement removed",
    ),
    DropRule("data", r"(?i)^INSERT INTO |^COPY |\\\.", "Data/Insert statement removed"),
    DropRule("owner", r"(?i)^ALTER\s+.*?\s+OWNER\s+TO\b", "OWNER TO statement removed"),
    DropRule("privileges", r"(?i)^(GRANT|REVOKE)\b", "Privilege statement removed"),
    DropRule("comment", r"(?i)^COMMENT\s+ON\b", "Comment statement removed"),
    DropRule("publication", r"(?i)^(CREATE|ALTER|DROP)\s+PUBLICATION\b", "Publication statement removed"),
    DropRule("subscription", r"(?i)^(CREATE|ALTER|DROP)\s+SUBSCRIPTION\b", "Subscription statement removed"),
    DropRule("security_label", r"(?i)^SECURITY\s+LABEL\b", "Security Label statement removed"),
    DropRule("schema", r"(?i)^(CREATE|ALTER|DROP)\s+SCHEMA\b", "Schema statement removed"),
    DropRule("tablespace", r"(?i)^ALTER\s+.*?\s+SET\s+TABLESPACE\b", "Tablespace alter statement removed"),
)

# Each of these is applied.
INLINE_REWRITES = (
    RewriteRule("tablespace", "", r'(?i)\bTABLESPACE\s+(?:\w+|"[^"]+")', ""),
    RewriteRule(
        "access_method", r"(?i)^CREATE TABLE",
        r"(?i)\bUSING\s+(?:heap|ao_row|ao_column|column|brin|gin|gist|hash|spgist|btree)\b", "",
    ),
)

_GUARDED_TYPE = (
    "DO \\$\\$\nBEGIN\n    IF NOT EXISTS (SELECT 1 FROM pg_type t JOIN pg_namespace n ON t.typnamespace = n.oid "
    "WHERE t.typname = '$2') THEN\n        {}\n    END IF;\nEND \\$\\$;"
)

# A chain: statements that can be run twice.
SAFE_RUN_REWRITES = (
    RewriteRule("create_table", r"(?i)^CREATE TABLE", r"(?i)(CREATE\s+TABLE\s+)(.*)", "$1IF NOT EXISTS $2", r"(?i)IF NOT EXISTS"),
    RewriteRule("create_index", r"(?i)^CREATE (UNIQUE )?INDEX", r"(?i)(CREATE\s+(?:UNIQUE\s+)?INDEX\s+)(.*)", "$1IF NOT EXISTS $2", r"(?i)IF NOT EXISTS"),
    RewriteRule("create_schema", r"(?i)^CREATE SCHEMA", r"(?i)(CREATE\s+SCHEMA\s+)(.*)", "$1IF NOT EXISTS $2", r"(?i)IF NOT EXISTS"),
    RewriteRule("create_sequence", r"(?i)^CREATE SEQUENCE", r"(?i)(CREATE\s+SEQUENCE\s+)(.*)", "$1IF NOT EXISTS $2", r"(?i)IF NOT EXISTS"),
    RewriteRule("create_extension", r"(?i)^CREATE EXTENSION", r"(?i)(CREATE\s+EXTENSION\s+)(.*)", "$1IF NOT EXISTS $2", r"(?i)IF NOT EXISTS"),
    RewriteRule("add_column", r"(?i)^ALTER TABLE.*ADD COLUMN", r"(?i)(ADD\s+COLUMN\s+)(.*)", "$1IF NOT EXISTS $2", r"(?i)IF NOT EXISTS"),
    RewriteRule("drop_column", r"(?i)^ALTER TABLE.*DROP COLUMN", r"(?i)(DROP\s+COLUMN\s+)(.*)", "$1IF EXISTS $2", r"(?i)IF EXISTS"),
    RewriteRule("drop_constraint", r"(?i)^ALTER TABLE.*DROP CONSTRAINT", r"(?i)(DROP\s+CONSTRAINT\s+)(.*)", "$1IF EXISTS $2", r"(?i)IF EXISTS"),
    RewriteRule("create_trigger", r"(?i)^CREATE TRIGGER", r"(?i)^(\s*CREATE\s+TRIGGER\s+(\w+)\s+.*?\s+ON\s+([^\s;]+).*)$", "DROP TRIGGER IF EXISTS $2 ON $3;\n$1"),
    RewriteRule("create_view", r"(?i)^CREATE VIEW", r"(?i)CREATE\s+VIEW", "CREATE OR REPLACE VIEW"),
    RewriteRule("create_function", r"(?i)^CREATE FUNCTION", r"(?i)CREATE\s+FUNCTION", "CREATE OR REPLACE FUNCTION"),
    RewriteRule("create_procedure", r"(?i)^CREATE PROCEDURE", r"(?i)CREATE\s+PROCEDURE", "CREATE OR REPLACE PROCEDURE"),
    RewriteRule("create_mat_view", r"(?i)^CREATE MATERIALIZED VIEW", r"(?i)^(\s*CREATE\s+MATERIALIZED\s+VIEW\s+(\S+).*)$", "DROP MATERIALIZED VIEW IF EXISTS $2;\n$1"),
    RewriteRule("create_enum", r"(?i)^CREATE TYPE.*AS ENUM", r'(?i)^.*?CREATE\s+TYPE\s+((?:\S*\.)?"?([^\s."]+)"?)\s+AS\s+ENUM\s*\((.*?)\);.*$', _GUARDED_TYPE.format("CREATE TYPE $1 AS ENUM ($3);")),
    RewriteRule("create_domain", r"(?i)^CREATE DOMAIN", r'(?i)^.*?CREATE\s+DOMAIN\s+((?:\S*\.)?"?([^\s."]+)"?)\s+AS\s+(.*)$', _GUARDED_TYPE.format("CREATE DOMAIN $1 AS $3")),
    RewriteRule("create_policy", r"(?i)^CREATE POLICY", r"(?i)^(\s*CREATE\s+POLICY\s+(\w+)\s+ON\s+([^\s;]+).*)$", "DROP POLICY IF EXISTS $2 ON $3;\n$1"),
    RewriteRule("create_role", r"(?i)^CREATE ROLE", r'(?i)^\s*(CREATE\s+ROLE\s+"?(\w+)"?.*?)\s*$', "DO \\$\\$\nBEGIN\n    IF NOT EXISTS (SELECT 1 FROM pg_roles WHERE rolname = '$2') THEN\n        $1\n    END IF;\nEND \\$\\$;"),
)
