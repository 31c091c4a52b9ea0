"""All queries of this subpackage and the SQL that each is held against, where SQL can express it."""

from fathom.llm import decontaminate, exact_dedup, html_extract, langid, mixing, secrets, sharding, simhash, tokens, warc

MODULES = (secrets, decontaminate, html_extract, warc, langid, simhash, tokens, sharding, exact_dedup, mixing)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
