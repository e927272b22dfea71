"""All queries of this package and, where SQL can express them, the same in DuckDB SQL."""

from lectern.llm import decontaminate, html_template, language_id, line_dedup, packing, quality_rules, quote_threads, sharding, simhash_dedup, spelling, token_store, warc_archive, whitening

MODULES = (decontaminate, html_template, language_id, line_dedup, packing, quality_rules, quote_threads, sharding, simhash_dedup, spelling, token_store, warc_archive, whitening)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
