"""Operators for building training corpora. Nothing outside this folder imports them;
`registry.QUERIES` and `registry.ORACLE_SQL` hold their queries."""
