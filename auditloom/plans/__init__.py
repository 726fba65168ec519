"""Named queries over the driver tables, with equivalent DuckDB SQL."""

from auditloom.plans import catalog, documents, exports, filings, lookups, networks, rules, scalars, verification

QUERIES = filings.QUERIES | catalog.QUERIES | scalars.QUERIES | verification.QUERIES | lookups.QUERIES | networks.QUERIES | documents.QUERIES | exports.QUERIES | rules.QUERIES
ORACLE = filings.ORACLE | catalog.ORACLE | scalars.ORACLE | verification.ORACLE | lookups.ORACLE | networks.ORACLE | documents.ORACLE | exports.ORACLE | rules.ORACLE
