"""Query catalogue: the reports, each with the SQL that checks it."""
