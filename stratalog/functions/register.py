"""The Python functions under SQL names, so spark.sql reaches them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalog.functions import frontmatter, redaction, shell
from stratalog.operators.timeline import pretty

NAMES = ("normalize_command", "redact", "redact_labelled", "parse_frontmatter", "secret_line", "pretty_json", "entropy")


def register(spark: SparkSession) -> None:
    """Registers NAMES in the session; all run over Arrow batches."""
    def shown(values: pd.Series) -> pd.Series:
        def one(raw: str) -> str:
            try:
                return pretty(json.loads(raw))
            except ValueError:
                return raw

        return values.map(one, na_action="ignore")

    def bits(values: pd.Series) -> pd.Series:
        return values.map(redaction.entropy, na_action="ignore").astype("float64")

    for name, f in {
        "normalize_command": shell.normalize_udf(), "redact": redaction.redact_udf(), "redact_labelled": redaction.redact_udf(redaction.LABELLED), "parse_frontmatter": F.pandas_udf(frontmatter.parse_all, frontmatter.SCHEMA),
        "secret_line": redaction.secret_line_udf(), "pretty_json": F.pandas_udf(shown, "string"), "entropy": F.pandas_udf(bits, "double"),
    }.items():
        spark.udf.register(name, f)
