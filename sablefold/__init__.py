"""sablefold: PII detection, pseudonymisation and restoration over Spark DataFrames."""
