"""Collection-style, relational, incremental and semiring-annotated pipelines on Spark DataFrames."""
