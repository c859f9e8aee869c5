"""Build-evidence analytics as Spark jobs: DataFrame in, DataFrame out."""
