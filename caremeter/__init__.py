"""Provider-quality analytics as Spark jobs: raw CSV -> typed tables -> views and reports."""
