"""Jobs and reports over the provider tables: loads, views, check suites, explorations, analyses."""
