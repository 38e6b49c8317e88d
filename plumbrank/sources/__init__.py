"""Sources and sinks: datasets, runs, bundles, the content-addressed store."""
