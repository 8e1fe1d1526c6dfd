"""Sources and sinks of event tables."""
