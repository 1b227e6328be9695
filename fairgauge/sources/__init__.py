"""Sources and sinks: tables in, report tables out."""
