"""Sources and sinks: CSV scans, artifact stores, layer writers and the driver-table adapter."""
