"""Sources and sinks: archives, directories, manifests, report tables."""
