"""Sources and sinks: GeoTIFF, cell tables, vector and CSV output."""
