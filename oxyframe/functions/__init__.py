"""Column-level functions: windows, time formats, palette."""
