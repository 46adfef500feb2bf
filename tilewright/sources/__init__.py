"""Tables in and out: point clouds, roles of the driver tables, display files."""
