"""SQL surface, engine, and the queries over the driver's tables."""
