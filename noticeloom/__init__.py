"""Notice intelligence on Spark: landed pages and payloads to notices, snapshots, alerts and marts."""
