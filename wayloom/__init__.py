"""wayloom: vehicle-telemetry, road-graph and corpus analytics as Spark plans."""
