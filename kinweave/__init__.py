"""kinweave: party-graph analytics and entity resolution, planned by Spark."""
