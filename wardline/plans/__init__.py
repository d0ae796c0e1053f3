"""Plans: stand-in inputs from the driver tables, registered queries, the end-to-end pipeline."""
