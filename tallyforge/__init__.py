"""tallyforge: projection, consensus, window, label and draft analytics as Spark jobs."""
