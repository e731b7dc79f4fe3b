"""A briefing-analytics engine expressed as Spark plans."""
