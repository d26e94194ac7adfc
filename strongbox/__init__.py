"""Table backup, restore and fleet monitoring as Spark jobs."""
