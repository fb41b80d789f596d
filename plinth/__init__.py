"""plinth: listing analytics and corpus preparation as Spark jobs."""
