"""Feature panels, folds and models as Spark ML jobs."""
