"""Feature matrices and risk signals from folders of related tables, on Spark."""
