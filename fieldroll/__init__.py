"""Roll-ups of site-activity records on Spark: DataFrame and Column functions, lazy throughout."""
