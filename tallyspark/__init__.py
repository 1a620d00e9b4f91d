"""tallyspark: a Spark-first engine for statement, credit-facility and ledger analytics."""
