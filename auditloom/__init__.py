"""Filing analytics on Spark: DataFrame operators over structured financial filings."""
