"""Spark jobs that turn start/end alert records into hourly exposure forecasts for every region at once."""
