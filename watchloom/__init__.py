"""Operations-telemetry analytics as Spark DataFrame jobs."""
