"""Weather-aware place ranking, curated catalogues and record clean-up as Spark DataFrame operators."""
