"""fieldloom: data-dictionary harmonization and data preparation on Spark."""
