"""End-to-end plans (static run, feature search, profile + EDA) and the
registered query catalogue used by ``__spark_entry__``."""
