"""Operators: profiling, EDA, cleaning, preprocessing, models, CV, explanation,
feature search and run-log analytics (survey sections 2.C - 2.L)."""
