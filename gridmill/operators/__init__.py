"""Table operators: typing, cleaning, profiling, KPIs, charts and analytics."""
