"""Query plans built from the operators: the staged cleaning batch, KPIs, analyses."""
