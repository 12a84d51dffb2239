"""Risk-signal analytics on Spark: declarative event-time variables, rules, alerts and the lookups that serve them."""
