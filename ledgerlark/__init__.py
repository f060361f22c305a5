"""Anti-money-laundering jobs on Spark: rules, screening, scoring, patterns, networks, reports and features."""
