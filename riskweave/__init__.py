"""Transaction-risk analytics on Spark: entity linking, network features, rules,
behavioural baselines, model scores and a single 0-100 risk score per transaction."""
