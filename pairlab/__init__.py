"""pairlab: entity matching, ranking evaluation and corpus jobs as Spark DataFrame operators."""
