"""Record linkage on Spark: blocking, pair features, two-stage scoring and set selection as DataFrame plans."""
