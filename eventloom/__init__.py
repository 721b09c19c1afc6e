"""DataFrame operators for time-ordered entity events, written for Spark at scale."""
