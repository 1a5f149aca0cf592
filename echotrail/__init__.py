"""Pattern-of-behaviour search over transactional graphs, on Spark."""
