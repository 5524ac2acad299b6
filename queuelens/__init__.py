"""Analytics over the operational data of task queues and workflow graphs, on Spark."""
