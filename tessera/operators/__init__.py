"""DataFrame operators of the catalog: matching, inventory, review queues, index, tags."""
