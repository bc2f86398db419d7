"""Driver-table adapter, registered queries and their SQL counterparts."""
