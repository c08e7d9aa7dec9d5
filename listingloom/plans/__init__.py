"""Views over the supplied tables, the query catalogue and its SQL counterparts."""
