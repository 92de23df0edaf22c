"""DataFrame transformations of the batch life cycle."""
