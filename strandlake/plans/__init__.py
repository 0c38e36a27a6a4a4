"""Plans that are put together from a user's choices: columns, filters, views, lineage."""
