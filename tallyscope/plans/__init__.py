"""Named queries over the supplied tables, each with its SQL oracle."""
