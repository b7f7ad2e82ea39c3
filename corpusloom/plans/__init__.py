"""Named queries over the driver tables: each operator of the library applied to a whole table, with its SQL."""
