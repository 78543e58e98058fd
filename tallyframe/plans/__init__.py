"""The registered queries, and the roles that the supplied tables play in them."""
