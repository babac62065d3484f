"""Named query plans: the bindings to the driver's tables and the query registry."""
