"""Column functions: built-in expressions where they suffice, Arrow-batched Python where they do not."""
