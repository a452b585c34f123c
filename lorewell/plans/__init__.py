"""Query registries: one callable and, where possible, one SQL twin per operator."""
