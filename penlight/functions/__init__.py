"""Part of penlight; see README.md for the layout."""
